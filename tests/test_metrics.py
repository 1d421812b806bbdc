import pytest
from pyspark.sql import functions as F

from opinara.operators import metrics


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "id int, aspect string, polarity string")


def test_scores_of_edge_cases(spark):
    examples = spark.createDataFrame([(i,) for i in range(5)], "id int")
    gold = _pairs(spark, [(1, "a", "p"), (2, "a", "p"), (4, "a", "p"), (9, "z", "p")])
    pred = _pairs(spark, [(1, "a", "p"), (1, "a", "p"), (3, "a", "p"), (4, "a", "n"), (9, "z", "p")])
    got = {r.id: (r.n_pred, r.n_gold, r.n_ok) for r in metrics.counts(examples, pred, gold, "id").collect()}
    # a repeated prediction counts again; nothing against nothing scores 0; rows that are no example are left out
    assert got == {0: (0, 0, 0), 1: (2, 1, 2), 2: (0, 1, 0), 3: (1, 0, 0), 4: (1, 1, 0)}
    s = metrics.scores(metrics.counts(examples, pred, gold, "id")).first()
    assert (s.examples, s.p_macro, s.p_micro) == (5, 20.0, 50.0)


def test_scores_of_nothing(spark):
    s = metrics.scores(spark.createDataFrame([], "n_pred int, n_gold int, n_ok int")).first()
    assert (s.examples, s.n_ok, s.f1_macro, s.f1_micro) == (0, 0, 0.0, 0.0)


def test_maps_against_a_plain_count(spark):
    rows = [(1, {"a": "p", "b": "n"}, {"b": "n"}), (2, None, {"a": "p"}), (3, {"a": "p"}, None), (4, {}, {}), (5, {"a": "p"}, {"a": "n"})]
    df = spark.createDataFrame(rows, "id int, gold map<string,string>, pred map<string,string>")
    p, g, k = metrics.counts_in_row(F.col("pred"), F.col("gold"))
    got = [tuple(r) for r in df.select("id", p, g, k).orderBy("id").collect()]
    assert got == [(i, len(b or {}), len(a or {}), sum((a or {}).get(x) == y for x, y in (b or {}).items())) for i, a, b in rows]
    kinds = {(r.kind, r.n) for r in metrics.error_profile(metrics.aligned(df, "id", "pred", "gold")).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert kinds == {("missing", 2), ("extra", 1), ("wrong", 1)}


def test_the_scan_reads_only_what_is_needed(spark):
    from opinara.queries import queries

    plan = queries()["q_metrics_overall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_greedy_mmr_against_the_definition(k):
    import numpy as np

    from opinara.operators.retrieval import greedy_mmr

    rng = np.random.default_rng(k)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims, base = v @ v.T, np.sort(rng.random(12))[::-1]
    chosen, left = [], list(range(12))
    while len(chosen) < k and left:
        best, at = -np.inf, None
        for i in left:
            m = max((sims[i, j] for j in chosen), default=None)
            if m is not None and m > 0.92 and len(left) > k - len(chosen):
                continue
            score = 0.8 * base[i] - (0.2 * m if m is not None else 0)
            if score > best:
                best, at = score, i
        if at is None:
            break
        chosen.append(at)
        left.remove(at)
    assert greedy_mmr(base, sims, k, 0.8) == chosen
