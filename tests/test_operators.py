import random

import pytest
from pyspark.sql import functions as F

from opinara.operators import augment, experiments, features
from opinara.plans import runtime
from opinara.streaming import scoring


def test_components_against_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r.node: r.component for r in runtime.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[find(x)] for x in parent}
    assert runtime.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_in_group_is_dense(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(900)], "g string, k int")
    for g, n in (("hot", 600), (None, 300)):
        got = sorted(r.r for r in runtime.rank_in_group(df, ["g"], [F.col("k")], "r", 8).where(F.col("g").eqNullSafe(g)).collect())
        assert got == list(range(n))


def test_expand_links(spark):
    left = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 50)], "grp long, k int")
    right = spark.createDataFrame([(1, 100 + i) for i in range(5)], "grp long, k int")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "a long, b long")
    got = {tuple(r) for r in runtime.expand_links(links, left, right, "k").collect()}
    assert got == {(i, 100 + j) for i in [*range(7), 50] for j in range(5)}


def test_spaced_places(spark):
    rows = spark.createDataFrame([(i,) for i in range(132)], "k int")
    assert [r.position for r in experiments.spaced(rows, "k", 0, 8).orderBy("k").collect()] == [0, 19, 37, 56, 75, 94, 112, 131]
    assert experiments.spaced(rows, "k", 130, None).count() == 2


def test_running_best_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([("r", 1, 5.0, 1.0), ("r", 2, 5.0, 1.0), ("r", 3, 5.0, 2.0), ("r", 4, 4.0, 9.0)], "run string, step int, a double, b double")
    assert [(r.best_step, r.improved) for r in experiments.running_best(rows, "run", "step", "a", "b").orderBy("step").collect()] == [(1, True), (1, False), (3, True), (3, False)]


def test_greedy_acceptance_against_a_loop(spark):
    random.seed(3)
    sets = {i: sorted({f"g{random.randrange(8)}" for _ in range(4)}) for i in range(40)}
    accepted = []
    for i in sets:
        s = set(sets[i])
        if all(len(s & set(sets[j])) / len(s | set(sets[j])) <= 0.5 for j in accepted):
            accepted.append(i)
    df = spark.createDataFrame(list(sets.items()), "k int, g array<string>")
    assert sorted(r.k for r in augment.accept_greedily(df, "k", "g", 0.5).where("accepted").collect()) == accepted


def test_sft_feature(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4, 5]), ([1, 9], [1, 2, 3])], "p array<int>, f array<int>")
    rows = [r.x for r in df.select(features.sft_feature(F.col("p"), F.col("f"), 4, strict=False).alias("x")).collect()]
    assert (rows[0].input_ids, rows[0].labels, rows[0].trainable_tokens, rows[0].truncated) == ([2, 3, 4, 5], [-100, 3, 4, 5], 3, True)
    assert rows[1].labels == [-100, 2, 3]
    with pytest.raises(Exception, match="no prefix"):
        df.select(features.sft_feature(F.col("p"), F.col("f"), 4)).collect()


def test_padded_feature(spark):
    x = spark.createDataFrame([([7, 0, 8],)], "ids array<int>").select(features.padded_feature(F.col("ids"), 5, 0).alias("x")).first().x
    assert (x.input_ids, x.attention_mask, x.labels) == ([7, 0, 8, 0, 0], [1, 1, 1, 0, 0], [7, -100, 8, -100, -100])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("es", {"a": "p"}, {"a": "p"}), ("es", {"a": "n"}, {"a": "p"}), ("en", None, {"a": "p"})], "language string, prediction map<string,string>, gold map<string,string>")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, "language", "prediction", "gold", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in scoring.total(spark, str(tmp_path / "out"), "language").collect()}
    assert got == {tuple(r) for r in scoring.batch_sums(rows, "language", "prediction", "gold").collect()}


def test_global_rank(spark):
    from pyspark.sql import functions as F

    from opinara.plans.runtime import global_rank

    rows = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(50))))
    got = [(r.k, r.id, r.n) for r in global_rank(rows, ["k", "id"], "n", down=(1,)).collect()]
    assert [x[2] for x in sorted(got, key=lambda x: (x[0], -x[1]))] == list(range(1, 2001))
    assert global_rank(rows.limit(0), ["k"], "n").count() == 0


def test_middle_and_longest(spark):
    from opinara.operators.experiments import middle_and_longest

    for lengths in ([5], [3, 3], [1, 2, 2, 2, 9], [4, 1, None, 4, 4, 7, 7], []):
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, n long")
        got = {r.which: (r.k, r.n) for r in middle_and_longest(rows, "n", "k").collect()}
        held = sorted((n, i) for i, n in enumerate(lengths) if n is not None)
        assert got == ({"middle": held[len(held) // 2][::-1], "longest": max(((i, n) for n, i in held), key=lambda x: (x[1], -x[0]))} if held else {})


def test_baseline_scores_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    from opinara import queries

    # means next to a half of the last digit, from below and on it
    values = {1: [89.39, 49.97, 112.5, 84.41, 49.25, 48.16, 45.46, 84.67], 2: [50.65, 0.22, 60.23, 4.61, 34.98, 39.56, 63.97, 4.81], 3: [101.69, 4.9, 156.45, 28.61, 61.51, 55.83, 8.36, 61.06], 0: [1.5, -0.00005]}
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([("click", u, v) for u, vs in values.items() for v in vs], "event_type string, user_id long, value double").coalesce(1).write.parquet(path)
    got = {r.user_id: (r.score, r.baseline, r.delta) for r in queries.queries()["q_baseline_lookup"](spark, str(tmp_path)).collect()}
    events = f"(SELECT * FROM '{path}/*.parquet')"
    want = duckdb.sql(queries.oracle_sql()["q_baseline_lookup"].replace("FROM events", f"FROM {events} events")).fetchall()
    assert got == {u: (score, base, delta) for _, u, score, base, delta, _ in want} and len(got) == 4
