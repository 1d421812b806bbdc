"""Checks of candidates over small tables, against a loop."""

import random
import re

from opinara.functions.schema import BUCKET_QUOTAS
from opinara.queries import queries


def _set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similarity_is_with_train_and_devel(spark, tmp_path):
    base = "the soup was warm and the bread was fresh that evening"
    refs = [(1, "train", base), (2, "devel", "we waited long for a table near the old bridge"), (3, "test", "nothing here was as good as people had told us"), (4, "train", None), (5, "train", "too short")]
    made = [base, base + " again and again", "we waited long for a table near the door", "nothing here was as good as people had told us", "no", None]
    spark.createDataFrame(refs, "row_no long, split string, text string").write.parquet(f"{tmp_path}/dataset.parquet")
    spark.createDataFrame([(f"s{i}", i, t) for i, t in enumerate(made)], "id string, accepted_at int, text string").write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    spark.createDataFrame([(1, made[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.plan_key: r.max_sim for r in queries()["q_reference_similarity"](spark, str(tmp_path)).collect()}
    assert got == {i: round(max(_jaccard(_set(t), _set(x)) for _, split, x in refs if split != "test"), 4) for i, t in enumerate(made, 1)}


def test_all_rules_in_order(spark, tmp_path):
    random.seed(4)
    word = [f"w{i}" for i in range(60)]
    stock = " the waiter had told us about this place and its terrace"
    texts = [" ".join(random.choice(word) for _ in range(14)) + stock for _ in range(12)]
    refs = [(i, ["train", "devel", "test"][i % 3], t) for i, t in enumerate(texts)]
    made = []
    for _ in range(70):
        w = random.choice(texts[:3] + [m for m in made[-25:]] * 2 + [" ".join(random.choice(word) for _ in range(14)) + stock]).split()
        for _ in range(random.choice([0, 1, 2, 5])):
            w[random.randrange(len(w))] = random.choice(word)
        made.append(" ".join(w))
    made += ["too short here", "too short here", "Too  Short here", texts[0].upper()]
    rows = [(f"s{i:03}", "es" if i % 9 else "en", t, {}, "b", "p", i) for i, t in enumerate(made)]
    schema = "id string, language string, text string, gold map<string,string>, bucket string, plan_id string, accepted_at int"
    spark.createDataFrame([*rows, (*rows[5][:6], 500)], schema).write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    spark.createDataFrame(refs, "row_no long, split string, text string").write.parquet(f"{tmp_path}/dataset.parquet")
    spark.createDataFrame([("p", "es", 1, 99, {}, 1)], "plan_id string, language string, min_words int, max_words int, target_gold map<string,string>, planned_at int").write.parquet(f"{tmp_path}/generation_plan.parquet")
    known = [t for _, split, t in refs if split != "test"]
    norms, accepted, want = {" ".join(t.lower().split()) for t in known}, [], {}
    for key, language, t, *_ in rows:
        if language != "es":
            want[key] = "language mismatch"
        elif " ".join(t.lower().split()) in norms:
            want[key] = "exact duplicate text"
        elif any(_jaccard(_set(t), _set(x)) > 0.55 for x in known):
            want[key] = "too similar to train or devel"
        elif any(_jaccard(_set(t), _set(x)) > 0.62 for x in accepted):
            want[key] = "too similar to accepted"
        else:
            want[key] = None
            accepted.append(t)
            norms.add(" ".join(t.lower().split()))
    found = queries()["q_candidate_reasons"](spark, str(tmp_path)).collect()
    assert {r.id: r.reason for r in found} == want and len(found) == len(rows) + 1
    assert len(set(want.values())) == 5
    counts = {r.reason: r.n for r in queries()["q_candidate_report"](spark, str(tmp_path)).collect()}
    assert counts == {x: sum(r.reason == x for r in found) for x in set(want.values()) - {None}}


def test_shortfall_counts_all_accepted_rows(spark, tmp_path):
    (full, quota), (short, want) = list(BUCKET_QUOTAS.items())[:2]
    rows = [(full, f"2024-{1 + i % 9}-01") for i in range(quota)] + [(short, "2024-08-01")] * (want - 3)
    spark.createDataFrame(rows, "bucket string, t string").selectExpr("bucket", "cast(t as timestamp) accepted_at").write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    got = {r.bucket: (r.have, r.missing, r.plans) for r in queries()["q_plan_shortfall"](spark, str(tmp_path)).collect()}
    assert got[full] == (quota, 0, 0) and got[short] == (want - 3, 3, 5)


def test_acceptance_is_limited_at_062(spark, tmp_path):
    w = [f"w{i}" for i in range(40)]
    made = [" ".join(w[:24]), " ".join(w[:12] + w[20:32]), " ".join(w[:20] + w[28:36]), " ".join([*w[:23], "x"]), None]
    spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(made)], "id string, text string").write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    sets = [_set(t) for t in made]
    assert 0.3 < _jaccard(sets[0], sets[2]) < 0.62 < _jaccard(sets[0], sets[3])
    got = {r.id: r.accepted for r in queries()["q_greedy_acceptance"](spark, str(tmp_path)).collect()}
    assert got == {"s0": True, "s1": True, "s2": True, "s3": False, "s4": True}


def test_highest_similarity_in_blocks(spark, tmp_path, monkeypatch):
    from opinara.operators import similarity

    # stock sentences that most texts have: pairs that meet aren't written, and blocks of candidates are
    written, plain = [], similarity._best
    monkeypatch.setattr(similarity, "BLOCK", 400)
    monkeypatch.setattr(similarity, "_best", lambda reference, block: written.append(block.num_rows) or plain(reference, block))
    random.seed(9)
    word = [f"w{i}" for i in range(40)]
    stock = [" ".join(random.choice(word) for _ in range(7)) for _ in range(12)]
    make = lambda: " ".join([*random.sample(stock, random.randrange(4)), *(random.choice(word) for _ in range(random.randrange(12)))])
    made, docs = [make() for _ in range(80)] + [None, "too short"], [make() for _ in range(90)] + [None, stock[0]]
    made += made[:5]
    spark.createDataFrame([(f"s{i:03}", i, t) for i, t in enumerate(made)], "id string, accepted_at int, text string").write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.plan_key: r.max_sim for r in queries()["q_ngram_max_similarity"](spark, str(tmp_path)).collect()}
    assert got == {i: round(max(_jaccard(_set(t), _set(x)) for x in docs), 4) for i, t in enumerate(made, 1)}
    assert len(written) > 1 and len(set(got.values())) > 20


def test_reference_similarity_writes_no_pairs(spark, tmp_path):
    # all texts share a stock sentence: the pairs that meet on it, 90,000, stay out of every shuffle and join
    stock = " we had heard about this place from a friend of ours"
    refs = [(i, ["train", "devel"][i % 2], f"a{i} b{i} c{i} d{i} e{i}{stock}") for i in range(300)]
    made = [f"x{i} y{i} z{i}{stock}" for i in range(299)] + [refs[7][2]]
    spark.createDataFrame(refs, "row_no long, split string, text string").write.parquet(f"{tmp_path}/dataset.parquet")
    spark.createDataFrame([(f"s{i:03}", i, t) for i, t in enumerate(made)], "id string, accepted_at int, text string").write.parquet(f"{tmp_path}/synthetic_v1.parquet")
    found = queries()["q_reference_similarity"](spark, str(tmp_path))
    got = {r.plan_key: r.max_sim for r in found.collect()}
    assert got == {i: round(max(_jaccard(_set(t), _set(x)) for _, _, x in refs), 4) for i, t in enumerate(made, 1)}
    assert "Generate explode" not in found._jdf.queryExecution().toString()


def test_sets_are_not_moved_to_be_found_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from opinara.operators import similarity

    texts = [f"a{i} b c d e f{i % 5} g h" for i in range(30)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    found = similarity.highest(df, df, "k", F.split("t", " "))
    assert [r.m for r in found.orderBy("k").collect()] == [1.0] * 60
    # the joins that hand the results back move numbers only, no arrays of elements
    assert "hashpartitioning(g#" not in found._jdf.queryExecution().executedPlan().toString()
