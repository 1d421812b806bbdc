import hashlib
import math

import pytest

from opinara.operators import augment, retrieval
from opinara.queries import queries


def test_style_seeds_against_a_loop(spark):
    plans = [("p1", "es", {"a": "x"}), ("p2", "en", {}), ("p3", "ca", {"a": "x"})]
    pool = [(f"k{i}", "es" if i % 3 else "en", {"a": "x" if i % 2 else "neutral"} if i % 5 else {}, float(i % 4)) for i in range(30)]
    got = {}
    rows = augment.style_seeds(
        spark.createDataFrame(plans, "plan string, language string, target map<string,string>"),
        spark.createDataFrame(pool, "key string, language string, gold map<string,string>, score double"), "plan", "key", k=3, keep=8,
    )
    for r in rows.collect():
        got.setdefault(r.plan, {})[r["rank"]] = r.key
    want = {}
    for plan, language, target in plans:
        fits = []
        for key, own, gold, score in pool:
            if own == language:
                shared, pairs = len(target.keys() & gold.keys()), len(target.items() & gold.items())
                fit = score + 3 * shared + 2 * pairs + any(v in ("neutral", "conflict") for v in gold.values()) - 0.2 * abs(len(target) - len(gold))
                fits.append((-round(max(fit, 0.01), 4), key))
        drawn = []
        for fit, key in sorted(fits)[:8]:
            u = int(hashlib.md5(f"{plan}|{key}".encode()).hexdigest()[:13], 16) / 2**52
            drawn.append((round(-math.log(max(u, 1e-12)) / -fit, 9), key))
        if drawn:
            want[plan] = dict(enumerate((k for _, k in sorted(drawn)[:3]), 1))
    assert got == want


def test_hard_mix(spark):
    bank = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, cand int, rank int")
    chosen = spark.createDataFrame([(1, 20, 1), (1, 11, 2), (1, 21, 3), (2, 30, 1)], "query_id int, cand int, rank int")
    got = sorted((r.query_id, r["rank"], r.cand, r.method) for r in retrieval.hard_mix(bank, chosen, 3).collect())
    # two of the bank, then the rest from most to least similar, each candidate once
    assert got == [(1, 1, 10, "bank"), (1, 2, 11, "bank"), (1, 3, 21, "mmr"), (2, 1, 30, "mmr")]


@pytest.mark.parametrize("blocks", [1, 3])
def test_style_seeds_of_train_rows_and_of_all_where_a_language_has_few(spark, tmp_path, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(augment, "ROW_CLASSES", 5)
        monkeypatch.setattr(augment, "PLAN_CLASSES", 2)
    gold = [{"food": "good"}, {"food": "neutral", "price": "bad"}, {}, {"service": "good", "food": "good"}]
    rows = [(i, "test" if i % 7 == 0 else "train", (["es"] * 6 + [None, "en"])[i % 8] if i < 96 else "ca", gold[i * 5 % 4]) for i in range(1, 98)]
    plans = [("a", "es", {"food": "good"}), ("b", None, {"price": "bad"}), ("c", "ca", {"food": "neutral"}), ("d", "ES", None), ("e", "en", {})]
    spark.createDataFrame(rows, "row_no long, split string, language string, gold map<string,string>").write.parquet(f"{tmp_path}/dataset.parquet")
    spark.createDataFrame([(*p, 1) for p in plans], "plan_id string, language string, target_gold map<string,string>, planned_at int").write.parquet(f"{tmp_path}/generation_plan.parquet")
    spark.createDataFrame([(7,)], "doc_id long").write.parquet(f"{tmp_path}/reading_anchor.parquet")
    got = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = queries()["q_style_seeds"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for r in found:
        got.setdefault(r.plan_id, {})[r["rank"]] = (r.key, r.relevance)
    want = {}
    for plan, language, target in plans:
        target = target or {}
        train = [(str(n), g) for n, split, own, g in rows if split == "train"]
        own = [(str(n), g) for n, split, own, g in rows if split == "train" and own == language]
        fits = []
        for key, g in own if len(own) >= 3 else train:
            fit = len(g) + 3 * len(target.keys() & g.keys()) + 2 * len(target.items() & g.items()) + any(v in ("neutral", "conflict") for v in g.values()) - 0.2 * abs(len(target) - len(g))
            fits.append((-round(max(fit, 0.01), 4), key))
        drawn = []
        for fit, key in sorted(fits)[:80]:
            u = int(hashlib.md5(f"{plan}|{key}".encode()).hexdigest()[:13], 16) / 2**52
            drawn.append((round(-math.log(max(u, 1e-12)) / -fit, 9), key, -fit))
        want[plan] = {i: x[1:] for i, x in enumerate(sorted(drawn)[:3], 1)}
    assert got == want and all(len(x) == 3 for x in got.values())
