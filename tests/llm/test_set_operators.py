import random
from itertools import combinations

import numpy as np
import pytest

from opinara.llm import p2_overlap, p6_sample, p7_groups, p8_packing, p9_mixing, setjoin

WORDS = [f"w{i}" for i in range(60)]


def _texts(n, seed):
    """Texts of which many share most of their words, with copies and hot words."""
    random.seed(seed)
    out = []
    for i in range(n):
        if out and random.random() < 0.5:
            w = random.choice(out).split()
            for _ in range(random.randrange(4)):
                w[random.randrange(len(w))] = random.choice(WORDS)
        else:
            w = [random.choice(WORDS[:12] if random.random() < 0.6 else WORDS) for _ in range(random.randrange(10, 30))]
        out.append(" ".join(w))
    return out


def _near(a, b, tau):
    x, y = set(a), set(b)
    return bool(x and y) and len(x & y) >= tau * len(x | y) - 1e-9


@pytest.mark.parametrize(("hot", "few", "ring"), [(1, 10_000, True), (4, 0, False), (2, 0, True), (1000, 10_000, True)])
def test_links_lose_nothing(spark, hot, few, ring):
    texts = _texts(150, hot)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    from pyspark.sql import functions as F

    members, links = setjoin.links(df, "k", "t", F.lit(3), lambda: str.split, 0.75, hot=hot, few=few, ring=ring, refine=hot != 4)
    cls = {r.rid: r.cls for r in members.collect()}
    assert all((cls[a] == cls[b]) == (set(texts[a].split()) == set(texts[b].split())) for a, b in combinations(cls, 2))
    want = {(a, b) for a, b in combinations(sorted(set(cls.values())), 2) if _near(texts[a].split(), texts[b].split(), 0.75)}
    rows = [(r.a, r.b) for r in links.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("hot", [1, 1000])
def test_long_records_lose_nothing(spark, hot):
    """Records of which many are cut into parts, around the sizes where the number of parts changes."""
    from pyspark.sql import functions as F

    random.seed(hot)
    words, texts = [f"v{i}" for i in range(400)], []
    for _ in range(40):
        base = random.sample(words, random.choice([40, 63, 80, 120, 127, 130, 160, 250, 260, 300]))
        texts.append(" ".join(base))
        for share in (0.05, 0.12, 0.14, 0.2):
            kept = [w for w in base if random.random() > share]
            texts.append(" ".join(kept + random.sample(words, random.randrange(1 + int(share * len(base))))))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    members, links = setjoin.links(df, "k", "t", F.lit(3), lambda: str.split, 0.75, hot=hot)
    cls = {r.rid: r.cls for r in members.collect()}
    want = {(a, b) for a, b in combinations(sorted(set(cls.values())), 2) if _near(texts[a].split(), texts[b].split(), 0.75)}
    assert len(want) > 50 and {(r.a, r.b) for r in links.collect()} == want


def test_keys_grow_with_the_length():
    """Keys of one record whose tokens are all frequent, and whose pairs are too."""
    levels, marks = np.full(1 << setjoin.BITS, 5000, np.uint16), np.ones(1 << setjoin.BITS, bool)
    rng = np.random.default_rng(1)

    def keys(n):
        return len(setjoin._keys(rng.integers(0, 1 << 63, n).astype(np.uint64), np.array([n]), levels, marks, 0.75, 100)[0])

    assert keys(5000) < 30 * 5000 and keys(20_000) < 6 * keys(5000)


def test_stock_sentence_splits_over_tasks(spark):
    """A class of copies that is a third of all rows is joined without a task of its own."""
    from opinara.plans.runtime import join_with_hot

    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id) k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").where("n > 1 or k % 2 = 0")
    got = join_with_hot(left, right, "k", "n", 100).collect()
    assert len(got) == 3000 and sum(r.n == 1000 for r in got) == 1000 and sum(r.n is None for r in got) == 1000


def test_split_overlap(spark):
    texts = _texts(120, 9) + [None, "", "short text", "short text"]
    splits = [random.choice(["train", "devel", "test"]) for _ in texts]
    df = spark.createDataFrame([(i, t, s, "src", 0) for i, (t, s) in enumerate(zip(texts, splits))], "row_no long, text string, split string, source string, cls int")
    members, links = p2_overlap.split_overlap(df)
    got = {tuple(r) for r in p2_overlap.overlap_pairs(members, links).collect()}
    ws = [(t or "").split() for t in texts]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if (splits[a] == "train") != (splits[b] == "train") and min(len(ws[a]), len(ws[b])) >= 12 and _near(ws[a], ws[b], 0.75)}
    assert got == want
    classes = {r.rid: r for r in p2_overlap.overlap_classes(members, links).collect()}
    assert {x for x, r in classes.items() if r.both or r.links} == {x for p in want for x in p} | {x for x, r in classes.items() if classes[r.cls].links}
    report = p2_overlap.overlap_report(df, members, links)
    hit = {x for a, b in want for x in (a, b) if splits[x] != "train"}
    assert sum(r.same + r.near for r in report.collect()) == len(hit)
    assert p2_overlap.overlap_pairs(*p2_overlap.split_overlap(df.limit(0))).count() == 0


def test_near_groups(spark):
    seeds = [["a", "b", "c"], ["c", "b", "a", "a"], ["a", "b", "c", "d"], ["x"], None, [], ["x", None], ["a", "b", "c", "d", "e"]]
    df = spark.createDataFrame([(f"p{i}", s, "e") for i, s in enumerate(seeds)] + [("p3", ["x"], "e"), (None, ["x"], "e")], "plan_id string, style_seed_ids array<string>, key string")
    groups = p7_groups.plan_groups(df)
    got = {tuple(r) for r in p7_groups.group_pairs(groups).collect()}
    chain = ["p0", "p1", "p2", "p7"]
    assert got == set(combinations(chain, 2)) | {("p3", "p6")}
    assert p7_groups.group_pairs(p7_groups.plan_groups(df.limit(0))).count() == 0


def test_calibration_reaches_overlapping_targets():
    member = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1], [0, 1, 0]], float)
    counts = np.array([50.0, 80, 70, 40])
    p = p6_sample.calibrate(counts, member, np.array([30.0, 40, 25]), 0.3)
    assert np.allclose((counts * p) @ member, [30, 40, 25], atol=1e-6)
    p = p6_sample.calibrate(np.array([5.0, 100]), np.eye(2), np.array([5.0, 20]), 0.3)
    assert np.allclose(p, [1, 0.2])


def test_pivotal_keeps_sizes_and_chances(spark):
    units = spark.createDataFrame([("a", f"u{i}", 0.3) for i in range(9000)] + [("b", "v", 1.0), ("b", "w", 0.0)], "cell string, unit string, p double")
    got = p6_sample.pivotal(units, 9000, 1)
    n = {r.cell: r["count"] for r in got.groupBy("cell").count().collect()}
    assert n == {"a": 2700, "b": 1} and got.distinct().count() == 2701


def test_quota_sample(spark):
    quota = spark.createDataFrame([("q1", "A", "es", 1, 0.5, 2), ("q2", "b", "en", 0, 0.5, 30), ("q3", "c", "en", 0, 0.0, 1)], "quota_id string, bucket string, language string, gold_labels int, target_share double, min_rows int")
    rows = [(f"p{i}", " a ", "ES", {"x": "y"}, 0) for i in range(40)] + [(f"r{i}", "B", "en", {}, 0) for i in range(20)] + [("r0", "B", "en", {}, 0), ("n", None, "en", {}, 0), (None, "b", "en", {}, 0), ("m", "b", "en", None, 0)]
    plans = spark.createDataFrame(rows, "plan_id string, bucket string, language string, target_gold map<string,string>, quota_id int")
    sample, report = p6_sample.quota_sample(plans, quota)
    got = {r.quota_id: (r.available, r.drawn, r.short) for r in report.collect()}
    # 62 units, a quarter is 15; the floors are 20, as far as the units of q2 go, and 2
    assert got == {"q1": (40, 2, False), "q2": (20, 20, True), "q3": (0, 0, True)}
    assert sample.count() == sum(g[1] for g in got.values())
    # every category has a floor above 0
    assert p6_sample.quota_sample(plans.limit(0), quota)[1].where("short").count() == 3


def test_sample_has_its_size_and_margins(spark):
    """Floors are kept, the size is exact, shares of buckets and languages are met although one cell can't give its part."""
    random.seed(6)
    cells = [(b, lang, g) for b in "abc" for lang in ("es", "en") for g in (0, 1)]
    plans, i = [], 0
    for c in cells:
        for _ in range(5 if c == ("a", "es", 0) else random.randrange(150, 400)):
            plans.append((f"p{i}", c[0], c[1], {"x": "y"} if c[2] else {}))
            i += 1
    shares = {c: 0.02 if c[0] == "c" else 0.115 for c in cells}
    quota = [(f"q{k}", *c, shares[c], 25 if c[0] == "c" else 3) for k, c in enumerate(cells)]
    sample, report = p6_sample.quota_sample(spark.createDataFrame(plans, "plan_id string, bucket string, language string, target_gold map<string,string>"), spark.createDataFrame(quota, "quota_id string, bucket string, language string, gold_labels int, target_share double, min_rows int"))
    n = len(plans) // 4
    assert sample.count() == n
    rows = {r.quota_id: r for r in report.collect()}
    assert [q for q, r in sorted(rows.items()) if r.short] == ["q0"]
    assert all(rows[q].drawn >= min(f, rows[q].available) for q, _, _, _, _, f in quota)
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9
    by = lambda place, v: sum(rows[q[0]].share for q in quota if q[place] == v)
    # the floors of c take more than its share; a and b are even, and so are the languages
    assert abs(by(1, "a") - by(1, "b")) < 0.02 and abs(by(2, "es") - 0.5) < 0.02 and abs(by(3, 0) - 0.5) < 0.02


def test_plan_is_best_fit_decreasing():
    random.seed(2)
    for capacity in (10, 37, 100):
        items = [random.randint(1, capacity) for _ in range(300)] + [7] * 100
        histogram = {n: items.count(n) for n in items}
        slots, opened = p8_packing.plan(histogram, capacity)
        load = [0] * opened
        ranks = {n: [] for n in histogram}
        for length, first, last, start, each in slots:
            for r in range(first, last):
                load[start + (r - first) // each] += length
                ranks[length].append(r)
        assert max(load) <= capacity and min(load) > 0
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
        # the same number of containers as item by item
        bins = []
        for n in sorted(items, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(capacity - n)
            else:
                bins[fit] -= n
        assert opened == len(bins)


@pytest.mark.parametrize("small", [0, 1000])
def test_pack(spark, small):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([None, "", "hola", "uno dos tres " * 40, "x y", "x y", "a " * 3000])], "doc_id long, text string, part int")
    specs = spark.createDataFrame([("s", 16), ("t", 64), ("none", None), ("zero", 0)], "spec_name string, capacity_tokens long")
    packed = p8_packing.pack(docs, specs, small=small)
    rows = packed.collect()
    for spec, cap in (("s", 16), ("t", 64)):
        own = [r for r in rows if r.spec_name == spec]
        assert {r.doc_id for r in own} == set(range(7))
        load = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= cap and load.get(None) == 0
    assert {r.overfull for r in p8_packing.fill_report(packed, specs).collect()} == {0}
    assert p8_packing.pack(docs.limit(0), specs).count() == 0 == p8_packing.pack(docs, specs.limit(0)).count()


@pytest.mark.parametrize("small", [0, 1000])
def test_one_length_of_most_items(spark, monkeypatch, small):
    """Ranks in several parts and blocks of ranks fill the same containers."""
    monkeypatch.setattr(p8_packing, "RANKED", 50)
    monkeypatch.setattr(p8_packing, "BLOCK", 30)
    docs = spark.range(700).selectExpr("id doc_id", "if(id % 7 = 0, repeat('uno ', cast(id % 40 as int)), 'hola') text")
    packed = p8_packing.pack(docs, spark.createDataFrame([("s", 16), ("s", 99)], "spec_name string, capacity_tokens long"), small=small)
    report = p8_packing.fill_report(packed, spark.createDataFrame([("s", 16)], "spec_name string, capacity_tokens long")).first()
    assert packed.select("doc_id").distinct().count() == 700 and report.overfull == 0 and report.fill > 0.95


def test_sainte_lague_against_one_by_one():
    random.seed(4)
    for _ in range(30):
        w = {f"s{i}": random.random() for i in range(6)}
        caps = {s: random.randrange(60) for s in w}
        seats = random.randrange(200)
        got = dict.fromkeys(w, 0)
        for _ in range(seats):
            free = [s for s in w if got[s] < caps[s]]
            if not free:
                break
            got[min(free, key=lambda s: (-w[s] / (2 * got[s] + 1), s))] += 1
        assert p9_mixing.sainte_lague(w, caps, seats) == got


def test_shard_quotas(spark):
    random.seed(8)
    per = [("a", i, random.randrange(1, 40)) for i in range(60)] + [("b", 0, 5)]
    whole = sum(n for s, _, n in per if s == "a")
    for group in (1, 7, 4096):
        got = p9_mixing.shard_quotas(spark.createDataFrame(per, "source string, shard int, n long"), spark.createDataFrame([("a", 777, whole), ("b", 15, 5)], "source string, quota long, whole long"), group).collect()
        n = {(s, i): k for s, i, k in per}
        q = {(r.source, r.shard): r.rounds * n[r.source, r.shard] + r.more for r in got}
        assert sum(v for k, v in q.items() if k[0] == "a") == 777 and q["b", 0] == 15
        assert all(abs(v - 777 * n[k] / whole) < 1 for k, v in q.items() if k[0] == "a")


def test_mix(spark):
    docs = spark.createDataFrame([(i, "uno dos tres cuatro " * 10, s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 10 + [None] * 5)] + [(900, None, "a", 0)], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed, report = p9_mixing.mix(docs, targets, block_tokens=100, shard_tokens=2000)
    r = {x.source: x for x in report.collect()}
    assert r["gone"].documents == 0 and r["c"].mixed_tokens == 0 and r["b"].repeats <= 2 and r["a"].repeats <= 1
    assert abs(r["a"].share - 5 / 9) < 0.03 and abs(r["b"].share - 4 / 9) < 0.03
    assert mixed.groupBy("source").agg({"copies": "max"}).where("source = 'b'").first()[1] <= 2
    assert p9_mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_found_records_are_in_no_broadcast_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    # a broadcast join would build its hash table of up to ``few`` records on the driver
    sent, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or plain(df))
    df = spark.createDataFrame(list(enumerate(_texts(150, 3))), "k long, t string")
    found = [{tuple(r) for r in setjoin.links(df, "k", "t", F.lit(3), lambda: str.split, 0.75, few=few, refine=refine)[1].collect()} for few in (0, 10_000) for refine in (True, False)]
    assert found[0] and all(x == found[0] for x in found)
    assert ["rid"] not in sent


@pytest.mark.parametrize(("hot", "few", "ring"), [(1, 10_000, False), (4, 0, True), (1000, 10_000, False)])
def test_links_across_lose_nothing(spark, monkeypatch, hot, few, ring):
    from pyspark.sql import functions as F

    monkeypatch.setattr(setjoin, "AT_ONCE", 7)
    texts = _texts(150, hot)
    random.seed(hot)
    long = [f"v{i}" for i in range(300)]
    for _ in range(20):
        base = random.sample(long, random.choice([63, 127, 130, 250]))
        texts += [" ".join(base), *(" ".join([w for w in base if random.random() > share] + random.sample(long, 3)) for share in (0.05, 0.12, 0.2))]
    df = spark.createDataFrame([(i, t, random.choice([1, 2])) for i, t in enumerate(texts)], "k long, t string, r int")
    members, links = setjoin.links(df, "k", "t", F.col("r"), lambda: str.split, 0.75, across=True, hot=hot, few=few, ring=ring, refine=hot == 4)
    roles = {r.cls: r.roles for r in members.collect()}
    want = {(a, b) for a, b in combinations(sorted(roles), 2) if (roles[a] | roles[b]) == 3 and _near(texts[a].split(), texts[b].split(), 0.75)}
    rows = [(r.a, r.b) for r in links.collect()]
    assert want and len(rows) == len(set(rows)) and set(rows) == want


def test_stock_key_makes_no_pairs(spark):
    """Rows of one key in 40000 records: none has it early enough to look for others, so no pair is formed, and a few that have are held against the other role only."""
    from pyspark.sql import functions as F

    n = 40_000
    posted = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("rid"), F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"), F.lit(60).alias("size"),
                                   F.when(F.col("id") < 2, F.lit(60 << 32)).otherwise(F.lit((60 << 32) | 14)).cast("long").alias("local"), (F.col("id") % 2 + 1).cast("int").alias("role"))
    assert {tuple(r) for r in setjoin._met(posted, 0.75, False).collect()} == {(0, 1)}
