"""Difficulty of examples, plans for new ones, and the checks a candidate has to pass."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.arith import md5_uniform, rarity
from opinara.functions.schema import BUCKET_QUOTAS, MARKUP, PRIORITY_WEIGHTS, TASK_MARKERS
from opinara.functions.text import contains_any, normalize, word_count, words
from opinara.operators import similarity
from opinara.plans.runtime import cut, global_rank


def _priority(aspect: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, aspect), F.lit(0.0))


def difficulty(df: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """key, missing, wrong, extra, score: 2 missing + 1.5 wrong + extra + rarity of the expected pairs + 0.3 priority.

    Pair counts are a few rows (aspects times polarities) and go to all tasks as a literal-sized broadcast.
    """
    counts = df.select(F.explode(expected).alias("aspect", "polarity")).groupBy("aspect", "polarity").agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "aspect", "polarity"), "n"))).alias("seen"))
    none = F.create_map().cast("map<string,string>")
    g, p = F.coalesce(expected, none), F.coalesce(predicted, none)
    missing = F.size(F.array_except(F.map_keys(g), F.map_keys(p)))
    extra = F.size(F.array_except(F.map_keys(p), F.map_keys(g)))
    wrong = F.size(F.filter(F.map_entries(g), lambda e: F.coalesce(F.try_element_at(p, e["key"]) != e["value"], F.lit(False))))
    rare = F.aggregate(F.map_entries(g), F.lit(0.0), lambda s, e: s + rarity(F.coalesce(F.try_element_at("seen", F.concat_ws("|", e["key"], e["value"])), F.lit(0))))
    priority = F.aggregate(F.map_keys(g), F.lit(0.0), lambda s, a: s + _priority(a))
    return df.join(F.broadcast(table)).select(key, missing.alias("missing"), wrong.alias("wrong"), extra.alias("extra"), F.round(2.0 * missing + 1.5 * wrong + extra + rare + 0.3 * priority, 4).alias("score"))


def difficulty_without_predictions(df: DataFrame, key: str, expected: str) -> DataFrame:
    """key, score: rarity (from 2.5) + priority + number of neutral and conflict labels."""
    counts = df.select(F.explode(expected).alias("aspect", "polarity")).groupBy("aspect", "polarity").agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "aspect", "polarity"), "n"))).alias("seen"))
    entries = F.coalesce(F.map_entries(expected), F.array().cast("array<struct<key:string,value:string>>"))
    score = F.aggregate(entries, F.lit(0.0), lambda s, e: s + rarity(F.coalesce(F.try_element_at("seen", F.concat_ws("|", e["key"], e["value"])), F.lit(0)), 2.5) + _priority(e["key"]) + e["value"].isin("neutral", "conflict").cast("double"))
    return df.join(F.broadcast(table)).select(key, F.round(score, 4).alias("score"))


def hardest(scored: DataFrame, labels: Column, k: int = 30) -> DataFrame:
    """The k examples with most errors, then highest score, then most labels; examples without errors are left out."""
    errors = F.col("missing") + F.col("wrong") + F.col("extra")
    return scored.withColumns({"errors": errors, "labels": labels}).where("errors > 0").orderBy(F.desc("errors"), F.desc("score"), F.desc("labels"), scored.columns[0]).limit(k)


def within_quota(rows: DataFrame, bucket: str, order: list[str], quotas: dict[str, int] = BUCKET_QUOTAS) -> DataFrame:
    """The first rows of each bucket up to its quota, in order."""
    table = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(bucket).orderBy(*order)
    # the rank limit of a bucket is at most the largest quota, which bounds what the window passes on
    first = rows.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= max(quotas.values()))
    return first.where(F.col("seq") <= F.try_element_at(table, F.col(bucket)))


def shortfall(accepted: DataFrame, bucket: str, multiplier: float = 1.5, quotas: dict[str, int] = BUCKET_QUOTAS) -> DataFrame:
    """bucket, quota, have, missing, plans: what each bucket lacks, and how many plans to make for it."""
    have = accepted.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("have"))
    table = accepted.sparkSession.createDataFrame(list(quotas.items()), "bucket string, quota int")
    missing = F.greatest(F.col("quota") - F.coalesce("have", F.lit(0)), F.lit(0))
    return table.join(have, "bucket", "left").select("bucket", "quota", F.coalesce("have", F.lit(0)).alias("have"), missing.cast("long").alias("missing"), F.ceil(missing * multiplier).alias("plans"))


def language_sequence(n: int, share: float = 0.675) -> tuple[int, int]:
    """Rows in the first and in the second language."""
    first = round(n * share)
    return first, n - first


def weighted_sample(rows: DataFrame, key: str, weight: Column, k: int, seed: int, floor: float = 0.001) -> DataFrame:
    """k rows without replacement, chances by weight: the least exponential keys."""
    u = F.greatest(md5_uniform(F.lit(str(seed)), F.col(key).cast("string")), F.lit(1e-12))
    return rows.withColumn("_k", -F.log(u) / F.greatest(weight, F.lit(floor))).orderBy("_k", key).limit(k).drop("_k")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with position, their place in a repeatable random order, numbered range by range."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return global_rank(rows, [digest, key], "position")


#: Classes of rows, and of plans, that one task of style_seeds compares at a time.
ROW_CLASSES, PLAN_CLASSES = 8192, 2048


def style_seeds(plans: DataFrame, pool: DataFrame, plan: str, key: str, k: int = 3, keep: int = 80, fallback: bool = False) -> DataFrame:
    """plan, key, relevance, rank: seeds of each plan by how well a row fits, without the counter of earlier uses.

    plans has plan, language, target (map); pool has key, language, gold (map), score. Plans and rows meet on the
    language; relevance is score + 3 for each shared aspect + 2 for each shared pair + 1 for a neutral or conflict
    label - 0.2 for each label that differs in number, at least 0.01. With fallback, a missing language is a language
    too, and plans whose language has fewer than k rows choose among all rows.

    What fits depends on gold and score alone, so classes of plans meet classes of rows, in blocks. The first keep rows
    by relevance and key stand in the first keep classes by relevance and least key; a block passes on no others.
    """
    tag = F.coalesce(F.concat(F.lit("="), "language"), F.lit("null"))
    p, r = plans.withColumn("tag", tag), pool.withColumn("tag", tag)
    if fallback:
        enough = r.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("tag", F.lit(True).alias("enough"))
        p = p.join(F.broadcast(enough), "tag", "left").withColumn("tag", F.when(F.col("enough"), F.col("tag")).otherwise("all"))
        r = r.withColumn("tag", F.explode(F.array("tag", F.lit("all"))))
    else:
        p, r = p.where("language is not null"), r.where("language is not null")
    p = p.select(F.col(plan).alias("plan"), "tag", F.array_sort(F.map_entries("target")).alias("t"))
    r = r.select(F.col(key).alias("key"), "tag", F.array_sort(F.map_entries("gold")).alias("g"), F.col("score").cast("double").alias("score"))
    same = Window.partitionBy("tag", "g", "score").orderBy("key")
    members = r.withColumns({"n": F.row_number().over(same), "first": F.first("key").over(same)}).where(F.col("n") <= keep)
    rows, kinds = members.where("n = 1").select("tag", "first", "g", "score"), p.groupBy("tag", "t").agg(F.min("plan").alias("kind"))
    row_blocks, plan_blocks = -(-rows.count() // ROW_CLASSES) or 1, -(-kinds.count() // PLAN_CLASSES) or 1

    def blocks(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    def sides(entries: str) -> list[Column]:
        return [F.transform(entries, lambda e: e["key"]).alias("aspects"), F.transform(entries, lambda e: F.concat(e["key"], F.lit("\0"), F.coalesce(e["value"], F.lit("")))).alias("pairs")]

    odd = F.exists("g", lambda e: F.coalesce(e["value"].isin("neutral", "conflict"), F.lit(False))).cast("double")
    left = blocks(kinds.select("tag", "kind", *sides("t")), "pb", plan_blocks, "rb", row_blocks)
    right = blocks(rows.select("tag", "first", (F.col("score") + odd).alias("base"), *sides("g")), "rb", row_blocks, "pb", plan_blocks)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        import numpy as np

        b = b.sort_by("first")
        asked, held = ([x + y for x, y in zip(t["aspects"].to_pylist(), t["pairs"].to_pylist(), strict=True)] for t in (a, b))
        index = {v: j for j, v in enumerate({v for x in asked for v in x})}

        def hot(labels: list[list[str]], shared: int, pair: int) -> np.ndarray:
            out = np.zeros((len(labels), len(index)), np.float32)
            for i, x in enumerate(labels):
                for v in x:
                    if v in index:
                        out[i, index[v]] = pair if "\0" in v else shared
            return out

        of, ours = hot(asked, 3, 2), hot(held, 1, 1).T.copy()
        many_a, many_b = (np.array([len(x) / 2 for x in side]) for side in (asked, held))
        base, place, n = b["base"].to_numpy(), np.arange(len(b), 0, -1), min(keep, len(b))
        at, of_row, fits = [], [], []
        for i in range(0, len(a) if n else 0, 256):
            fit = of[i : i + 256] @ ours + base - 0.2 * np.abs(many_a[i : i + 256, None] - many_b)
            fit = np.floor(np.maximum(fit, 0.01) * 10_000 + 0.5).astype(np.int64)
            top = np.argpartition(-(fit * (len(b) + 1) + place), n - 1, axis=1)[:, :n]
            at.append(np.repeat(np.arange(i, i + len(fit)), n))
            of_row.append(top.ravel())
            fits.append(np.take_along_axis(fit, top, 1).ravel() / 10_000)
        take = lambda t, column, places: t[column].combine_chunks().take(pa.array(np.concatenate(places) if places else [], pa.int64()))
        return pa.table({"tag": take(a, "tag", at), "kind": take(a, "kind", at), "first": take(b, "first", of_row), "relevance": pa.array(np.concatenate(fits) if fits else [], pa.float64())})

    met = ["tag", "pb", "rb"]
    found = left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(best, f"tag string, kind {dict(kinds.dtypes)['kind']}, first {dict(rows.dtypes)['first']}, relevance double")
    first = lambda by: F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("relevance"), by))
    near = found.withColumn("n", first("first")).where(F.col("n") <= keep).drop("n").join(members.select("tag", "first", "key"), ["tag", "first"])
    near = near.withColumn("n", first("key")).where(F.col("n") <= keep).select("kind", "key", "relevance")
    named = p.join(kinds, ["tag", "t"]).select("plan", "kind")
    u = F.greatest(md5_uniform(F.col("plan"), F.col("key")), F.lit(1e-12))
    drawn = named.join(near, "kind").withColumn("e", F.round(-F.log(u) / F.col("relevance"), 9))
    return drawn.withColumn("rank", F.row_number().over(Window.partitionBy("plan").orderBy("e", "key"))).where(F.col("rank") <= k).select(F.col("plan").alias(plan), F.col("key").alias(key), "relevance", "rank")


def reject_reason(text: Column, language: Column, wanted: Column, least: Column, most: Column, gold: Column, target: Column) -> Column:
    """First rule that a candidate breaks, of those that need no other row; null if none."""
    from opinara.operators.metrics import same_map

    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    n = word_count(plain)
    return (
        F.when(~F.coalesce(language == wanted, F.lit(False)), "language mismatch")
        .when(F.coalesce(plain, F.lit("")) == "", "empty text")
        .when(contains_any(F.lower(plain), TASK_MARKERS), "annotation language leaked")
        .when(contains_any(plain, MARKUP), "markup leaked")
        .when(~n.between(least, most), "word count outside range")
        .when(~same_map(gold, target), "gold mismatch")
    )


def reject_reason_in_order(rows: DataFrame, reference: DataFrame, key: str, other: str, reason: str, text: str, grams: str, most_reference: float = 0.55, most_accepted: float = 0.62) -> DataFrame:
    """key, reason: the reason of each candidate, with those that need other rows after those it has.

    A candidate without a reason so far is an exact duplicate of a reference text or of an accepted one before it, more
    than most_reference similar to a reference text, or more than most_accepted to an accepted one before it, in order
    of key. reference has other, text and grams.
    """
    left = cut(rows.where(F.col(reason).isNull()).select(key, text, grams))
    copies = duplicate_of(left, reference, text).select(key, F.lit("exact duplicate text").alias("r0"))
    similar = similar_pairs(left, reference, key, other, grams, most_reference).select(F.col("x").alias(key), F.lit("too similar to train or devel").alias("r1")).distinct()
    told = cut(left.join(copies, key, "left").join(similar, key, "left").withColumn("r", F.coalesce("r0", "r1")))
    open_ = told.where("r is null").withColumn("_n", normalize(F.col(text)))
    near = similar_pairs(open_, open_, key, key, grams, most_accepted).where("x < y")
    # of equal texts the first one decides: where it isn't accepted, a similar text before it stands before the others too
    first = open_.where("_n is not null").groupBy("_n").agg(F.min(key).alias("x"))
    same = open_.join(first, "_n").where(F.col(key) > F.col("x")).select("x", F.col(key).alias("y"))
    settled = accept_in_order(open_, key, near.unionByName(same).distinct()).where("not accepted")
    kept = settled.join(same.select(F.col("y").alias(key), F.col("x").alias("first")), key, "left").join(settled.select(F.col(key).alias("first"), F.lit(True).alias("gone")), "first", "left")
    late = kept.select(key, F.when(F.col("first").isNotNull() & F.col("gone").isNull(), "exact duplicate text").otherwise("too similar to accepted").alias("r2"))
    later = told.select(key, "r").join(late, key, "left").select(key, F.coalesce("r", "r2").alias("_r"))
    return rows.select(key, reason).join(later, key, "left").select(key, F.coalesce(reason, "_r").alias(reason))


def max_similarity(candidates: DataFrame, reference: DataFrame, key: str, text: str) -> DataFrame:
    """key, max_sim: the highest Jaccard similarity of the set of word 5-grams of each candidate's text with that of any reference text; 0 where they share none."""
    best = similarity.highest(candidates, reference, key, words(normalize(F.col(text))))
    return candidates.select(key).join(best, key, "left").select(key, F.coalesce("m", F.lit(0.0)).alias("max_sim"))


def duplicate_of(candidates: DataFrame, reference: DataFrame, text: str) -> DataFrame:
    """Candidates whose normalised text stands in the reference. Rows meet on the text's hash and then on the text."""
    n = normalize(F.col(text))
    ref = reference.select(n.alias("_n")).where("_n is not null").distinct()
    return candidates.withColumn("_n", n).join(ref, "_n", "left_semi").drop("_n")


def similar_pairs(rows: DataFrame, reference: DataFrame, key: str, other: str, grams: str, limit: float) -> DataFrame:
    """x, y: pairs of a row and a reference row whose n-gram sets are more than limit (above 0) similar.

    Two sets over the limit share a gram among the first n - ceil(limit n) + 1 of each in any common order; the rows meet
    on those and are then compared whole. The order is by frequency in a sample of the rows, rarest first, which keeps
    stock grams out of the join; how good the sample is decides the work, not the result.
    """
    sample = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(16)) == 0).select(grams).unionByName(reference.where(F.pmod(F.xxhash64(F.col(other)), F.lit(16)) == 0).select(grams))
    counts = sample.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "g").limit(1 << 16).collect()
    often = {r.g: r.n for r in counts}

    def first(df: DataFrame, k: str, name: str) -> DataFrame:
        def run(batches):
            for b in batches:
                places, found, sizes = [], [], []
                for i, g in enumerate(b.column(1).to_pylist()):
                    n = len(g or ())
                    for x in sorted(g, key=lambda v: (often.get(v, 0), v))[: n - math.ceil(limit * n - 1e-9) + 1] if n else ():
                        places.append(i)
                        found.append(x)
                        sizes.append(n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array(found, b.column(1).type.value_type), pa.array(sizes, pa.int32())], names=[name, "g", "n" + name])

        kept = df.select(k, grams)
        return kept.mapInArrow(run, f"{name} {kept.dtypes[0][1]}, g {kept.dtypes[1][1][6:-1]}, n{name} int")

    near = first(rows, key, "x").join(first(reference, other, "y"), "g").where(F.least("nx", "ny") > F.greatest("nx", "ny") * (limit - 1e-9)).select("x", "y").distinct()
    whole = near.join(rows.select(F.col(key).alias("x"), F.col(grams).alias("gx")), "x").join(reference.select(F.col(other).alias("y"), F.col(grams).alias("gy")), "y")
    both = F.size(F.array_intersect("gx", "gy"))
    return whole.withColumn("both", both).where(F.col("both") / (F.size("gx") + F.size("gy") - F.col("both")) > limit).select("x", "y")


def accept_in_order(candidates: DataFrame, key: str, near: DataFrame) -> DataFrame:
    """key, accepted: candidates in order of key, each accepted unless a pair (x, y) of near, x before y, has an accepted x.

    What depends on the order is settled on those pairs alone: in each round, a candidate all of whose earlier
    neighbours are settled is settled too.
    """
    near = cut(near)
    open_, out = cut(near.select(F.explode(F.array("x", "y")).alias(key)).distinct()), None
    edges = near
    while not edges.isEmpty():
        # those without an earlier open neighbour are accepted, their later neighbours are not
        accepted = open_.join(edges.select(F.col("y").alias(key)).distinct(), key, "left_anti")
        refused = edges.join(accepted, edges["x"] == accepted[key]).select(F.col("y").alias(key)).distinct()
        done = cut(accepted.select(key, F.lit(True).alias("accepted")).unionByName(refused.select(key, F.lit(False).alias("accepted"))))
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(done, key, "left_anti"))
        gone = done.select(key)
        edges = cut(edges.join(gone, edges["x"] == gone[key], "left_anti").join(gone, edges["y"] == gone[key], "left_anti"))
    settled = candidates.select(key) if out is None else candidates.select(key).join(out, key, "left")
    return settled.select(key, F.coalesce("accepted", F.lit(True)).alias("accepted") if out is not None else F.lit(True).alias("accepted"))


def accept_greedily(candidates: DataFrame, key: str, grams: str, limit: float = 0.62) -> DataFrame:
    """key, accepted: candidates in order of key, each accepted unless too similar to an accepted one before it."""
    near = similar_pairs(candidates, candidates, key, key, grams, limit).where("x < y")
    return accept_in_order(candidates, key, near)


def numbered(rows: DataFrame, order: list[str], prefix: str = "synth_v1_") -> DataFrame:
    """rows with new_id: prefix and a number of four digits or more, in order."""
    n = F.col("_number").cast("string")
    return global_rank(rows, order, "_number").withColumn("new_id", F.concat(F.lit(prefix), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))).drop("_number")
