"""Mixing sources to target weights: blocks of equal tokens apportioned by the Sainte-Lague method."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.sizes import with_tokens
from opinara.plans.runtime import cut


def sainte_lague(weights: dict[str, float], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Seats by highest quotient weight / (2 k + 1), none beyond its cap; ties go to the lesser name.

    Most seats are dealt at once, as the share rounded down is below what the quotients give or at most one above
    it, less a margin of the number of sources; only the last few are dealt one by one.
    """
    got = dict.fromkeys(weights, 0)
    left = seats
    while True:
        open_ = {s: w for s, w in weights.items() if w > 0 and got[s] < caps[s]}
        total = sum(open_.values())
        if not open_ or left <= 0:
            return got
        even = sum(got[s] for s in open_) + left
        lots = {s: min(caps[s], int(even * w / total) - len(weights)) - got[s] for s, w in open_.items()}
        lots = {s: n for s, n in lots.items() if n > 0}
        if sum(lots.values()) > left or not lots:
            break
        for s, n in lots.items():
            got[s] += n
            left -= n
    heap = [(-w / (2 * got[s] + 1), s) for s, w in weights.items() if w > 0 and got[s] < caps[s]]
    heapq.heapify(heap)
    while left and heap:
        _, s = heapq.heappop(heap)
        got[s] += 1
        left -= 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-weights[s] / (2 * got[s] + 1), s))
    return got


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 1024, shard_tokens: int = 2_000_000, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mixed, report).

    The documents of a source are spread over shards by a seeded hash and stand in seeded order there; a block is the documents that begin within the
    same block_tokens of their shard. Blocks are dealt to sources by the highest quotients of their weights, at most
    max_repeats times the blocks they have; a source's quota is dealt to its shards in proportion to their blocks
    (``shard_quotas``), and a shard repeats all its blocks as often as its quota allows and takes the rest by seeded rank.
    total_tokens is the size of the mix; by default the largest at which every source that has documents reaches its
    share. Targets are normalised over the sources with documents.

    mixed: doc_id, source, n_tokens, copies (1 to max_repeats); documents that aren't taken are left out.
    report: source, target_share, usable_share (the target among the sources that have documents), max_repeats,
    documents, available, mixed_tokens, share, gap (share less usable_share), repeats (mixed over available). Sources only in the documents have target 0 and sources only in the
    targets no documents; both are reported. Documents of a null source, or without tokens, are never taken. A
    source named by several target rows has their shares together and the least of their caps.
    """
    spark = documents.sparkSession
    goals: dict[str, tuple[float, int]] = {}
    # as many rows as there are named sources
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect():
        share, cap = goals.get(r.source, (0.0, 1 << 30))
        goals[r.source] = (share + max(r.target_share or 0.0, 0.0), min(cap, r.max_repeats if r.max_repeats is not None else 1))
    kept = documents.where(F.col(source).isNotNull())
    sizes = cut(with_tokens(kept, text, [key, source]).select(F.col(key).alias("doc"), F.col(source).alias("source"), "n_tokens"))
    totals = cut(sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("n_tokens") > 0).alias("n")))
    wanted = F.broadcast(spark.createDataFrame([(s, *g) for s, g in goals.items()], "source string, target_share double, max_repeats int"))
    have = {r.source: r for r in totals.join(wanted, "source", "left_semi").collect()}
    usable = {s: g for s, g in goals.items() if s in have and have[s].t > 0 and g[0] > 0 and g[1] > 0}
    whole = sum(g[0] for g in usable.values())
    most = min((have[s].t * cap / (share / whole) for s, (share, cap) in usable.items()), default=0)
    total = most if total_tokens is None else total_tokens
    names = spark.createDataFrame([(s, max(1, round(have[s].t / shard_tokens))) for s in usable], "source string, shards int")
    hashed = sizes.where("n_tokens > 0").join(F.broadcast(names), "source").withColumn("h", F.xxhash64("doc", F.lit(seed)))
    spread = hashed.withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int"))
    before = Window.partitionBy("source", "shard").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(spread.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) / block_tokens).cast("long")).select("doc", "source", "n_tokens", "shard", "block"))
    per = cut(blocks.groupBy("source", "shard").agg(F.count_distinct("block").alias("n"), F.sum("n_tokens").alias("t")))
    held = {r.source: r for r in per.groupBy("source").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()}
    # a source's blocks differ in size by what its last document of a block runs over: weigh by its own mean
    mean = {s: r.t / r.n for s, r in held.items()}
    seats = round(sum(total * usable[s][0] / whole / mean[s] for s in mean))
    quota = sainte_lague({s: usable[s][0] / mean[s] for s in mean}, {s: usable[s][1] * held[s].n for s in mean}, seats)
    deals = shard_quotas(per, spark.createDataFrame([(s, quota[s], held[s].n) for s in mean], "source string, quota long, whole long"))
    few = blocks.select("source", "shard", "block").distinct()
    rank = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed + 1)), "block")
    taken = few.withColumn("r", F.row_number().over(rank)).join(deals, ["source", "shard"]).select("source", "shard", "block", (F.col("rounds") + (F.col("r") <= F.col("more")).cast("long")).alias("copies")).where("copies > 0")
    mixed = cut(blocks.join(taken, ["source", "shard", "block"]).select(F.col("doc").alias(key), "source", "n_tokens", "copies"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("m"))
    everything = got.agg(F.sum("m")).first()[0] or 0
    none = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    usable_share = spark.createDataFrame([(s, g[0] / whole) for s, g in usable.items()], "source string, usable_share double")
    lines = totals.join(wanted, "source", "full").join(F.broadcast(usable_share), "source", "left").join(got, "source", "left")
    share = none("m", "double") / F.lit(float(everything)) if everything else F.lit(0.0)
    report = lines.select(
        "source", none("target_share", "double").alias("target_share"), none("usable_share", "double").alias("usable_share"), none("max_repeats", "int").alias("max_repeats"), none("n", "long").alias("documents"), none("t", "long").alias("available"),
        none("m", "long").alias("mixed_tokens"), share.alias("share"), (share - none("usable_share", "double")).alias("gap"), F.when(F.col("t") > 0, none("m", "double") / F.col("t")).otherwise(0.0).alias("repeats"),
    )
    return mixed, report


def shard_quotas(per: DataFrame, quotas: DataFrame, group: int = 4096) -> DataFrame:
    """source, shard, rounds, more: each shard's part of its source's quota, as whole turns through its n blocks and some more.

    per has source, shard, n; quotas has source, quota and whole (the blocks of all its shards), a row for each source.
    A shard gets what the quota times the blocks up to it comes to, rounded down, less the same up to the one before,
    so the parts sum up to the quota and none is off by one block. Blocks before a shard are summed by groups of
    shards and then within them, so no task sees all shards of a source.
    """
    grouped = per.withColumn("_g", F.floor(F.col("shard") / group))
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("source", "_g").agg(F.sum("n").alias("n")).withColumn("_ahead", ahead(["source"], "_g")).select("source", "_g", "_ahead")
    placed = grouped.withColumn("_own", ahead(["source", "_g"], "shard")).join(groups, ["source", "_g"]).join(F.broadcast(quotas), "source")
    upto = lambda c: F.expr(f"(cast(quota as decimal(19,0)) * cast({c} as decimal(19,0))) div cast(whole as decimal(19,0))")
    part = placed.withColumn("_from", F.col("_ahead") + F.col("_own")).withColumn("_to", F.col("_from") + F.col("n")).withColumn("q", upto("_to") - upto("_from"))
    return part.select("source", "shard", F.floor(F.col("q") / F.col("n")).cast("long").alias("rounds"), (F.col("q") % F.col("n")).cast("long").alias("more"))
