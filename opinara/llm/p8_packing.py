"""Filling fixed-capacity containers with documents, planned on the histogram of their lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.sizes import with_tokens
from opinara.plans.runtime import cut, rank_in_group

Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Best-fit decreasing over counts: (slots, containers).

    A slot (length, first, last, container, each) gives the items of a length with ranks first to last - 1 to the
    containers from ``container`` on, ``each`` items to a container. Containers with the same room are kept as
    intervals of numbers, so the work depends on the lengths that occur and not on the number of items.
    """
    slots: list[Slot] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def put(left: int, start: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((start, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                start, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                left, start, n = capacity, opened, -(-count // (capacity // length))
                opened += n
            each = left // length
            full = min(n, count // each)
            if full:
                slots.append((length, rank, rank + full * each, start, each))
                put(left - each * length, start, full)
                rank, count, start, n = rank + full * each, count - full * each, start + full, n - full
            if n and count:
                some = min(each, count)
                slots.append((length, rank, rank + some, start, some))
                put(left - some * length, start, 1)
                rank, count, start, n = rank + some, count - some, start + 1, n - 1
            put(left, start, n)
    return slots, opened


#: Items of one length that one task ranks, ranks that one join key of the slots covers, and most specs (each is planned on the driver).
RANKED, BLOCK, SPECS = 200_000, 100_000, 10_000


def pack(documents: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "spec_name", capacity: str = "capacity_tokens", small: int = 200_000) -> DataFrame:
    """spec_name, container_id, doc_id, part, from_token, n_tokens.

    For every spec, every document is in a container, whole, unless it exceeds the capacity: then it is cut into
    parts of the capacity and one of the rest. Containers of a spec are numbered from 0, and none holds more than
    the capacity. Documents without tokens (null and empty texts) have one part of 0 tokens and container null. A
    spec with null or no positive capacity holds nothing; of a spec given twice the least capacity counts, and more
    than SPECS specs are refused. Ranks that tie are settled by a hash of the key.

    The plan has some slots for each length that occurs; it goes to every task if it has at most ``small`` rows and
    is joined on (spec, length, block of ranks) otherwise. Ranks within a length are counted in parts of about RANKED
    items, as the histogram says, so that one length may hold any share of all items.
    """
    spark = documents.sparkSession
    sizes = cut(with_tokens(documents, text, [key]))
    named = specs.where((F.col(capacity) > 0) & F.col(name).isNotNull()).groupBy(F.col(name).alias("spec")).agg(F.min(F.col(capacity).cast("long")).alias("cap")).limit(SPECS + 1).collect()
    if len(named) > SPECS:
        raise ValueError(f"more than {SPECS} specs")
    every = F.array(*(F.struct(F.lit(r.spec).alias("spec"), F.lit(r.cap).cast("long").alias("cap")) for r in named)) if named else F.array().cast("array<struct<spec:string,cap:bigint>>")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("cap")).cast("long"))
    items = (
        sizes.withColumn("_w", F.explode(every)).select(key, "n_tokens", "_w.spec", "_w.cap").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("spec", "cap", key, "part", (F.col("part") * F.col("cap")).alias("from_token"), F.least("cap", F.col("n_tokens") - F.col("part") * F.col("cap")).alias("length"))
    )
    # at most one row for each length up to the capacities
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in items.groupBy("spec", "cap", "length").agg(F.count(F.lit(1)).alias("n")).where("length > 0").collect():
        histogram.setdefault((r.spec, r.cap), {})[r.length] = r.n
    rows = [(spec, *slot) for (spec, cap), h in histogram.items() for slot in plan(h, cap)[0]]
    slots = spark.createDataFrame(rows, "spec string, length long, first long, last long, start long, each long")
    # lengths of more than RANKED items: at most the items over RANKED
    many = [(spec, length, -(-n // RANKED)) for (spec, _), h in histogram.items() for length, n in h.items() if n > RANKED]
    salts = F.broadcast(spark.createDataFrame(many, "spec string, length long, _salts int"))
    salted = items.where("length > 0").join(salts, ["spec", "length"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    ranked = rank_in_group(salted, ["spec", "length"], [F.col(key), F.col("part")], "rank", F.col("_salts")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    if len(rows) <= small:
        slots, on = F.broadcast(slots), ["spec", "length"]
    else:
        slots, on = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("last") - 1) / BLOCK)))), ["spec", "length", "block"]
    placed = ranked.join(slots, on).where("rank >= first and rank < last")
    out = placed.select(F.col("spec").alias("spec_name"), (F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("long").alias("container_id"), key, "part", "from_token", F.col("length").alias("n_tokens"))
    nothing = items.where("length = 0").select(F.col("spec").alias("spec_name"), F.lit(None).cast("long").alias("container_id"), key, "part", "from_token", F.col("length").alias("n_tokens"))
    return out.unionByName(nothing)


def fill_report(packed: DataFrame, specs: DataFrame, name: str = "spec_name", capacity: str = "capacity_tokens") -> DataFrame:
    """spec_name, containers, items, tokens, least_containers (tokens over capacity, rounded up), fill (tokens over room), overfull (containers beyond capacity)."""
    filled = packed.where("container_id is not null").groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    caps = specs.where(F.col(capacity) > 0).groupBy(F.col(name).alias("spec_name")).agg(F.min(capacity).alias("cap"))
    return filled.join(F.broadcast(caps), "spec_name").groupBy("spec_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("cap").alias("cap"), F.count_if(F.col("t") > F.col("cap")).alias("overfull")
    ).select("spec_name", "containers", "items", "tokens", F.ceil(F.col("tokens") / F.col("cap")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("cap")), 6).alias("fill"), "overfull")
