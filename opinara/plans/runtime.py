"""Execution helpers shared by the operators: lineage cuts, distributed ranks, components, pair expansion."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset in local mode."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="opinara-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def join_with_hot(left: DataFrame, right: DataFrame, key: str, size: str, limit: int = 100_000) -> DataFrame:
    """left joined with right, which has one row for each key and in ``size`` how many rows of left have it; left rows without a partner stay.

    Keys with more than ``limit`` rows are sent to all tasks, so that none of them makes one task: they are at most
    the rows of left over limit. The others are joined by shuffle.
    """
    hot, rest = right.where(F.col(size) > limit), right.where(F.col(size) <= limit)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return left.join(F.broadcast(hot), key).unionByName(cold)


def global_rank(df: DataFrame, order: list[Column | str], rank: str = "rank", down: tuple[int, ...] = ()) -> DataFrame:
    """df with its 1-based place (long) in a total order, without one task for all rows.

    Rows are spread by ranges of the order and written to the checkpoint folder; each range is numbered by itself and
    moved by the rows of the ranges before it, of which there are as many as partitions. The columns of order at the
    places in ``down`` descend. Rows that the order doesn't tell apart stand next to each other in any order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{i}" for i in range(len(cols))]
    keyed = df.withColumns(dict(zip(names, cols, strict=True)))
    ways = [F.desc(c) if i in down else F.asc(c) for i, c in enumerate(names)]
    ranged = cut(keyed.repartitionByRange(*ways).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*ways))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(rank, (F.col("_own") + F.col("_before")).cast("long")).select(*df.columns, rank)


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], rank: str, salts: Column | int = 64) -> DataFrame:
    """0-based rank within group, without one task per group.

    Every group is split by a hash of its rows into ``salts`` parts, a number or a column that is the same within a
    group; each part is ranked by itself and moved by the number of rows in the parts before it.  The rank is dense
    and repeatable, and follows ``order`` within a part only: use it where any fixed numbering will do.
    """
    many = F.lit(salts) if isinstance(salts, int) else salts
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), many).cast("int"))
    key = [*group, "_salt"]
    sizes = salted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    on = [ranked[c].eqNullSafe(offsets[c]) for c in key]
    return ranked.join(offsets, on, "left").select(*[ranked[c] for c in df.columns], (ranked[rank] + offsets["_before"]).cast("long").alias(rank))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (node, component), where component is the least node of its component.  Nodes without an edge are not
    returned.  Each round is a few shuffles of the remaining edges; the number of rounds is logarithmic in the size
    of a component, and what each round leaves is written to the checkpoint folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = cut(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
        # large star: every larger neighbour of a node goes to the least of the node's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, goes to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        now = cut(
            pairs.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def blocked(members: DataFrame, group: str, item: str, block: int = 2000) -> DataFrame:
    """Adds _block and _blocks: a group of n items is cut into ceil(n / block) blocks by a hash of the item."""
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    return members.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))


def expand_links(links: DataFrame, left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """(a, b) links between groups into (item_a, item_b) pairs of their members.

    left and right are (grp, item) members.  Every member is in a block of its group, and the join runs on
    (group, block), so that a group of any size is expanded by many tasks.
    """
    one, two = blocked(left, "grp", item), blocked(right, "grp", item)
    sizes = lambda m: m.select("grp", "_blocks").distinct()
    wide = (
        links.join(sizes(one).select(F.col("grp").alias("a"), F.col("_blocks").alias("_na")), "a")
        .join(sizes(two).select(F.col("grp").alias("b"), F.col("_blocks").alias("_nb")), "b")
        .withColumn("_ba", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
        .withColumn("_bb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    )
    one = one.select(F.col("grp").alias("a"), F.col("_block").alias("_ba"), F.col(item).alias("item_a"))
    two = two.select(F.col("grp").alias("b"), F.col("_block").alias("_bb"), F.col(item).alias("item_b"))
    return wide.join(one, ["a", "_ba"]).join(two, ["b", "_bb"]).select("item_a", "item_b")
