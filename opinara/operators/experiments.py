"""Tables of experiment runs: grids, rankings, choices, roll-ups, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.functions.arith import composite
from opinara.plans.runtime import global_rank


def grid(spark: SparkSession, axes: dict[str, list[float]], steps: dict[str, float] | None = None) -> DataFrame:
    """All combinations of the axes' values; with steps, each value's neighbours along its axis too, out of range or not."""
    out = None
    for name, values in axes.items():
        step = (steps or {}).get(name)
        every = sorted({round(v + d, 6) for v in values for d in ((-step, 0, step) if step else (0,))})
        axis = spark.createDataFrame([(float(v),) for v in every], f"{name} double")
        out = axis if out is None else out.join(F.broadcast(axis))
    return out


def matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b: runs of configurations with seeds. Both are hand-sized tables."""
    return a.join(F.broadcast(b))


def to_do(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a plan."""
    return planned.join(done.select(key), key, "left_anti")


def ranked(runs: DataFrame, keys: list[tuple[Column, bool]], name: str, digits: int | None = None) -> DataFrame:
    """runs with rank by the keys (column, descending), ties by name; with digits, by keys rounded half to even."""
    cols = [F.bround(c, digits) if digits is not None else c for c, _ in keys]
    order = [c.desc() if d else c.asc() for c, (_, d) in zip(cols, keys)]
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(*order, name)))


def conservative_choice(runs: DataFrame, name: str, score: str, base: str, min_gain: float, drop: float = 0.0) -> DataFrame:
    """One row: the best run if it gains min_gain over the baseline, else the baseline; the best if there is no baseline."""
    both = runs.agg(F.max_by(F.struct(name, score), F.struct(F.col(score), F.col(name))).alias("best"), F.first(F.when(F.col(name) == base, F.struct(name, score)), ignorenulls=True).alias("base"))
    keep = F.col("base").isNotNull() & ((F.col(f"best.{score}") < F.col(f"base.{score}") - drop) | (F.col(f"best.{score}") < F.col(f"base.{score}") + min_gain))
    return both.select(F.when(keep, F.col("base")).otherwise(F.col("best")).alias("c")).select(f"c.{name}", f"c.{score}", (F.col(f"c.{name}") == base).alias("is_base"))


def seed_stability(runs: DataFrame, config: str, measures: list[str], drop_stub: Column | None = None) -> DataFrame:
    """config, n, and mean, least, most and sample deviation of each measure; rows under drop_stub are left out."""
    rows = runs.where(~drop_stub) if drop_stub is not None else runs
    aggs = [F.round(f(m), 4).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    return rows.groupBy(config).agg(F.count(F.lit(1)).alias("n"), *aggs)


def decide(runs: DataFrame, name: str, tie: float = 0.5) -> DataFrame:
    """One row: of the runs within tie of the best mean micro score, the one with the best macro score, precision, least k."""
    best = runs.agg(F.max("f1_micro").alias("_best"))
    return runs.join(F.broadcast(best)).where(F.col("f1_micro") >= F.col("_best") - tie).orderBy(F.desc("f1_macro"), F.desc("precision"), "k", name).limit(1).drop("_best")


def running_best(history: DataFrame, run: str, step: str, first: str, second: str, eps: float = 1e-9) -> DataFrame:
    """history with best_first, best_step, improved: the best so far by first, then second; the earliest of equals is kept."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # scores that differ by less than eps are equal
    key = F.struct(F.round(F.col(first) / eps).alias("a"), F.round(F.col(second) / eps).alias("b"), (-F.col(step)).alias("s"))
    best = F.max(F.struct(key.alias("k"), F.col(first).alias("f"), F.col(step).alias("t"))).over(w)
    return history.withColumn("_b", best).select(*history.columns, F.col("_b.f").alias("best_first"), F.col("_b.t").alias("best_step"), (F.col("_b.t") == F.col(step)).alias("improved"))


def trial_ranking(trials: DataFrame, name: str) -> DataFrame:
    """trials with score and rank by it."""
    return ranked(trials.withColumn("score", F.round(composite(F.col("f1_micro"), F.col("f1_macro")), 6)), [(F.col("score"), True)], name)


def window_of(rows: DataFrame, order: str, offset: int, limit: int | None) -> DataFrame:
    """Rows offset to offset + limit in the order of a unique column, with their position."""
    at = global_rank(rows, [order], "position").withColumn("position", F.col("position") - 1)
    return at.where((F.col("position") >= offset) & ((F.col("position") < offset + limit) if limit is not None else F.lit(True)))


def spaced(rows: DataFrame, order: str, start: int, limit: int | None) -> DataFrame:
    """limit rows from start on, evenly spaced, the first and the last among them; places are rounded half to even."""
    n = max(rows.count() - start, 0)
    if limit is None or limit >= n:
        places = None
    else:
        places = [0] if limit == 1 else sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)})
    at = window_of(rows, order, start, None)
    return at if places is None else at.where((F.col("position") - start).isin(places))


def middle_and_longest(rows: DataFrame, length: str, key: str) -> DataFrame:
    """Two rows: the record of middle length (the upper one of two) and the longest; ties by key. Rows of null length take no part.

    length is a whole number. The length at the middle is an exact percentile, and only the rows that have it are numbered.
    """
    rows = rows.where(F.col(length).isNotNull())
    n = rows.count()
    middle = round(rows.agg(F.percentile(length, (n // 2) / (n - 1))).first()[0]) if n > 1 else rows.agg(F.max(length)).first()[0]
    place = n // 2 + 1 - rows.where(F.col(length) < F.lit(middle)).count()
    mid = global_rank(rows.where(F.col(length) == F.lit(middle)), [key], "_place").where(F.col("_place") == place).select(F.lit("middle").alias("which"), key, length)
    most = rows.agg(F.max_by(F.struct(key, length), F.struct(F.col(length), -F.col(key))).alias("x")).where("x is not null").select(F.lit("longest").alias("which"), f"x.{key}", f"x.{length}")
    return mid.unionByName(most)


def beside_baseline(runs: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """runs with baseline, delta and missing: what the baseline row of the same keys has for value, null where there is none.

    baseline has one row for each of the keys, as few as there are configurations.
    """
    known = baseline.select(*keys, F.col(value).alias("baseline"), F.lit(True).alias("_known"))
    joined = runs.join(known, keys, "left")
    return joined.select(*runs.columns, "baseline", (F.col(value) - F.col("baseline")).alias("delta"), F.col("_known").isNull().alias("missing"))


def zipped(first: DataFrame, order: str, second: DataFrame, by: str) -> DataFrame:
    """Rows of two tables that stand at the same 0-based place of their orders, as many as the shorter one has. Their other columns have different names."""
    return global_rank(first, [order], "position").join(global_rank(second, [by], "position"), "position").withColumn("position", F.col("position") - 1)


def seconds_per_example(rows: DataFrame, seconds: Column, by: str) -> DataFrame:
    """by, examples, per_example: the time of all examples over their number; null times count as none."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("examples"), F.round(F.sum(F.coalesce(seconds, F.lit(0.0))) / F.count(F.lit(1)), 4).alias("per_example"))
