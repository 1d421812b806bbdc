"""Profiles of annotated datasets: frequencies, distributions, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(pairs: DataFrame, *by: str, order: str | None = None) -> DataFrame:
    """by, n and, with an order column, first_seen: the least order value of each."""
    first = [F.min(order).alias("first_seen")] if order else []
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *first)


def majority_polarity(pairs: DataFrame, order: str) -> DataFrame:
    """aspect, polarity, n: the most frequent polarity of each aspect; ties go to the one seen first."""
    n = frequencies(pairs, "aspect", "polarity", order=order)
    best = n.groupBy("aspect").agg(F.max_by(F.struct("polarity", "n"), F.struct("n", -F.col("first_seen"))).alias("x"))
    return best.select("aspect", "x.polarity", "x.n")


def top_aspects(pairs: DataFrame, order: str, k: int) -> DataFrame:
    """The k most frequent aspects with their rank; ties go to the one seen first."""
    # at most as many rows as there are aspects
    w = Window.orderBy(F.desc("n"), "first_seen", "aspect")
    return frequencies(pairs, "aspect", order=order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("rank", "aspect", "n")


def dataset_shape(df: DataFrame, labels: str, sets: list[list[str]]) -> DataFrame:
    """For each grouping set: examples, mean, median and most labels, examples without labels. Null maps have none."""
    by = sorted({c for s in sets for c in s})
    n = F.greatest(F.coalesce(F.size(labels), F.lit(0)), F.lit(0))
    rows = df.select(*by, n.alias("n"))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by)).agg(
        F.count(F.lit(1)).alias("examples"), F.round(F.avg("n"), 4).alias("mean_labels"), F.percentile("n", F.lit(0.5)).cast("double").alias("median_labels"),
        F.max("n").alias("max_labels"), F.count_if(F.col("n") == 0).alias("empty_gold"),
    )


def shares(df: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """within, by, n, pct: counts and their percentage of each group in within."""
    n = df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*within)) if within else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select(*within, *by, "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"))


def matrix(pairs: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Dense counts, 0 where a combination doesn't occur."""
    return pairs.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def cooccurrence(df: DataFrame, labels: str) -> DataFrame:
    """aspect_a, aspect_b, n: examples with both, ordered pairs, the diagonal included. Works within a row, without a join."""
    keys = F.map_keys(labels)
    one = df.select(keys.alias("k")).select("k", F.explode("k").alias("aspect_a"))
    return one.select("aspect_a", F.explode("k").alias("aspect_b")).groupBy("aspect_a", "aspect_b").agg(F.count(F.lit(1)).alias("n"))


def rarest(pairs: DataFrame, order: str, k: int) -> DataFrame:
    """The k rarest (aspect, polarity) pairs; ties go to the one seen first."""
    return frequencies(pairs, "aspect", "polarity", order=order).orderBy("n", "first_seen", "aspect", "polarity").limit(k).select("aspect", "polarity", "n")


def histogram(values: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """bin_from, bin_to, n for all bins; half open, the last one closed."""
    v = F.col(value)
    at = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = v <= edges[i + 1] if i == len(edges) - 2 else v < edges[i + 1]
        at = F.when((v >= edges[i]) & upper, i).otherwise(at)
    n = values.select(at.alias("i")).where("i is not null").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    bins = values.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "i int, bin_from int, bin_to int")
    return bins.join(F.broadcast(n), "i", "left").select("bin_from", "bin_to", F.coalesce("n", F.lit(0)).alias("n"))


def mean_by_bin(df: DataFrame, at: Column, value: Column, width: int) -> DataFrame:
    """bin_from, examples, mean: half-open bins of one width."""
    return df.select((F.floor(at / width) * width).cast("long").alias("bin_from"), value.alias("v")).groupBy("bin_from").agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg("v"), 4).alias("mean"))


def percentiles(df: DataFrame, value: str, at: list[float], *by: str) -> DataFrame:
    """Exact percentiles with linear interpolation; 0 for no rows."""
    found = F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, at)))
    out = df.groupBy(*by).agg(found.alias("p"), F.max(value).cast("double").alias("longest"), F.round(F.avg(value), 4).alias("mean"))
    return out.select(*by, *(F.round(F.coalesce(F.col("p")[i], F.lit(0.0)), 4).alias(f"p{round(q * 100)}") for i, q in enumerate(at)), F.coalesce("longest", F.lit(0.0)).alias("longest"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def fit_table(df: DataFrame, value: str, limits: list[int], *by: str) -> DataFrame:
    """by, limit, pct_at_most, pct_below, over: how many rows fit each limit; one pass, the limits as columns."""
    cols = [c for n in limits for c in (F.count_if(F.col(value) <= n).alias(f"a{n}"), F.count_if(F.col(value) < n).alias(f"b{n}"))]
    out = df.groupBy(*by).agg(F.count(value).alias("rows"), *cols)
    lines = F.array(*(F.struct(F.lit(n).alias("limit"), F.col(f"a{n}").alias("a"), F.col(f"b{n}").alias("b")) for n in limits))
    pct = lambda c: F.when(F.col("rows") > 0, F.round(100.0 * c / F.col("rows"), 4)).otherwise(0.0)
    return out.select(*by, "rows", F.explode(lines).alias("x")).select(*by, "x.limit", pct(F.col("x.a")).alias("pct_at_most"), pct(F.col("x.b")).alias("pct_below"), (F.col("rows") - F.col("x.a")).alias("over"))
