"""Scores of predicted against expected label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.arith import prf, ratio


def label_pairs(df: DataFrame, key: str, labels: str, *keep: str) -> DataFrame:
    """Long form: key, aspect, polarity and the columns to keep."""
    return df.select(key, *keep, F.explode(labels).alias("aspect", "polarity"))


def counts(examples: DataFrame, predicted: DataFrame, expected: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, n_pred, n_gold, n_ok for every example; pairs are (key, aspect, polarity) rows, and may repeat.

    ok counts the predicted pairs that occur among the expected ones, so a repeated prediction counts again. All rows
    of an example are brought together by one exchange on the key, which serves both aggregates.
    """
    side = lambda df, p, g: df.select(key, *(F.lit(None).cast(dict(examples.dtypes)[c]).alias(c) for c in keep), "aspect", "polarity", F.lit(p).alias("p"), F.lit(g).alias("g"), F.lit(False).alias("own"))
    own = examples.select(key, *keep, F.lit(None).cast(dict(predicted.dtypes)["aspect"]).alias("aspect"), F.lit(None).cast(dict(predicted.dtypes)["polarity"]).alias("polarity"), F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(True).alias("own"))
    rows = side(predicted, 1, 0).unionByName(side(expected, 0, 1)).unionByName(own).repartition(key)
    pairs = rows.groupBy(key, "aspect", "polarity").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.bool_or("own").alias("own"), *(F.max(c).alias(c) for c in keep))
    return (
        pairs.groupBy(key)
        .agg(*(F.max(c).alias(c) for c in keep), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.when(F.col("g") > 0, F.col("p")).otherwise(0)).alias("n_ok"), F.bool_or("own").alias("_own"))
        .where("_own").drop("_own")
    )


def counts_in_row(predicted: Column, expected: Column) -> tuple[Column, Column, Column]:
    """predicted, expected and ok of two maps that stand in one row; null maps are empty."""
    p, g = (F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")) for c in (predicted, expected))
    return F.size(p), F.size(g), F.size(F.array_intersect(p, g))


def scores(counted: DataFrame, *by: str) -> DataFrame:
    """Macro and micro precision, recall and F1 in percent, over all examples or by group; empty against empty scores 0."""
    p, r, f = prf(F.col("n_pred"), F.col("n_gold"), F.col("n_ok"))
    out = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"), *(F.sum(c).cast("long").alias(c) for c in ("n_pred", "n_gold", "n_ok")),
        F.avg(p).alias("mp"), F.avg(r).alias("mr"), F.avg(f).alias("mf"),
    )
    up, ur, uf = prf(F.col("n_pred"), F.col("n_gold"), F.col("n_ok"))
    four = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(name)
    return out.select(
        *by, "examples", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_gold", "n_ok")),
        four(F.col("mp"), "p_macro"), four(F.col("mr"), "r_macro"), four(F.col("mf"), "f1_macro"), four(up, "p_micro"), four(ur, "r_micro"), four(uf, "f1_micro"),
    )


def same_map(a: Column, b: Column) -> Column:
    """Equality of maps whatever the order of their entries; null is empty."""
    entries = lambda m: F.array_sort(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")))
    return entries(a) == entries(b)


def aligned(df: DataFrame, key: str, predicted: str, expected: str, *keep: str) -> DataFrame:
    """key, keep, aspect, gold, pred: one row for each aspect that either map of a row has."""
    names = F.array_distinct(F.concat(*(F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in (expected, predicted))))
    rows = df.select(key, *keep, expected, predicted, F.explode(names).alias("aspect"))
    return rows.select(key, *keep, "aspect", F.try_element_at(expected, "aspect").alias("gold"), F.try_element_at(predicted, "aspect").alias("pred"))


def by_label(pairs: DataFrame, label: str) -> DataFrame:
    """Counts and scores by aspect, polarity or another column of aligned rows: what is predicted, expected, and right.

    pairs has columns gold, pred (label values or null) and, for label 'polarity', both sides' polarities.
    """
    right = F.col("gold") == F.col("pred")
    if label == "polarity":
        rows = pairs.select(F.explode(F.array(
            F.struct(F.col("pred").alias("polarity"), F.lit(1).alias("p"), F.lit(0).alias("g"), F.coalesce(right, F.lit(False)).cast("int").alias("ok")),
            F.struct(F.col("gold").alias("polarity"), F.lit(0).alias("p"), F.lit(1).alias("g"), F.lit(0).alias("ok")),
        )).alias("x")).select("x.*").where("polarity is not null")
    else:
        rows = pairs.select(label, F.col("pred").isNotNull().cast("int").alias("p"), F.col("gold").isNotNull().cast("int").alias("g"), F.coalesce(right, F.lit(False)).cast("int").alias("ok"))
    out = rows.groupBy(label).agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum("ok").alias("n_ok"))
    p, r, f = prf(F.col("n_pred"), F.col("n_gold"), F.col("n_ok"))
    return out.select(label, "n_pred", "n_gold", "n_ok", F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(f, 4).alias("f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    """aspect, tp, fp, fn over aligned rows."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    return pairs.groupBy("aspect").agg(
        F.count_if(right).alias("tp"), F.count_if(F.col("pred").isNotNull() & ~right).alias("fp"), F.count_if(F.col("gold").isNotNull() & ~right).alias("fn")
    )


def error_profile(pairs: DataFrame) -> DataFrame:
    """kind (missing, extra, wrong), aspect, gold_polarity, pred_polarity, n."""
    kind = F.when(F.col("pred").isNull(), "missing").when(F.col("gold").isNull(), "extra").when(F.col("gold") != F.col("pred"), "wrong")
    return pairs.select(kind.alias("kind"), "aspect", F.col("gold").alias("gold_polarity"), F.col("pred").alias("pred_polarity")).where("kind is not null").groupBy("kind", "aspect", "gold_polarity", "pred_polarity").agg(F.count(F.lit(1)).alias("n"))


def error_counters(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """One row: examples, nothing predicted against some gold, some against none, wrong polarity somewhere, exact matches and their share of the rows with a prediction."""
    np, ng, _ = counts_in_row(F.col(predicted), F.col(expected))
    wrong = F.exists(F.map_keys(F.coalesce(predicted, F.create_map().cast("map<string,string>"))), lambda k: F.coalesce(F.try_element_at(expected, k) != F.try_element_at(predicted, k), F.lit(False)))
    exact = same_map(F.col(predicted), F.col(expected)) & F.col(predicted).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if((np == 0) & (ng > 0)).alias("empty_pred_with_gold"), F.count_if((np > 0) & (ng == 0)).alias("pred_with_empty_gold"),
        F.count_if(wrong).alias("wrong_polarity"), F.count_if(exact).alias("exact"), F.count(predicted).alias("with_prediction"),
        F.round(ratio(F.count_if(exact), F.count(predicted), 100.0), 4).alias("exact_pct"),
    )


def thinking_rollup(df: DataFrame, meta: str, predicted: str, expected: str) -> DataFrame:
    """One row: sums of tokens and time, counts of flags, and scores."""
    p, g, ok = counts_in_row(F.col(predicted), F.col(expected))
    pp, rr, ff = prf(p, g, ok)
    m = F.col(meta)
    flags = ("closed_thinking", "hit_token_limit", "unfinished_at_limit", "ended_with_eos")
    total = lambda c: F.coalesce(F.sum(m[c]), F.lit(0)).cast("long")
    up, ur, uf = prf(F.sum(p), F.sum(g), F.sum(ok))
    return df.agg(
        F.count(F.lit(1)).alias("examples"), *(total(c).alias(c) for c in ("prompt_tokens", "output_tokens", "thinking_tokens", "final_tokens")),
        *(F.count_if(m[c]).alias(c) for c in flags), F.round(F.coalesce(F.sum(m["elapsed_sec"]), F.lit(0.0)), 2).alias("elapsed_sec"),
        F.round(F.avg(pp), 4).alias("p_macro"), F.round(F.avg(rr), 4).alias("r_macro"), F.round(F.avg(ff), 4).alias("f1_macro"),
        F.round(up, 4).alias("p_micro"), F.round(ur, 4).alias("r_micro"), F.round(uf, 4).alias("f1_micro"),
    )
