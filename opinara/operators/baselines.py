"""Predictors without a model, ranked by their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.arith import prf
from opinara.operators.metrics import counts_in_row, label_pairs
from opinara.operators.profile import majority_polarity, top_aspects


def ranked(train: DataFrame, test: DataFrame, labels: str, order: str, tops: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """baseline, examples, n_pred, n_gold, n_ok, f1_macro, f1_micro, rank, for: nothing, the k most frequent aspects as
    positive or with their majority polarity, and the expected aspects with their majority polarity.

    Constant predictions are literals, so test is read once and no join is needed; majorities are a few rows.
    """
    pairs = label_pairs(train, order, labels)
    majority = {r.aspect: r.polarity for r in majority_polarity(pairs, order).collect()}
    frequent = [r.aspect for r in top_aspects(pairs, order, max(tops)).orderBy("rank").collect()]
    constant = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>")
    table = constant(majority)
    own = F.map_from_entries(F.transform(F.map_keys(F.coalesce(labels, constant({}))), lambda a: F.struct(a, F.coalesce(F.try_element_at(table, a), F.lit("positive")))))
    made: dict[str, Column] = {"empty": constant({}), "oracle_aspects_majority_polarity": own}
    for k in tops:
        made[f"top{k}_positive"] = constant(dict.fromkeys(frequent[:k], "positive"))
        made[f"top{k}_majority"] = constant({a: majority[a] for a in frequent[:k]})
    rows = []
    for p in made.values():
        n, g, ok = counts_in_row(p, F.col(labels))
        rows.append(F.struct(n.cast("long").alias("n"), g.cast("long").alias("g"), ok.cast("long").alias("ok"), prf(n, g, ok)[2].alias("f")))
    sums = test.select(*(c.alias(f"c{i}") for i, c in enumerate(rows)))
    parts = [F.struct(F.lit(name).alias("baseline"), *(F.coalesce(F.sum(f"c{i}.{x}"), F.lit(0)).alias(x) for x in ("n", "g", "ok")), F.coalesce(F.avg(f"c{i}.f"), F.lit(0.0)).alias("f"), F.count(F.lit(1)).alias("examples")) for i, name in enumerate(made)]
    out = sums.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    micro = prf(F.col("n"), F.col("g"), F.col("ok"))[2]
    scored = out.select("baseline", "examples", F.col("n").alias("n_pred"), F.col("g").alias("n_gold"), F.col("ok").alias("n_ok"), F.round("f", 4).alias("f1_macro"), F.round(micro, 4).alias("f1_micro"))
    from pyspark.sql import Window

    # one row for each baseline
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1_macro"), "baseline")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
