"""Scores of a growing stream of predictions: sums of counts are associative, so a batch is added to a running total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.metrics import counts_in_row


def batch_sums(rows: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """key and the sums of examples and counts."""
    p, g, k = counts_in_row(F.col(predicted), F.col(expected))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("examples"), *(F.sum(c).alias(n) for n, c in (("n_pred", p), ("n_gold", g), ("n_ok", k))))


def score_stream(stream: DataFrame, key: str, predicted: str, expected: str, target: str, checkpoint: str):
    """Starts a query that writes the sums of every batch under target/batch=<n>; a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch_sums(batch, key, predicted, expected).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark, target: str, key: str) -> DataFrame:
    """The running total over all batches."""
    return spark.read.parquet(target).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("examples", "n_pred", "n_gold", "n_ok")))
