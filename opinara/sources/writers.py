"""Writers of predictions, tables and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import canonical_json


def json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record a line; an existing path is an error unless the mode says otherwise."""
    df.write.mode(mode).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Adds records with their columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def table_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a header and a fixed order of columns."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def fixed(value: Column, digits: int = 3) -> Column:
    """A number with fixed digits; empty for null."""
    return F.coalesce(F.format_string(f"%.{digits}f", value.cast("double")), F.lit(""))


def output_name(parts: list[tuple[str, object]]) -> str:
    """A file's stem from the parts of a configuration that are set."""
    return "_".join(f"{k}{v}" if k else str(v) for k, v in parts if v is not None)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; one of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def snapshot(accepted: DataFrame, base: DataFrame, folder: str) -> None:
    """Progress of a generation: the accepted rows, these behind the base rows, and counts by bucket; the rows are made once."""
    kept = accepted.persist()
    try:
        kept.write.mode("overwrite").json(f"{folder}/accepted")
        base.unionByName(kept, allowMissingColumns=True).write.mode("overwrite").json(f"{folder}/combined")
        kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/report")
    finally:
        kept.unpersist()


def predictions(df: DataFrame, path: str, labels: str = "prediction", mode: str = "overwrite") -> None:
    """Predictions as records, label maps as canonical JSON."""
    df.withColumn(labels, canonical_json(F.col(labels))).write.mode(mode).json(path)
