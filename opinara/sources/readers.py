"""Readers of datasets, prompts, run summaries and histories."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.plans.runtime import global_rank

EXAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gold", T.MapType(T.StringType(), T.StringType()))])
PREDICTION = T.StructType([*EXAMPLE.fields, T.StructField("prediction", T.MapType(T.StringType(), T.StringType())), T.StructField("prediction_normalized", T.MapType(T.StringType(), T.StringType())), T.StructField("raw_generation", T.StringType())])
ENTITIES = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gold", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
SWEEP_COLUMNS = {"Config": "config", "Temp": "temperature", "Top-P": "top_p", "Top-K": "top_k", "PP": "presence_penalty"}


def resolve(name: str, roots: list[str]) -> str:
    """An absolute or remote path as it is; else the first root under which it exists; else the last root."""
    if "://" in name or Path(name).is_absolute():
        return name
    return str(next((p for r in roots if (p := Path(r) / name).exists()), Path(roots[-1]) / name))


def dataset(spark: SparkSession, name: str, roots: list[str] | None = None, schema: T.StructType = EXAMPLE) -> DataFrame:
    """A JSON array of records with their 0-based ordinal. A name without suffix is dataset/<name>.json under a root.

    An array is one value, which one task reads, so its rows stand in their order and are numbered within it.
    """
    path = resolve(name if Path(name).suffix else f"dataset/{name}.json", roots or ["."])
    rows = spark.read.option("multiLine", True).schema(T.StructType([*schema.fields])).json(path)
    numbered = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    return global_rank(numbered, ["_part", "_at"], "ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("_part", "_at")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One record a line; a schema saves a pass over the data."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def prompt(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, system, user. Other names of the two are accepted, an empty one is an error; the name defaults to the file's stem."""
    fields = ("name", "system", "user", "sysprompt", "usrprompt")
    raw = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).json(path)

    def needed(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.raise_error(F.lit(f"{path}: no {names[0]} prompt")).cast("string"))

    return raw.select(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(Path(path).stem)).alias("name"), needed("system", "sysprompt").alias("system"), needed("user", "usrprompt").alias("user"))


def padded_csv(spark: SparkSession, path: str, renames: dict[str, str] | None = None, numbers: list[str] | None = None, key: str | None = None) -> DataFrame:
    """A CSV whose cells are padded: names and values trimmed, columns renamed, numbers cast; the last row of a key holds."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = raw.toDF(*[(renames or {}).get(c.strip(), c.strip()) for c in raw.columns])
    cast = named.withColumns({c: F.col(c).cast("double") for c in numbers or []})
    if not key:
        return cast
    w = Window.partitionBy(key).orderBy(F.desc("_at"))
    return cast.withColumn("_at", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_at", "_n")


def first_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """The first row of each CSV file of a pattern, with the file's name."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(pattern).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("_at"))
    w = Window.partitionBy("file").orderBy("_at")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_at", "_n")


def summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON documents of a pattern with their file's name; files that can't be read give a row of nulls."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(pattern).select("*", F.col("_metadata.file_name").alias("file"))


def chosen_config(runs: DataFrame) -> DataFrame:
    """file and the fields of chosen.generation_config."""
    return runs.select("file", "chosen.generation_config.*")


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """path of the file of a pattern that was modified last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of log_history, one row each, in order."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("log_history").alias("position", "entry")).select("position", "entry.*")


def cached_by_text(df: DataFrame, text: str, cache: str, compute) -> DataFrame:
    """df joined with what compute(texts) gives for each distinct text; results are kept in a parquet cache by content hash."""
    spark = df.sparkSession
    keyed = df.withColumn("_hash", F.sha2(text, 256))
    wanted = keyed.select("_hash", text).dropDuplicates(["_hash"])
    # what can't be read is an error; only a cache that isn't there yet is empty
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        wanted = wanted.join(spark.read.parquet(cache).select("_hash"), "_hash", "left_anti")
    compute(wanted).write.mode("append").parquet(cache)
    return keyed.join(spark.read.parquet(cache), "_hash", "left").drop("_hash")
