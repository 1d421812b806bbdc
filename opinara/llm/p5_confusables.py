"""Visually identical text with different characters: skeletons, groups of equal skeleton, rows in odd form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import canon
from opinara.plans.runtime import cut, join_with_hot


def with_skeleton(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, skeleton string, odd boolean.

    skeleton is the text's confusables skeleton (canon.Skeleton), odd says that the text isn't its ordinary
    form, which the skeleton tells.  A null text has a null skeleton and isn't odd; an empty text is its own
    skeleton.  Columns besides keys and text are not read.  One pass in Arrow batches, no shuffle.
    """
    table = canon.look_alikes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = canon.skeleton(table)
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            forms = [make.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keys))), pa.array(forms, pa.string()), pa.array([make.odd(t, f) for t, f in zip(texts, forms, strict=True)], pa.bool_())],
                names=[*keys, "skeleton", "odd"],
            )

    kept = df.select(*keys, text)
    fields = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{fields}, skeleton string, odd boolean")


def odd_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The keys of the rows in odd form, each key once (a key's rows are odd if one of them is)."""
    # texts of plain ASCII are their own skeletons; they stay in the JVM
    kept = df.select(*keys, text).where(F.col(text).rlike(r"[^\x00-\x7F]"))
    return with_skeleton(kept, text, keys).where("odd").select(*keys).distinct()


def skeleton_groups(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, skeleton_hash, form_hash, rows, forms: every row whose text looks like a differently written one.

    skeleton_hash names the group, form_hash the way the row is written; rows and forms are how many the group has.
    The skeleton is that of the whole table of prototypes (``Skeleton.looks``), so words wholly of look-alike letters,
    digits and punctuation meet the plain ones.  Rows with null texts belong to no group.  Skeletons and forms are
    128-bit hashes.  The first aggregate is by (skeleton, form), so that one text that holds a third of all rows is
    counted where it is read, the second sees each form once, and groups of very many rows go to all tasks when the
    members are told their group.
    """
    spark = df.sparkSession
    table = canon.look_alikes(spark)
    shared = spark.sparkContext.broadcast({ord(c): p for c, p in canon.prototypes(spark).items()})
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make = canon.skeleton(table)
        for b in batches:
            texts = b.column(n).to_pylist()
            hashes = [[xxhash.xxh3_128_digest(make.looks(t, shared.value)) for t in texts], [xxhash.xxh3_128_digest(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(h, pa.binary()) for h in hashes)], names=[*names, "_s", "_f"])

    kept = df.where(F.col(text).isNotNull()).select(*keys, text)
    names = kept.columns[:-1]
    hashed = cut(kept.mapInArrow(run, "".join(f"`{k}` {t}, " for k, t in kept.dtypes[:-1]) + "_s binary, _f binary"))
    forms = hashed.groupBy("_s", "_f").agg(F.count(F.lit(1)).alias("n"))
    groups = forms.groupBy("_s").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_forms")).where("_forms > 1")
    members = join_with_hot(hashed, cut(groups), "_s", "_rows").where("_forms is not null")
    named = lambda c: F.lower(F.hex(c))
    return members.select(*names, named("_s").alias("skeleton_hash"), named("_f").alias("form_hash"), F.col("_rows").alias("rows"), F.col("_forms").alias("forms"))
