"""Sizes of texts in tokens of a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from opinara.llm.p1_tokens import PATTERN, VOCABULARY, _ranks


def with_tokens(df: DataFrame, text: str, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens (long; 0 for null and empty texts), one row per row of df, in one pass over Arrow batches."""

    # the file of the vocabulary is read on the driver only
    ranks = df.sparkSession.sparkContext.broadcast(_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    kept = df.select(*keys, text)
    names = kept.columns[:-1]
    return kept.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1]) + ", n_tokens long")
