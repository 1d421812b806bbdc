"""Interfaces of what runs outside Spark: generators, embedders, tokenizers. Only stand-ins without a model are here."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class CueGenerator:
    """Answers by cues: an aspect is positive where one of its cues occurs."""

    def __init__(self, cues: dict[str, list[str]]) -> None:
        self.cues = cues

    def generate(self, prompts: list[str]) -> list[str]:
        import json

        return [json.dumps({a: "positive" for a, cs in self.cues.items() if any(c in p.lower() for c in cs)}) for p in prompts]


def generate(df: DataFrame, prompt: str, make, batch: int = 32) -> DataFrame:
    """df with raw_generation, from make() -> Generator, one generator for each task, in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in parts:
            texts = pdf[prompt].fillna("").tolist()
            yield pdf.assign(raw_generation=[g for i in range(0, len(texts), batch) for g in model.generate(texts[i : i + batch])])

    fields = ", ".join(f"`{k}` {t}" for k, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, raw_generation string")
