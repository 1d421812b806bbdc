"""Chat messages and training features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.schema import ASPECTS, POLARITIES
from opinara.functions.text import canonical_json, render

MESSAGES = "array<struct<role:string,content:string>>"
IGNORED = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_values(text: Column, language: Column) -> dict[str, Column]:
    return {"text": text, "language": F.coalesce(language, F.lit("unknown")), "aspects": F.lit(", ".join(ASPECTS)), "polarities": F.lit(", ".join(POLARITIES))}


def messages(system: str, user: str, text: Column, language: Column, render_system: bool = True) -> Column:
    """System and user message of a row; the system prompt stays as it is unless render_system."""
    values = prompt_values(text, language)
    return F.array(message("system", render(system, values) if render_system else F.lit(system)), message("user", render(user, values)))


def fewshot_messages(system: Column, shots: Column, user: Column) -> Column:
    """System message, (user, assistant) of each shot struct<text, gold>, and the user message."""
    turns = F.flatten(F.transform(shots, lambda s: F.array(message("user", s["text"]), message("assistant", canonical_json(s["gold"])))))
    return F.concat(F.array(message("system", system)), turns, F.array(message("user", user)))


def sft_feature(prompt_ids: Column, full_ids: Column, max_length: int, strict: bool = True) -> Column:
    """struct<input_ids, attention_mask, labels, full_length, trainable_tokens, truncated>.

    Labels are the ids themselves after the prompt and -100 on it; too long rows lose their left end. If the prompt
    isn't a prefix of the whole, strict raises an error, else the part they share counts as prompt.
    """
    n = F.size(full_ids)
    shared = F.aggregate(
        F.zip_with(prompt_ids, full_ids, lambda a, b: a == b), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s["n"] + (s["on"] & F.coalesce(x, F.lit(False))).cast("int")).alias("n"), (s["on"] & F.coalesce(x, F.lit(False))).alias("on")), lambda s: s["n"],
    )
    prompt = F.when(shared == F.size(prompt_ids), shared).otherwise(F.raise_error("the prompt is no prefix of the example").cast("int")) if strict else shared
    keep = F.least(n, F.lit(max_length))
    ids = F.slice(full_ids, n - keep + 1, keep)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORED), prompt), F.slice(full_ids, prompt + 1, F.greatest(n - prompt, F.lit(0)))), n - keep + 1, keep)
    return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), keep).alias("attention_mask"), labels.alias("labels"), n.alias("full_length"), F.size(F.filter(labels, lambda x: x != IGNORED)).alias("trainable_tokens"), (n > max_length).alias("truncated"))


def padded_feature(ids: Column, length: int, pad: int) -> Column:
    """struct<input_ids, attention_mask, labels> of a fixed length, trained throughout but for pads (and ids equal to it)."""
    cut = F.slice(ids, 1, length)
    filled = F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), F.lit(length) - F.size(cut)))
    return F.struct(filled.alias("input_ids"), mask.alias("attention_mask"), F.transform(filled, lambda x: F.when(x == pad, IGNORED).otherwise(x)).alias("labels"))


def word_ids(text: Column, size: int = 50_000) -> Column:
    """Stand-in ids for tests and profiles: a hash of each word, below size."""
    return F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % size)


def common_prefix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with shared: the length of the common prefix of two id arrays."""
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(eq, False)
    return rows.withColumn("shared", F.when(first > 0, first - 1).otherwise(F.size(eq)).cast("int"))


def entity_prompt(prompt: Column, text: Column) -> Column:
    """The user message of the entity task: the prompt and the text behind it."""
    return F.concat(prompt, F.lit("\nTEXT: "), text)
