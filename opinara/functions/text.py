"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out one time however often use names it."""
    return F.transform(F.array(value), use)[0]


def normalize(text: Column) -> Column:
    """Ends stripped, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def blank_separated(text: Column) -> Column:
    """Number of parts between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def ngrams(text: Column, n: int = 5) -> Column:
    """Set of word n-grams of the normalised text; empty for fewer than n words."""

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return _once(words(normalize(text)), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def span_supported(span: Column, text: Column) -> Column:
    """The span stands in the text, or four fifths of its words over two characters do; empty spans don't."""
    parts = F.struct(normalize(span).alias("s"), normalize(text).alias("t"))

    def check(x: Column) -> Column:
        words_hit = lambda long: (F.size(long) > 0) & (F.size(F.filter(long, lambda w: F.contains(x["t"], w))) >= 0.8 * F.size(long))
        return F.when(F.coalesce(x["s"], F.lit("")) == "", False).otherwise(F.contains(x["t"], x["s"]) | _once(F.filter(words(x["s"]), lambda w: F.length(w) > 2), words_hit))

    return _once(parts, check)


def preview(text: Column, n: int = 260) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "), 1, n)


def contains_any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def parse_number(text: Column) -> Column:
    """Trimmed number; null for 'none'."""
    return F.nullif(F.trim(text), F.lit("none")).cast("double")


def render(template: str, values: dict[str, Column]) -> Column:
    """Literal replacement of {name}, one name after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def canonical_json(labels: Column) -> Column:
    """Compact JSON of a string map, keys sorted, other characters kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def strip_thinking(text: Column) -> Column:
    """What follows the last closed reasoning block."""
    return F.substring_index(text, "</think>", -1)


def left(text: Column, n: int = 8000) -> Column:
    return F.left(text, F.lit(n))
