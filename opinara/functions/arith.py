"""Zero-safe arithmetic of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole; 0 where whole isn't positive."""
    return F.when(whole > 0, F.lit(scale) * part / whole).otherwise(0.0)


def prf(predicted: Column, expected: Column, ok: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 in percent."""
    p, r = ratio(ok, predicted, 100.0), ratio(ok, expected, 100.0)
    # the harmonic mean of the two, from the counts
    return p, r, F.when((ok > 0) & (predicted + expected > 0), 200.0 * ok / (predicted + expected)).otherwise(0.0)


def composite(micro: Column, macro: Column) -> Column:
    """One figure to rank trials by."""
    return 0.75 * micro + 0.25 * macro


def rarity(count: Column, ceiling: float = 2.0) -> Column:
    """ceiling less log(1 + count), at least 0."""
    return F.greatest(F.lit(0.0), F.lit(ceiling) - F.log1p(count))


def shape_fit(length_a: Column, length_b: Column, labels_a: Column, labels_b: Column) -> Column:
    """1 for equal lengths and label counts, less for differing ones; may be negative."""
    return 1 - (F.abs(length_a - length_b) / (length_a + 1.0) + F.abs(labels_a - labels_b) / (labels_a + labels_b + 1.0)) / 2


def rounded(value: Column, digits: int) -> Column:
    """value in units of the last digit, in double, to the nearest one, halves away from zero, as DuckDB rounds; F.round goes by the decimal figures that the double is shown with."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def dot(a: Column, b: Column) -> Column:
    """Dot product of numeric arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The array over its length; zero arrays stay."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def token_budget(p99: Column, longest: Column) -> tuple[Column, Column]:
    """Candidates for a limit of tokens, from the 99th percentile and from the maximum."""
    return F.greatest(F.lit(128), F.ceil(p99 + 64)), F.greatest(F.lit(256), F.ceil(longest + 96))


def md5_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of a digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def share_in(values: Column, among: list[str]) -> Column:
    """Share of an array's values that are among these; 0 for empty and null arrays."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda v: v.isin(among))) / n).otherwise(0.0)
