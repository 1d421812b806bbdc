"""Tolerant parsing of generated text into label maps, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.schema import ASPECTS, POLARITIES

#: Pieces of a written value: brackets and signs, strings in either quotes, anything else up to the next sign.
_PIECE = re.compile(r"""[\[\]{}:,]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s\[\]{}:,"]+"?|\S""", re.S)
_OPENING = re.compile(r"[\[{]")
_STRAIGHT = str.maketrans("“”", '""')
_UNDERSCORES = str.maketrans("- ", "__")
#: What bare words stand for.
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None} | {p: p for p in POLARITIES}
_NONE = object()


class _Group:
    """An object or list that is being read: its place, what it holds, and what may come next."""

    __slots__ = ("at", "held", "key", "want")

    def __init__(self, at: int, bracket: str) -> None:
        self.at, self.held, self.key = at, {} if bracket == "{" else [], _NONE
        #: item (or the end), colon, value, or sign (comma or the end)
        self.want = "item"

    def take(self, value: object) -> bool:
        """Put a value where one is due."""
        if isinstance(self.held, list) and self.want in ("item", "value"):
            self.held.append(value)
        elif self.want == "value":
            self.held[self.key] = value
        elif self.want == "item" and isinstance(value, str):
            self.key, self.want = value, "colon"
            return True
        else:
            return False
        self.want = "sign"
        return True


def _word(piece: str, group: _Group) -> object:
    """A string, number or bare word as a value; names may be bare or lack their first quote where a key is due."""
    if piece[0] == '"' == piece[-1] and len(piece) > 1:
        try:
            return json.loads(piece, strict=False)
        except ValueError:
            return piece[1:-1]
    if piece[0] == "'" == piece[-1] and len(piece) > 1:
        return piece[1:-1].replace("\\'", "'")
    if isinstance(group.held, dict) and group.want == "item":
        name = piece.removesuffix('"')
        return name if name.isidentifier() and name.isascii() else _NONE
    if piece in _WORDS:
        return _WORDS[piece]
    try:
        return float(piece)
    except ValueError:
        return _NONE


def written_values(text: str) -> list[tuple[int, object]]:
    """(place, value) of every object and list that is written out somewhere in the text, in one pass over its pieces.

    Groups that are open stand on a stack and are given to the one around them once they close. What can't go on
    where it stands closes nothing: the open groups are dropped, those that had closed inside them remain, and
    reading goes on at the next bracket. Brackets within strings are looked into as well.
    """
    text = text.translate(_STRAIGHT)
    found: list[tuple[int, object]] = []
    stack: list[_Group] = []
    at = 0
    while True:
        m = _PIECE.search(text, at) if stack else _OPENING.search(text, at)
        if m is None:
            return found
        piece, start, at = m[0], m.start(), m.end()
        if piece in "{[":
            if stack and stack[-1].want not in ("item", "value") or stack and isinstance(stack[-1].held, dict) and stack[-1].want == "item":
                stack.clear()
            stack.append(_Group(start, piece))
            continue
        top = stack[-1]
        if piece in "}]":
            whole = top.want in ("sign", "item") and isinstance(top.held, dict) == (piece == "}")
            if whole:
                found.append((top.at, top.held))
                stack.pop()
            if not whole or stack and not stack[-1].take(top.held):
                stack.clear()
        elif piece == "," and top.want == "sign":
            top.want = "item"
        elif piece == ":" and top.want == "colon":
            top.want = "value"
        else:
            value = _word(piece, top) if piece not in ",:" else _NONE
            if value is _NONE or not top.take(value):
                # running text: go on behind its first character, where a bracket may follow
                stack.clear()
                at = start + 1
            elif len(piece) > 2 and piece[0] in "\"'" and _OPENING.search(piece):
                found += [(start + 1 + i, v) for i, v in written_values(piece[1:-1])]


def _pairs(value: object) -> Iterator[tuple[object, object]]:
    """(aspect, polarity) as they are written, valid or not."""
    either = lambda x, a, b: x.get(a) or x.get(b)
    match value:
        case dict():
            for aspect, polarity in value.items():
                yield aspect, either(polarity, "polarity", "sentiment") if isinstance(polarity, dict) else polarity
        case list():
            for x in filter(lambda x: isinstance(x, dict), value):
                yield either(x, "aspect", "category"), either(x, "polarity", "sentiment")


def labels_of(value: object) -> dict[str, str]:
    """The valid pairs of a value; the last one of an aspect holds."""
    clean = ((a.strip().lower().translate(_UNDERSCORES), p.strip().lower()) for a, p in _pairs(value) if isinstance(a, str) and isinstance(p, str))
    return {a: p for a, p in clean if a in ASPECTS and p in POLARITIES}


def read_labels(text: str | None) -> dict[str, str]:
    """The labels of the value that begins last, of those that have some or are an empty object: behind the reasoning if there is one, else anywhere."""
    behind = (text or "").rpartition("</think>")
    for part in (behind[2], text) if behind[1] else behind[2:]:
        last = max(((at, labels) for at, value in written_values(part) if (labels := labels_of(value)) or value == {}), key=lambda x: x[0], default=None)
        if last:
            return last[1]
    return {}


#: A text with one flat object and no other bracket, in straight quotes.
_LONE = re.compile(r"[^\[{}\]]*(\{[^\[{}\]“”']*\})[^\[{}\]]*")


def quick_labels(text: str | None) -> dict[str, str]:
    """read_labels, with strict JSON where one flat object is all there is behind the reasoning."""
    lone = _LONE.fullmatch(text.rpartition("</think>")[2]) if text else None
    if lone:
        try:
            value = json.loads(lone[1])
        except ValueError:
            value = None
        if value == {} or value and (labels := labels_of(value)):
            return labels if value else {}
    return read_labels(text)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def extract_labels(text: pd.Series) -> pd.Series:
    """Generated text -> label map; empty where nothing can be read. In Arrow batches."""
    return text.map(quick_labels, na_action=None)


def first_object(text: str | None) -> dict:
    """The object from the first brace to its match, whatever stands in strings; empty if it can't be read."""
    start = text.find("{") if text else -1
    depth = 0
    for i in range(max(start, 0), len(text or "") if start >= 0 else 0):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            try:
                value = json.loads(text[start : i + 1].replace("“", '"').replace("”", '"'))
            except json.JSONDecodeError:
                return {}
            return value if isinstance(value, dict) else {}
    return {}


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def extract_entities(text: pd.Series) -> pd.Series:
    """Generated text -> entity type to names, of the first object."""
    names = lambda v: [str(x) for x in v if x is not None] if isinstance(v, list) else [str(v)]
    return text.map(lambda t: {str(k): names(v) for k, v in first_object(t).items() if v is not None}, na_action=None)


def flatten(value: object, prefix: str = "") -> list[str]:
    """Leaves as prefix:value, objects add .key to the prefix, lists keep it, nulls vanish."""
    if value is None:
        return []
    if isinstance(value, dict):
        return [y for k, v in value.items() for y in flatten(v, f"{prefix}.{k}")]
    if isinstance(value, list):
        return [y for v in value for y in flatten(v, prefix)]
    return [f"{prefix}:{value}"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def flatten_json(text: pd.Series) -> pd.Series:
    """JSON text -> its flattened leaves; empty where it isn't JSON."""

    def one(t: str | None) -> list[str]:
        try:
            return flatten(json.loads(t)) if t else []
        except json.JSONDecodeError:
            return []

    return text.map(one, na_action=None)


def flatten_map(labels: Column) -> Column:
    """The same for a map of strings, without leaving the JVM."""
    return F.transform(F.map_entries(labels), lambda e: F.concat(F.lit("."), e["key"], F.lit(":"), e["value"]))


def normalize_labels(labels: Column) -> Column:
    """A string map's valid pairs: names trimmed, in lower case, blanks and hyphens as underscores."""
    clean = F.transform(F.map_entries(labels), lambda e: F.struct(F.translate(F.lower(F.trim(e["key"])), "- ", "__").alias("key"), F.lower(F.trim(e["value"])).alias("value")))
    valid = F.filter(clean, lambda e: e["key"].isin(ASPECTS) & e["value"].isin(POLARITIES))
    # entries are kept from the last one of a key
    last = F.filter(valid, lambda e, i: ~F.exists(F.slice(valid, i + 2, F.greatest(F.size(valid), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def resolved(normalized: Column, raw: Column) -> Column:
    """The labels that hold: the normalised ones where there are some on record, else the raw ones, else none."""
    return F.coalesce(normalized, raw, F.create_map().cast("map<string,string>"))


def other_aspects(labels: Column) -> Column:
    """The aspects that a map doesn't name, in the order of the vocabulary."""
    return F.array_except(F.array(*map(F.lit, ASPECTS)), F.map_keys(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def gold_items_reason(items: Column) -> Column:
    """Why an array of (aspect, polarity, ...) isn't a strict label map: null if it is."""
    aspects = F.transform(items, lambda x: x["aspect"])
    return (
        F.when(items.isNull(), "gold_items is not a list")
        .when(F.exists(items, lambda x: x.isNull()), "gold item is not an object")
        .when(F.exists(items, lambda x: ~F.coalesce(x["aspect"].isin(ASPECTS), F.lit(False))), "invalid aspect")
        .when(F.exists(items, lambda x: ~F.coalesce(x["polarity"].isin(POLARITIES), F.lit(False))), "invalid polarity")
        .when(F.size(F.array_distinct(aspects)) < F.size(aspects), "duplicate aspect")
    )


def token_split(ids: Column, end: list[int]) -> Column:
    """struct<thinking, final, closed>: token ids before and after the first occurrence of the closing ids."""
    n = len(end)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1))), lambda i: F.slice(ids, i, n) == F.array(*map(F.lit, end)))
    at = F.when(F.size(starts) > 0, starts[0])
    return F.struct(
        F.when(at.isNotNull(), F.slice(ids, 1, at - 1)).otherwise(ids).alias("thinking"),
        F.when(at.isNotNull(), F.slice(ids, at + n, F.greatest(F.size(ids), F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("final"),
        at.isNotNull().alias("closed"),
    )
