"""Token budget per source, language and domain: every document's tokens under an existing byte-pair vocabulary.

The text is cut into pieces by the vocabulary's own pattern; distinct pieces are few against their occurrences.  They
are sorted by range into partitions, where each partition walks its prefix trie depth first: neighbours in byte order
share their prefixes, so the walk keeps one state for each byte of the current path and only goes on from the place
where a piece leaves the one before.  The state of a prefix is its last token and its number of tokens, and it is
exact: a sequence of tokens is the encoding of its bytes if, and only if, every two neighbours are the encoding of
their own bytes, so exactly one vocabulary suffix of a prefix can follow the state before it.

The terminal counts then go back to the documents: those of the most frequent pieces, of any length (``KNOWN`` at
most, of ``KNOWN_CHARACTERS`` together) as a table in every task, the others by a join on the piece.  No piece outside
the table is frequent, so no join key is hot.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.labels import language_code
from opinara.plans.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN, KNOWN_CHARACTERS = 1 << 18, 1 << 24
HELD = 200_000


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _pattern(pattern: str = PATTERN):
    import regex

    return regex.compile(pattern)


class TrieWalk:
    """Token counts of byte strings given in byte order, from the states of the prefixes they share."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.ranks = ranks
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pairs: dict[tuple[int, int], bool] = {}
        self.path = b""
        self.last = [-1]
        self.count = [0]

    def follows(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = list(self.encode(self.bytes[a] + self.bytes[b])) == [a, b]
        return known

    def tokens(self, piece: bytes) -> int:
        shared = 0
        for x, y in zip(piece, self.path):
            if x != y:
                break
            shared += 1
        last, count, ranks = self.last, self.count, self.ranks
        del last[shared + 1 :], count[shared + 1 :]
        self.path = piece
        for end in range(shared + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                t = ranks.get(piece[start:end])
                if t is not None and (start == 0 or self.follows(last[start], t)):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary has no encoding of {piece[:end]!r}")
        return count[-1]


def piece_tokens(texts: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """piece, n, tokens: the distinct pieces of all texts, their occurrences and their numbers of tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = _pattern().findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(find(t))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    # the file of the vocabulary is read on the driver only
    ranks = texts.sparkSession.sparkContext.broadcast(_ranks(vocabulary))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieWalk(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([trie.tokens(p.encode()) for p in b.column(0).to_pylist()], pa.int32())], names=["piece", "n", "tokens"])

    counted = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return cut(counted.repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(walk, "piece string, n long, tokens int"))


def _frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """The tokens of the most frequent pieces; a level of frequency is taken as a whole or not at all, and pieces of over 256 characters only where they are many."""
    step = F.floor(F.log2("n") * 8).cast("int") - F.greatest(F.lit(0), F.floor(F.log2(F.length("piece") / 32) * 8).cast("int"))
    levels = sorted(((r.level, r.n, r.size) for r in pieces.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece")).alias("size")).collect()), reverse=True)
    least, total, size = None, 0, 0
    for level, n, characters in levels:
        total, size = total + n, size + characters
        if total > most or size > KNOWN_CHARACTERS:
            break
        least = level
    if least is None:
        return {}
    found = pieces.where(step >= least).select("piece", "tokens").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def document_tokens(df: DataFrame, text: str, keys: list[str], vocabulary: str = VOCABULARY, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(base, extra): the tokens of a document are its ``tokens`` in base and those of its pieces in extra together.

    base has keys and tokens (long, 0 for null and empty texts), one row per row of df; extra has keys and tokens for
    each occurrence of a piece outside the table.  Sum both by whatever is wanted; ``totals`` does so by document.
    """
    pieces = piece_tokens(df, text, vocabulary)
    table = df.sparkSession.sparkContext.broadcast(_frequent(pieces, known))
    n = len(keys)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, get = _pattern().findall, table.value.get
        for b in batches:
            sums, rest = [], []
            for t in b.column(n).to_pylist():
                ps = find(t) if t else []
                got = list(map(get, ps))
                if None in got:
                    rest.append([p for p, g in zip(ps, got) if g is None])
                    got = [g for g in got if g is not None]
                else:
                    rest.append(None)
                sums.append(sum(got))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string()))], names=[*names, "tokens", "rest"])

    kept = df.select(*keys, text)
    names = kept.columns[:-1]
    fields = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    base = cut(kept.mapInArrow(look, f"{fields}, tokens long, rest array<string>"))
    extra = base.where("rest is not null").select(*names, F.explode("rest").alias("piece")).join(pieces.select("piece", F.col("tokens").cast("long").alias("tokens")), "piece").select(*names, "tokens")
    return base.select(*names, "tokens"), extra


def totals(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens: one row per document, when keys tell documents apart."""
    return base.unionByName(extra).groupBy(*keys).agg(F.sum("tokens").alias("tokens"))


def token_budget(df: DataFrame, text: str = "text", source: str = "source", language: str = "language", domain: str = "domain", vocabulary: str = VOCABULARY, known: int = KNOWN) -> DataFrame:
    """slice, source, language, domain, documents, blank, tokens.

    One row for each source, language and domain together (slice 'cell'), for each of the three by itself, and for
    everything ('all'); columns that a slice doesn't tell apart are null there.  language is the code that the label
    names, whatever its spelling, 'other' where it names a language besides those, 'none' where it names none.  Null sources and domains are shown as
    '(none)'.  blank counts documents without text: null or only white space; the tokens of white space count.
    """
    named: list[Column] = [F.coalesce(source, F.lit("(none)")).alias("source"), language_code(F.col(language)).alias("language"), F.coalesce(domain, F.lit("(none)")).alias("domain")]
    keys = ["source", "language", "domain"]
    rows = df.select(*named, F.col(text).alias("_text"), F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", F.lit(True)).alias("blank"))
    base, extra = document_tokens(rows, "_text", [*keys, "blank"], vocabulary, known)
    one = lambda d, n, b: d.select(*keys, "tokens", n.cast("long").alias("documents"), b.cast("long").alias("blank"))
    every = one(base, F.lit(1), F.col("blank").cast("int")).unionByName(one(extra, F.lit(0), F.lit(0)))
    cells = every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("documents", "blank", "tokens")))
    sets = cells.groupingSets([[F.col(k) for k in keys], *([F.col(k)] for k in keys), []], *(F.col(k) for k in keys))
    levels = {0: "cell", 3: "source", 5: "language", 6: "domain", 7: "all"}
    level = F.col("_g")
    name = F.when(level == 0, "cell")
    for g, v in list(levels.items())[1:]:
        name = name.when(level == g, v)
    return sets.agg(F.grouping_id().alias("_g"), *(F.sum(c).alias(c) for c in ("documents", "blank", "tokens"))).select(name.alias("slice"), *keys, "documents", "blank", "tokens")
