"""Missing or wrong language labels: the languages of every document and of its segments, with a confidence.

Hierarchical discrimination: one linear support vector machine tells the language family, further ones tell the
languages within it, one against one.  All work on the sum of what the words of a text weigh, so a task weighs each
distinct word once.  The machines are fitted on the driver on the sentences of about ``sample`` labelled rows of each language (by a
hash of the row); sentences whose labels a first fit contradicts are left out of the second one.  Every row is then
classified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import canon
from opinara.llm.labels import LANGUAGES, language_code

FAMILIES = {"germanic": ("en", "de"), "romance": ("es", "ca", "fr")}
#: (a, b): positive for a.
MACHINES = (("germanic", "romance"), ("en", "de"), ("es", "ca"), ("es", "fr"), ("ca", "fr"))
DIMENSIONS = 1 << 16
SAMPLE = 300
WORD = re.compile(r"[^\W\d_]+")
END = re.compile(r"[.!?…]+[\"'”»)\]]*\s+")
END_OR_TAG = re.compile(END.pattern + r"|<[^<>]*>")
LINE = re.compile(r"[\r\n]+")
#: The first 256 characters in lower case, all but letters as blanks.
LOWER = "".join(c.lower() if c.isalpha() else " " for c in map(chr, range(256))).encode("latin-1", "replace")
CHUNK = 12
SHARE = 0.22
SURE = 1.0
#: Least words of a passage in a language that the document isn't written in, and how much surer it has to be.
PASSAGE, PLAIN = 6, 1.5


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes): the places of each word's character sequences up to three long, ends marked, and of the word itself."""
    from zlib import crc32

    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(w) for w in marked])
    whole = np.array([crc32(w.encode()) for w in marked], np.uint32)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    last = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(codes))
    owner = np.repeat(np.arange(len(words)), sizes)
    places, owners = [whole], [np.arange(len(words))]
    gram = np.zeros(len(codes), np.uint32)
    for n in (1, 2, 3):
        # a sequence starts where n characters of the same word are left
        gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :] * np.uint32(0x9E3779B1)
        inside = (at + n <= last)[: len(gram)]
        mixed = gram[inside] ^ (gram[inside] >> np.uint32(15))
        places.append(mixed * np.uint32(0x85EBCA6B))
        owners.append(owner[: len(gram)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(places)[order] >> np.uint32(8)).astype(np.int64) & (DIMENSIONS - 1), np.bincount(owners, minlength=len(words))


def words_of(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(LOWER).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def segments(text: str) -> list[str]:
    """Sentences; what has no sentence ends is cut at its lines or, if these are no sentences either, every CHUNK words."""
    out = []
    for s in (END_OR_TAG if "<" in text else END).split(text):
        if len(s) < 12 * CHUNK:
            out.append(s)
            continue
        lines = [x for x in LINE.split(s) if x.strip()]
        if len(lines) > 1 and len(s.split()) >= 4 * len(lines):
            out += lines
        else:
            ws = s.split()
            out += [" ".join(ws[i : i + CHUNK]) for i in range(0, len(ws), CHUNK)]
    return out


class Plain:
    """Texts in their consistent form, so that odd characters don't hide words."""

    def __init__(self, table: dict[str, str]) -> None:
        self.skeleton = canon.skeleton(table)
        self.odd = self.skeleton.sure | self.skeleton.maybe

    def __call__(self, text: str) -> str:
        import unicodedata

        if text.isascii() or self.odd.isdisjoint(text):
            return text
        return unicodedata.normalize("NFC", self.skeleton.of(text))


def _fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, rounds: int = 5, cost: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    diag = 1 / (2 * cost)
    order = np.random.default_rng(seed)
    norm = np.array([v @ v for v in values]) + diag
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i]) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def _side(machine: tuple[str, str], language: str) -> int:
    a, b = (FAMILIES.get(x, (x,)) for x in machine)
    return 1 if language in a else -1 if language in b else 0


class Model:
    """Weights of the machines on the places of features, and what turns their margins into confidences."""

    def __init__(self, weights: np.ndarray, slopes: np.ndarray) -> None:
        self.weights, self.slopes = weights, slopes
        self.rows: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((1024, self.values([]).shape[1]))

    def __reduce__(self):
        return type(self), (self.weights, self.slopes)

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to the sums: a row for each word."""
        out = np.zeros((len(words), len(self.weights)))
        if words:
            places, sizes = features(words)
            firsts = np.cumsum(sizes) - sizes
            for m in range(len(self.weights)):
                out[:, m] = np.add.reduceat(self.weights[m][places], firsts)
        return out

    def word_rows(self, words: list[str]) -> list[int]:
        known = self.rows
        new = [w for w in set(words) if w not in known]
        if new:
            start = len(known)
            known.update(zip(new, range(start, start + len(new)), strict=True))
            while len(known) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[start : start + len(new)] = self.values(new)
            self.held += sum(map(len, new))
        return [known[w] for w in words]

    def trim(self) -> None:
        """Forget the words met so far once they are many, or long."""
        if len(self.rows) > 300_000 or self.held > 30_000_000:
            self.rows.clear()
            self.held = 0

    def sums(self, word_lists: list[list[str]]) -> np.ndarray:
        """Sum of the words' weights, for each list of words and machine."""
        sizes = np.array([len(x) for x in word_lists], np.int64)
        flat = self.word_rows([w for x in word_lists for w in x])
        cum = np.zeros((len(flat) + 1, self.scores.shape[1]))
        np.cumsum(self.scores[flat], axis=0, out=cum[1:])
        ends = np.cumsum(sizes)
        return cum[ends] - cum[ends - sizes]


def decide(sums: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES for rows of machine sums."""
    germanic = sums[:, 0] > 0
    es = np.minimum(sums[:, 2], sums[:, 3])
    ca = np.minimum(-sums[:, 2], sums[:, 4])
    fr = np.minimum(-sums[:, 3], -sums[:, 4])
    romance = np.argmax(np.stack([es, ca, fr]), axis=0) + 1
    return np.where(germanic, np.where(sums[:, 1] > 0, 0, 4), romance)


def confidence(sums: np.ndarray, language: np.ndarray, counts: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Product of the probabilities that the machines involved give; a machine's margin is divided by the root of the number of words."""
    p = np.ones(len(sums))
    z = sums / np.sqrt(np.maximum(counts, 1))[:, None] * slopes
    for m, machine in enumerate(MACHINES):
        side = np.array([_side(machine, x) for x in LANGUAGES])[language]
        p *= np.where(side == 0, 1.0, 1 / (1 + np.exp(-np.clip(z[:, m] * side, -30, 30))))
    return p


def fit(df: DataFrame, text: str, label: str, row: str, sample: int = SAMPLE, seeds: dict[str, str] | None = None) -> Model:
    """The machines, fitted on at most about ``sample`` labelled rows of each language and on the sentences in seeds.

    A language without rows and seeds is never chosen.
    """
    table = canon.look_alikes(df.sparkSession)
    code = language_code(F.col(label))
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(code.alias("c"), "n").groupBy("c").agg(F.sum("n")).collect()}
    part = F.pmod(F.xxhash64(F.col(row)), F.lit(1 << 30)) / float(1 << 30)
    take = F.lit(False)
    for x in LANGUAGES:
        if counts.get(x):
            take = take | ((code == x) & (part < min(1.0, sample / counts[x])))
    rows = df.where(F.col(text).isNotNull() & take).select(code.alias("c"), F.col(text).alias("t"), F.col(row).alias("r")).toArrow().to_pylist()
    rows.sort(key=lambda x: x["r"])
    rows += [{"c": c, "t": t} for c, t in (seeds or {}).items()]
    plain = Plain(table)
    index, values, lists, labels = [], [], [], []
    for r in rows:
        for s in segments(plain(r["t"])):
            ws = words_of(s)
            if ws:
                i, n = np.unique(features(ws)[0], return_counts=True)
                index.append(i)
                values.append(n / np.linalg.norm(n))
                lists.append(ws)
                labels.append(r["c"])
    labels = np.array(labels)
    keep = np.ones(len(labels), bool)
    for _ in range(2):
        weights = np.zeros((len(MACHINES), DIMENSIONS))
        for m, machine in enumerate(MACHINES):
            y = np.array([_side(machine, x) for x in labels])
            use = np.flatnonzero((y != 0) & keep)
            if len(set(y[use])) == 2:
                weights[m] = _fit([index[i] for i in use], [values[i] for i in use], y[use].astype(float))
            elif len(use):
                weights[m, :] = y[use[0]] * 1e-6
        model = Model(weights, np.ones(len(MACHINES)))
        sums = model.sums(lists) if lists else np.zeros((0, len(MACHINES)))
        keep = np.array([LANGUAGES[x] for x in decide(sums)]) == labels if len(labels) else keep
    # a margin that one kept row in a hundred doesn't reach stands for a probability of 0.99
    root = np.sqrt(np.maximum([len(x) for x in lists], 1))
    slopes = np.ones(len(MACHINES))
    for m, machine in enumerate(MACHINES):
        y = np.array([_side(machine, x) for x in labels])
        use = (y != 0) & keep
        if use.any():
            z = np.quantile(sums[use, m] * y[use] / root[use], 0.01)
            slopes[m] = 4.6 / max(z, 1e-3)
    return Model(weights, slopes)


SEGMENTS = "array<struct<segment:int,words:int,lang:string,confidence:double>>"


def languages(df: DataFrame, text: str, keys: list[str], model: Model, share: float = SHARE, sure: float = SURE) -> DataFrame:
    """keys, langs array<struct<lang, share, confidence>>, segments array: one row per row of df.

    A document has the language of its words together, and every other one whose sentences hold at least ``share`` of
    the words and weigh, on average, more than ``sure`` for it on the machine that tells it from the first.  Foreign
    words within sentences and names don't make a further language.  Null, blank and wordless texts have empty arrays.
    segments are the runs of neighbouring sentences in one language, also of passages that hold less than ``share``;
    a document of one language is one segment.  A text in none of the five gets the one it is nearest to.
    """
    table = canon.look_alikes(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    n = len(keys)
    kept = df.select(*keys, text)
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, plain = shared.value, Plain(table)
        for b in batches:
            m.trim()
            texts = b.column(n).to_pylist()
            owner, lists = [], []
            for i, t in enumerate(texts):
                if t:
                    for s in segments(plain(t)):
                        ws = words_of(s)
                        if ws:
                            owner.append(i)
                            lists.append(ws)
            sums = m.sums(lists)
            counts = np.array([len(x) for x in lists], np.int64)
            chosen = decide(sums) if len(lists) else np.zeros(0, np.int64)
            owner = np.array(owner, np.int64)
            starts = np.searchsorted(owner, np.arange(len(texts)))
            ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
            langs, parts = _Rows(), _Rows()
            cum = np.concatenate([np.zeros((1, len(MACHINES))), np.cumsum(sums, axis=0)])
            words = np.concatenate([[0], np.cumsum(counts)])
            total, size = cum[ends] - cum[starts], words[ends] - words[starts]
            main = decide(total)
            same = np.concatenate([[0], np.cumsum(chosen != np.repeat(main, ends - starts))])
            plainly = same[ends] == same[starts]
            for i in range(len(texts)):
                a, z = starts[i], ends[i]
                if a < z and plainly[i]:
                    langs.add(main[i], 1.0, size[i], total[i])
                    parts.add(main[i], 1.0, size[i], total[i])
                elif a < z:
                    found = document(sums[a:z], counts[a:z], chosen[a:z], share, sure)
                    for x, w, t in found:
                        langs.add(x, w, w * size[i], t)
                    for x, w, t in _runs(sums[a:z], counts[a:z], chosen[a:z], [x for x, _, _ in found], sure):
                        parts.add(x, 1.0, w, t)
                langs.end()
                parts.end()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), langs.languages(m.slopes), parts.segments(m.slopes)], names=[*names, "langs", "segments"])

    fields = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{fields}, langs array<struct<lang:string,share:double,confidence:double>>, segments {SEGMENTS}")


def _gap(sums: np.ndarray, x: int, other: int) -> np.ndarray:
    """How much rows weigh for x against other."""
    a, b = LANGUAGES[x], LANGUAGES[other]
    for m, machine in enumerate(MACHINES):
        s, t = _side(machine, a), _side(machine, b)
        if s and t and s != t:
            return sums[:, m] * s
    raise AssertionError


def _best(sums: np.ndarray, among: list[int]) -> np.ndarray:
    """The language among these that each row weighs most for, against every other one of them."""
    least = [np.min([_gap(sums, x, y) for y in among if y != x], axis=0) for x in among]
    return np.array(among)[np.argmax(least, axis=0)]


def document(sums: np.ndarray, counts: np.ndarray, chosen: np.ndarray, share: float, sure: float) -> list[tuple[int, float, np.ndarray]]:
    """(language, share of the words, sums) of the languages that the sentences of a document are written in, the main one first."""
    total = sums.sum(axis=0, keepdims=True)
    words = counts.sum()
    main = int(decide(total)[0])
    if (chosen != chosen[0]).any() or chosen[0] != main:
        weight = np.bincount(chosen, counts, len(LANGUAGES)) / words
        main = int(np.argmax(weight)) if weight.max() > 0.5 else main
        among = [main]
        for x in map(int, np.flatnonzero(weight >= share)):
            at = chosen == x
            if x != main and _gap(sums[at], x, main).sum() / np.sqrt(counts[at].sum()) > sure:
                among.append(x)
        while len(among) > 1:
            own = _best(sums, among)
            held = {x: counts[own == x].sum() / words for x in among}
            low = min(among, key=lambda x: (held[x], -x))
            if held[low] >= share:
                return [(x, float(held[x]), sums[own == x].sum(axis=0)) for x in among]
            among.remove(low)
        main = among[0]
    return [(main, 1.0, total[0])]


def _runs(sums: np.ndarray, counts: np.ndarray, chosen: np.ndarray, found: list[int], sure: float) -> list[tuple[int, int, np.ndarray]]:
    """(language, words, sums) of the runs of neighbouring sentences in one language.

    Sentences are in one of the document's languages, or in another one where a run of them, of PASSAGE words or
    more, plainly is, whatever its share of the document.
    """
    own = np.full(len(counts), found[0]) if len(found) == 1 else _best(sums, found)
    cuts = [0, *(np.flatnonzero(np.diff(chosen)) + 1), len(chosen)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        x, words = int(chosen[a]), counts[a:z].sum()
        if x not in found and words >= PASSAGE and min(_gap(sums[a:z], x, int(y)).sum() for y in set(own[a:z])) / np.sqrt(words) > PLAIN * sure:
            own[a:z] = x
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
    return [(int(own[a]), int(counts[a:z].sum()), sums[a:z].sum(axis=0)) for a, z in zip(cuts, cuts[1:], strict=False)]


class _Rows:
    """Lists of results, one for each text, as flat columns."""

    def __init__(self) -> None:
        self.lang, self.share, self.words, self.sums, self.offsets = [], [], [], [], [0]

    def add(self, lang: int, share: float, words: float, sums: np.ndarray) -> None:
        self.lang.append(int(lang))
        self.share.append(share)
        self.words.append(words)
        self.sums.append(sums)

    def end(self) -> None:
        self.offsets.append(len(self.lang))

    def _columns(self, slopes: np.ndarray) -> tuple[pa.Array, pa.Array]:
        lang = np.array(self.lang, np.int64)
        sure = confidence(np.array(self.sums).reshape(-1, len(MACHINES)), lang, np.array(self.words, float), slopes)
        return pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(LANGUAGES)).cast(pa.string()), pa.array(sure)

    def languages(self, slopes: np.ndarray) -> pa.Array:
        lang, sure = self._columns(slopes)
        rows = pa.StructArray.from_arrays([lang, pa.array(self.share, pa.float64()), sure], names=["lang", "share", "confidence"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), rows)

    def segments(self, slopes: np.ndarray) -> pa.Array:
        lang, sure = self._columns(slopes)
        place = np.arange(len(lang)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        rows = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(np.array(self.words).astype(np.int32)), lang, sure], names=["segment", "words", "lang", "confidence"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), rows)


def document_languages(df: DataFrame, row: str = "row_no", label: str = "language", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """row, label code, langs, segments for every row of df."""
    model = fit(df, text, label, row, sample)
    return languages(df.withColumn("_label", language_code(F.col(label))), text, [row, "_label"], model)


def wrong_labels(found: DataFrame, row: str = "row_no") -> DataFrame:
    """row, lang: the languages of the documents whose label is missing, names another language, or that are written in two."""
    case = (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("langs")[0]["lang"] != F.col("_label")))
    return found.where(case).select(F.col(row), F.explode("langs").alias("l")).select(row, F.col("l.lang").alias("lang"))
