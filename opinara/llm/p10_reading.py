"""Reading level of each document: sentence levels by regularised character and word models, brought together by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import canon
from opinara.llm import p3_language as lang

LEVELS = ("basic", "middle", "advanced")
#: Bounds of the sample that the models are fitted on: documents, and sentences of each, evenly spaced.
DOCUMENTS, SENTENCES = 1500, 24
#: Letters from which on a word counts as long, and as very long.
LONG, VERY_LONG = 8, 11
SCALE = 8.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True)) if z.size else z
    return e / e.sum(axis=-1, keepdims=True)


class Sentences(lang.Model):
    """A softmax over the levels on what the words of a sentence come to.

    weights has a row of hashed sequence and word weights for each level; slopes are the weights of the traits of
    ``traits`` (one row each, the offset first, a column for each level).
    """

    def values(self, words: list[str]) -> np.ndarray:
        """By level the sum of the weights of a word's sequences, their number, and the word's lengths."""
        out = np.zeros((len(words), len(LEVELS) + 5))
        if words:
            places, sizes = lang.features(words)
            firsts = np.cumsum(sizes) - sizes
            for m in range(len(LEVELS)):
                out[:, m] = np.add.reduceat(self.weights[m][places], firsts)
            out[:, 3:] = np.column_stack([sizes, lengths(words)])
        return out

    def levels(self, lists: list[list[str]]) -> np.ndarray:
        """Probabilities of the levels of sentences, given as lists of words."""
        sums = self.sums(lists)
        counts = np.array([len(x) for x in lists], float)
        return softmax(SCALE * sums[:, :3] / np.maximum(sums[:, 3:4], 1) + traits(sums[:, 4:], counts) @ self.slopes)


def lengths(words: list[str]) -> np.ndarray:
    n = np.array([len(w) for w in words], float)
    return np.column_stack([n, n * n, n >= LONG, n >= VERY_LONG])


def traits(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Traits of sentences from the sums of their words' lengths: offset, mean length, its spread, shares of long and of very long words.

    They are in the units of everyday prose, so that a model fitted on one sample reads the same everywhere.
    """
    n = np.maximum(counts, 1)[:, None]
    mean = sums / n
    spread = np.sqrt(np.maximum(mean[:, 1] - mean[:, 0] ** 2, 0))
    return np.column_stack([np.ones(len(sums)), (mean[:, 0] - 4.5) / 1.5, (spread - 2.2) / 0.8, 5 * mean[:, 2] - 0.5, 8 * mean[:, 3] - 0.2])


def units(text: str) -> list[list[str]]:
    """Sentences as lists of words; long ones in stretches of some words, so that neither length nor layout tells."""
    return [w for s in lang.segments(text) if (w := lang.words_of(s))]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, held: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with step halving, from x, on f -> (value, gradient)."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, alphas = grad.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ way))
            way -= alphas[-1] * y
        if past:
            s, y, r = past[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            way += (a - r * (y @ way)) * s
        slope, step = grad @ way, 1.0 if past else 1.0 / max(np.abs(grad).sum(), 1e-9)
        if slope <= 1e-10:
            break
        for _ in range(25):
            new, new_grad = f(x - step * way)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * way, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - held :], (s, y, 1 / (s @ y))]
        done = value - new < 1e-7 * abs(value)
        x, value, grad = x - step * way, new, new_grad
        if done:
            break
    return x


def _fit_sentences(lists: list[list[str]], y: np.ndarray, rounds: int = 40, penalty: float = 2.0, trait_penalty: float = 0.02) -> Sentences:
    """Multinomial logistic regression with L2 penalties on the sums over sentences.

    Sequences and words are penalised as so many each; the few traits hardly are, so that few anchors can settle
    them, while many anchors bring in the words.  Sentences are sums of words and words of sequences, so a step
    costs as much as the words of the sample and its distinct words' sequences.
    """
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for ws in lists for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in lists], np.int64)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lists)), sizes)
    places, grams = lang.features(list(index))
    used, places = np.unique(places, return_inverse=True)
    firsts, word_of = np.cumsum(grams) - grams, np.repeat(np.arange(len(index)), grams)
    scale = SCALE / np.add.reduceat(grams[flat], starts)
    x = traits(np.add.reduceat(lengths(list(index))[flat], starts), sizes.astype(float))
    k = len(LEVELS)

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = p[: k * len(used)].reshape(k, -1), p[k * len(used) :].reshape(-1, k)
        words = np.stack([np.add.reduceat(r[places], firsts) for r in w], axis=1)
        q = softmax(np.add.reduceat(words[flat], starts) * scale[:, None] + x @ v)
        loss = -(y * np.log(np.maximum(q, 1e-12))).sum() + penalty / 2 * (w * w).sum() + trait_penalty / 2 * (v * v).sum()
        r = q - y
        back = [np.bincount(flat, (r[:, i] * scale)[owner], len(index)) for i in range(k)]
        gw = np.stack([np.bincount(places, b[word_of], len(used)) for b in back]) + penalty * w
        return loss, np.concatenate([gw.ravel(), (x.T @ r + trait_penalty * v).ravel()])

    p = minimise(f, np.zeros(k * len(used) + x.shape[1] * k), rounds)
    weights = np.zeros((k, lang.DIMENSIONS))
    weights[:, used] = p[: k * len(used)].reshape(k, -1)
    return Sentences(weights, p[k * len(used) :].reshape(-1, k))


def summary(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the sentence levels of a document come to: offset, and the odds of basic and advanced by words and by sentences."""
    share = words / words.sum()
    odds = lambda m: np.log((m + 0.01) / (1.01 - m))
    top = np.argmax(p, axis=1)
    return np.array([1.0, *odds(share @ p[:, [0, 2]]), *odds(np.array([share[top == 0].sum(), share[top == 2].sum()]))])


def _fit_documents(x: np.ndarray, votes: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Calibration: (probabilities of the documents' levels, weights that give them from a summary with its offset).

    x are summaries (without offset) of annotated and other documents, votes how many annotators gave each level.
    The levels are normal densities with one covariance, and annotators are right with a common probability; both
    are settled by expectation maximisation, from the annotations on.  So a few wrong annotations don't outweigh
    what the documents look like, and the levels have the shares of the whole sample.  A level that no annotator
    gave is never chosen.
    """
    n, d, k = *x.shape, votes.shape[1]
    alive, total = votes.sum(axis=0) > 0, votes.sum()
    q = votes / np.maximum(votes.sum(axis=1, keepdims=True), 1)
    prior, right = np.maximum(q.sum(axis=0) / q.sum(), 0.02), 0.8
    for turn in range(rounds):
        means = (q.T @ x) / (q.sum(axis=0)[:, None] + 1e-9)
        around = [x - m for m in means]
        inverse = np.linalg.inv(sum((q[:, i : i + 1] * c).T @ c for i, c in enumerate(around)) / q.sum() + ridge * np.eye(d))
        if turn:
            prior = (q.sum(axis=0) + 1) / (q.sum() + k)
        fit_ = np.stack([-0.5 * np.einsum("ij,jk,ik->i", c, inverse, c) for c in around], axis=1)
        said = votes @ np.log(np.where(np.eye(k) > 0, right, (1 - right) / (k - 1)))
        new = softmax(np.where(alive, np.log(prior) + fit_ + said, -1e9))
        right = float(np.clip(((new * votes).sum() + 4) / (total + 5), 0.6, 0.98))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-4:
            break
    w = np.empty((d + 1, k))
    w[1:] = inverse @ means.T
    w[0] = np.where(alive, np.log(prior) - 0.5 * np.einsum("kd,de,ke->k", means, inverse, means), -1e9)
    return q, w


def fit(documents: DataFrame, anchors: DataFrame, key: str = "doc_id", text: str = "text", sample: int = DOCUMENTS) -> tuple[Sentences, np.ndarray]:
    """Sentence model and calibration, from a sample of at most about ``sample`` documents (by a hash of the key).

    Annotated documents come first; others fill the sample up, as the shares and looks of the levels are told by all
    documents and not by the few annotated ones. Repeated annotations count once. Without any usable annotation
    every document comes out at even odds.
    """
    rated = (
        anchors.where(F.col("reading_level").isin(*LEVELS)).select(F.col(key).alias("k"), "annotator", "reading_level").distinct()
        .groupBy("k").agg(*(F.count_if(F.col("reading_level") == x).alias(x) for x in LEVELS))
    )
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30)
    n = rated.count()
    rated = rated.where(part(F.col("k")) < min(1.0, sample / max(n, 1)))
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    # at most about ``sample`` rows are sent to all tasks
    known = texts.join(F.broadcast(rated), "k")
    more = max(sample - n, 0) if n else 0
    others = texts.where(part(F.col("k")) < min(1.0, more / max(documents.count(), 1))).join(F.broadcast(rated.select("k")), "k", "left_anti").select("k", "t", *(F.lit(0).cast("long").alias(x) for x in LEVELS)) if more else None
    plain, table = lang.Plain, canon.look_alikes(documents.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = plain(table)
        for b in batches:
            for r in b.to_pylist():
                us = units(make(r["t"]))
                if us:
                    at = np.unique(np.linspace(0, len(us) - 1, min(SENTENCES, len(us))).round().astype(int))
                    yield pa.RecordBatch.from_pylist([{"k": str(r["k"]), "units": [" ".join(us[i]) for i in at], "y": [float(r[x]) for x in LEVELS]}], schema=shape)

    shape = pa.schema([("k", pa.string()), ("units", pa.list_(pa.string())), ("y", pa.list_(pa.float64()))])
    picked = known if others is None else known.unionByName(others)
    rows = sorted(picked.mapInArrow(cut_up, "k string, units array<string>, y array<double>").toArrow().to_pylist(), key=lambda r: (r["k"], r["units"]))
    return learn([[u.split() for u in r["units"]] for r in rows], np.array([r["y"] for r in rows]).reshape(-1, len(LEVELS)))


def learn(lists: list[list[list[str]]], votes: np.ndarray) -> tuple[Sentences, np.ndarray]:
    """The models of documents as lists of sentences; votes are the annotators for each level, 0 of a document without.

    The annotated documents give a first model; the levels that it and the annotators together give to all documents
    of the sample are what the second one is fitted on. Calibrations see the sentence levels of models that weren't
    fitted on the same documents; every fold has its part of each level.
    """
    given = votes.sum(axis=1) > 0
    if not given.any():
        return Sentences(np.zeros((len(LEVELS), lang.DIMENSIONS)), np.zeros((5, len(LEVELS)))), np.zeros((5, len(LEVELS)))
    words = [np.array([len(u) for u in us], float) for us in lists]

    def held_out(q: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, Sentences]:
        def sentences(some: np.ndarray) -> Sentences:
            return _fit_sentences([u for d in some for u in lists[d]], np.repeat(q[some], [len(lists[d]) for d in some], axis=0))

        folds = min(len(docs), 8 if len(docs) < 400 else 3)
        fold = np.full(len(lists), -1)
        fold[docs[np.argsort(np.argmax(q[docs], axis=1), kind="stable")]] = np.arange(len(docs)) % folds
        x, whole = np.zeros((len(lists), 5)), sentences(docs)
        for f in range(-1, folds):
            mine = np.flatnonzero(fold == f)
            model = whole if f < 0 or folds < 2 else sentences(docs[fold[docs] != f]) if len(mine) else whole
            for d in mine:
                x[d] = summary(model.levels(lists[d]), words[d])
        return x[:, 1:], whole

    q = votes / np.maximum(votes.sum(axis=1, keepdims=True), 1)
    q, _ = _fit_documents(held_out(q, np.flatnonzero(given))[0], votes)
    x, model = held_out(q, np.arange(len(lists)))
    return model, _fit_documents(x, votes)[1]


def reading_levels(documents: DataFrame, anchors: DataFrame, key: str = "doc_id", text: str = "text", sample: int = DOCUMENTS) -> DataFrame:
    """key, level, difficulty, p_basic, p_middle, p_advanced, sentences: one row per document.

    Every sentence of every document is classified; difficulty is the expected level from 0 (basic) to 2 (advanced).
    Null, blank and wordless texts have level null, no probabilities and 0 sentences. Ties of levels go to the lower.
    """
    model, calibration = fit(documents, anchors, key, text, sample)
    shared = documents.sparkSession.sparkContext.broadcast((model, calibration))
    table = canon.look_alikes(documents.sparkSession)
    kept = documents.select(key, text)
    name, kind = kept.dtypes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, w), plain = shared.value, lang.Plain(table)
        for b in batches:
            m.trim()
            docs = [units(plain(t)) if t else [] for t in b.column(1).to_pylist()]
            p = m.levels([u for d in docs for u in d])
            out, at = [], 0
            for d in docs:
                out.append(softmax(summary(p[at : at + len(d)], np.array([len(u) for u in d], float)) @ w) if d else None)
                at += len(d)
            level = [None if q is None else LEVELS[int(np.argmax(q))] for q in out]
            column = lambda f: pa.array([None if q is None else float(f(q)) for q in out], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(level, pa.string()), column(lambda q: q[1] + 2 * q[2]), *(column(lambda q, i=i: q[i]) for i in range(3)), pa.array([len(d) for d in docs], pa.int32())],
                names=[name, "level", "difficulty", "p_basic", "p_middle", "p_advanced", "sentences"],
            )

    return kept.mapInArrow(run, f"`{name}` {kind}, level string, difficulty double, p_basic double, p_middle double, p_advanced double, sentences int")
