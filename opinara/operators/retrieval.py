"""Choice of demonstrations for each query: nearest, random, fixed, and diverse by maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.arith import md5_uniform
from opinara.functions.schema import MMR_LAMBDA, MMR_LAMBDA_OTHER
from opinara.plans.runtime import global_rank


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query_id, key, sim, rank: the k nearest rows of the corpus by dot product, a row itself excluded; ties by key.

    Queries and corpus are cut by a hash into blocks of about ``block`` rows, and each pair of blocks is one matrix product,
    in double, that keeps k candidates for each query; the candidates of all corpus blocks are then ranked. What is
    shuffled is k rows for each query and corpus block, not all pairs. Null vectors take no part.
    """
    kind = dict(queries.dtypes)[key]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
        n = max(1, -(-rows.count() // block))
        return rows.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).alias("p")).agg(F.collect_list(F.struct("q", "v")).alias(name)).select(name)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qrows, crows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                qv, cv = (np.array([r["v"] for r in rows], np.float64) for rows in (qrows, crows))
                qk, ck = np.array([r["q"] for r in qrows]), np.array([r["q"] for r in crows])
                sims = np.round(qv @ cv.T, 6)
                sims[qk[:, None] == ck[None, :]] = -np.inf
                out = []
                for i in range(len(qk)):
                    top = np.lexsort((ck, -sims[i]))[:k]
                    out += [(qk[i].item(), ck[j].item(), float(sims[i, j])) for j in top if np.isfinite(sims[i, j])]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["query_id", "cand", "sim"]), schema=shape, preserve_index=False)

    shape = pa.schema([("query_id", pa.int64() if kind in ("bigint", "int") else pa.string()), ("cand", pa.int64() if kind in ("bigint", "int") else pa.string()), ("sim", pa.float64())])
    named = "long" if kind in ("bigint", "int") else "string"
    found = blocks(queries, "qs").crossJoin(blocks(corpus, "cs")).mapInArrow(best, f"query_id {named}, cand {named}, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "cand")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("cand", key)


def random_fixed(corpus: DataFrame, key: str, k: int, seed: int, balance: str | None = None) -> DataFrame:
    """key, rank: one random set for all queries, taken in turn from the values of balance where given."""
    u = md5_uniform(F.lit(str(seed)), F.col(key).cast("string"))
    rows = corpus.select(key, *([balance] if balance else []), u.alias("u"))
    if balance:
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(balance).orderBy("u", key))).where(F.col("turn") <= k)
        order = [F.col("turn"), F.col(balance), F.col("u")]
    else:
        order = [F.col("u"), F.col(key)]
    top = rows.orderBy(*order).limit(k)
    return top.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def random_dynamic(queries: DataFrame, corpus: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """query_id, key, rank: k rows of a random order of the corpus, from a place that depends on the query, itself excluded.

    The corpus is numbered once in a random order; a query takes the numbers after its own random start, so each row
    of the result is one lookup and no pair is formed that isn't chosen.
    """
    n = corpus.count()
    numbered = global_rank(corpus.select(key), [md5_uniform(F.lit(str(seed)), F.col(key).cast("string")), key], "i")
    start = F.floor(md5_uniform(F.lit(f"{seed}q"), F.col(key).cast("string")) * n).cast("long")
    wants = queries.select(F.col(key).alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(min(k, n - 1)))).alias("j"), start.alias("s")).select("query_id", "j", (F.pmod(F.col("s") + F.col("j"), F.lit(n)) + 1).alias("i"))
    got = wants.join(numbered, "i").where(F.col("query_id") != F.col(key))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("j"))).where(F.col("rank") <= k).select("query_id", key, "rank")


def bank(hard: DataFrame, k: int) -> DataFrame:
    """The first k of an ordered bank (rank, id)."""
    return hard.where(F.col("rank") <= k)


def base_score(sim: Column, same_language: Column, cues: Column, hard: Column, fit: Column) -> Column:
    """Weighted relevance of a candidate. The weights are fixed values."""
    return 0.72 * sim + 0.06 * same_language.cast("double") + 0.14 * cues + 0.05 * hard + 0.03 * fit


def greedy_mmr(base: np.ndarray, sims: np.ndarray, k: int, lam: float, near: float = 0.92) -> list[int]:
    """Places chosen one after the other: base against similarity to what is chosen.

    A candidate nearer than ``near`` to a chosen one is passed over while more candidates are left than places; the
    first of equal scores wins; it ends early when all are passed over.
    """
    left, chosen = list(range(len(base))), []
    closest = np.full(len(base), -np.inf)
    while len(chosen) < k and left:
        spare = len(left) > k - len(chosen)
        ok = [i for i in left if not (chosen and closest[i] > near and spare)]
        if not ok:
            break
        score = [lam * base[i] - ((1 - lam) * closest[i] if chosen else 0.0) for i in ok]
        best = ok[int(np.argmax(score))]
        chosen.append(best)
        left.remove(best)
        closest = np.maximum(closest, sims[:, best])
    return chosen


def mmr(candidates: DataFrame, k: int, pool: int = 50, normalise: bool = False) -> DataFrame:
    """query_id, cand, sim, base, rank from candidates (query_id, cand, sim, same_language, cues, hard, fit, vec).

    Candidates are the nearest of each query, as many as the prefilter lets through. With normalise, similarity is
    scaled to 0..1 within a query's candidates. The pool best by base (ties by cand) go through greedy_mmr in one group of at most
    ``pool`` rows; the result is ordered from least to most similar.
    """
    if normalise:
        w = Window.partitionBy("query_id")
        low, high = F.min("sim").over(w), F.max("sim").over(w)
        scaled = F.when(high > low, (F.col("sim") - low) / (high - low)).otherwise(1.0)
    else:
        scaled = F.col("sim")
    scored = candidates.withColumn("base", base_score(scaled, F.col("same_language"), F.col("cues"), F.col("hard"), F.col("fit")))
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "cand"))).where(F.col("n") <= pool)
    kinds = dict(candidates.dtypes)
    lam = MMR_LAMBDA.get(k, MMR_LAMBDA_OTHER)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        v = np.array(pdf["vec"].tolist(), np.float64)
        chosen = greedy_mmr(pdf["base"].to_numpy(), v @ v.T, k, lam)
        out = pdf.iloc[chosen].sort_values(["sim", "cand"], ascending=[True, False])
        return out.assign(rank=np.arange(1, len(out) + 1))[["query_id", "cand", "sim", "base", "rank"]]

    return top.select("query_id", "cand", "sim", "base", "n", "vec").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, cand {kinds['cand']}, sim double, base double, rank int")


def hard_mix(from_bank: DataFrame, chosen: DataFrame, k: int, share: int = 2) -> DataFrame:
    """query_id, cand, rank, method: up to ``share`` bank examples first, the others by mmr, each candidate once."""
    both = from_bank.where(F.col("rank") <= share).select("query_id", "cand", F.lit(0).alias("side"), F.col("rank").alias("r")).unionByName(chosen.select("query_id", "cand", F.lit(1).alias("side"), (-F.col("rank")).alias("r")))
    once = both.groupBy("query_id", "cand").agg(F.min(F.struct("side", "r")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x", "cand")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "cand", "rank", F.when(F.col("x.side") == 0, "bank").otherwise("mmr").alias("method"))


def selection_stats(chosen: DataFrame, top: int = 10) -> DataFrame:
    """cand, uses, mean_sim of the candidates chosen most often; ties by cand."""
    return chosen.groupBy("cand").agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("sim"), 4).alias("mean_sim")).orderBy(F.desc("uses"), "cand").limit(top)


def cue_coverage(text: Column, cues: Column) -> Column:
    """Hits of a list of cues, repeats counted, over the distinct cues."""
    return F.size(F.filter(cues, lambda c: F.contains(F.lower(text), c))) / F.greatest(F.size(F.array_distinct(cues)), F.lit(1))
