"""A sample that matches target proportions of categories, with floors, and a report of what can't be met."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.plans.runtime import cut

BLOCK = 4000


def plain(c: str) -> Column:
    """Trimmed, in lower case, null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def tilt(counts: np.ndarray, member: np.ndarray, targets: np.ndarray, start: np.ndarray, slack: np.ndarray, rounds: int = 100) -> np.ndarray:
    """start * exp(member . lambda), lambda by Newton iterations on the exponential-tilting dual.

    The sums over the categories are the targets where slack is 0; a category with slack may miss its target by slack
    times its multiplier, so that targets that contradict each other are met as nearly as they can be together.
    """
    lam = np.zeros(len(targets))
    value = lambda x: (counts * start * np.exp(np.clip(member @ x, -50, 50))).sum() - targets @ x + (slack * x * x).sum() / 2
    for _ in range(rounds):
        p = counts * start * np.exp(np.clip(member @ lam, -50, 50))
        grad = p @ member - targets + slack * lam
        if np.abs(grad).max(initial=0) < 1e-10 * max(1.0, np.abs(targets).max(initial=0)):
            break
        step = np.linalg.lstsq((member * p[:, None]).T @ member + np.diag(slack) + 1e-12 * np.eye(len(lam)), grad, rcond=None)[0]
        step *= min(1.0, 4 / max(np.abs(step).max(initial=0), 1e-12))
        size, now = 1.0, value(lam)
        while size > 1e-6 and value(lam - size * step) > now - 1e-4 * size * (grad @ step):
            size /= 2
        lam = lam - size * step
    return start * np.exp(np.clip(member @ lam, -50, 50))


def calibrate(counts: np.ndarray, member: np.ndarray, targets: np.ndarray, start: np.ndarray | float, least: np.ndarray | None = None, slack: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of the rows of each pattern, from least to 1, whose sums over the categories are the targets.

    counts are the rows of each pattern, member[p, k] tells that pattern p is in category k, start is what the
    probabilities stay near to, in relative entropy. Patterns that would exceed 1 are fixed there and those below
    least are fixed at least, and the rest is solved again, which hands on what can't be met. A category that is
    left without free patterns keeps what they hold.
    """
    start = np.broadcast_to(np.asarray(start, float), counts.shape)
    least = np.zeros(len(counts)) if least is None else least
    slack = np.zeros(len(targets)) if slack is None else slack
    fixed = np.where((counts > 0) & (start > 0), np.nan, np.where(counts > 0, least, 0.0))
    p = np.nan_to_num(fixed)
    for _ in range(2 * len(counts) + 1):
        free = np.isnan(fixed)
        want = targets - (counts * np.nan_to_num(fixed)) @ member
        used = member[free].sum(axis=0) > 0 if free.any() else np.zeros(len(targets), bool)
        p = fixed.copy()
        # where nothing more is wanted nothing is taken
        none = free & ((member * ((want <= 0) & (slack == 0))).sum(axis=1) > 0)
        p[none] = least[none]
        solve = free & ~none
        if solve.any():
            p[solve] = tilt(counts[solve], member[np.ix_(solve, used)], np.maximum(want, 0)[used], start[solve], slack[used])
        over, under = free & (p > 1 + 1e-9), free & (p < least - 1e-9)
        if not over.any() and not under.any():
            break
        # the side that is further off first, as fixing it moves the rest
        excess, lack = (counts * (p - 1))[over].sum(), (counts * (least - p))[under].sum()
        if excess >= lack:
            fixed[over] = 1.0
        else:
            fixed[under] = least[under]
    return np.clip(p, least, 1.0)


def _pivot(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Sequential pivotal method: two units at a time settle one of them; at most one unit of the block stays open."""
    rng = np.random.default_rng((seed, int(pdf["h"].iloc[0]) & 0x7FFFFFFF, len(pdf)))
    p = pdf["p"].to_numpy().copy()
    eps = 1e-9
    held = -1
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        u = rng.random()
        if a + b < 1:
            keep, drop = (held, i) if u < a / (a + b) else (i, held)
            p[keep], p[drop] = a + b, 0.0
            held = keep
        else:
            top, rest = (held, i) if u < (1 - b) / (2 - a - b) else (i, held)
            p[top], p[rest] = 1.0, a + b - 1
            held = rest
        if p[held] <= eps or p[held] >= 1 - eps:
            p[held] = round(p[held])
            held = -1
    # what rounding leaves of whole numbers
    if held >= 0 and abs(p[held] - round(p[held])) < 1e-6:
        p[held] = round(p[held])
    return pdf.assign(p=p)


def pivotal(units: DataFrame, largest: int, seed: int) -> DataFrame:
    """units: cell, unit, p. Returns cell, unit of the chosen ones.

    Every cell is cut into blocks of about BLOCK units by a hash; a block settles all units but one, and the open
    ones of all blocks of a cell go through the same again, until a cell is one block. largest is the size of the
    largest cell. The number chosen in a cell is the sum of its probabilities, rounded up or down, and so is that of all cells together.
    """
    state = units.select("cell", "unit", "p", F.xxhash64("unit", F.lit(seed)).alias("h"))
    chosen, round_no = None, 0
    while True:
        blocks = max(1, -(-largest // BLOCK))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            return _pivot(pdf.sort_values(["h", "unit"]), seed)[["cell", "unit", "p", "h"]]

        kinds = dict(state.dtypes)
        state = cut(
            state.groupBy("cell", F.pmod(F.xxhash64("h", F.lit(round_no)), F.lit(blocks)).alias("block"))
            .applyInPandas(settle, f"cell {kinds['cell']}, unit {kinds['unit']}, p double, h long")
        )
        done = state.where("p = 1").select("cell", "unit")
        chosen = done if chosen is None else chosen.unionByName(done)
        if blocks == 1:
            break
        state, largest, round_no = state.where("p > 0 and p < 1"), blocks, round_no + 1
    # at most one unit is left of each cell: they settle each other, so that the whole number is kept
    kinds = dict(state.dtypes)
    last = cut(state.where("p > 0 and p < 1").groupBy().applyInPandas(lambda pdf: settle(pdf.sort_values(["cell", "unit"])), f"cell {kinds['cell']}, unit {kinds['unit']}, p double, h long"))
    return chosen.unionByName(last.where("p = 1 or (p > 0 and pmod(h, 1000003) / 1000003D < p)").select("cell", "unit"))


#: How far margins may be missed where floors and lack of units stand against them: the slack of each, as a part of its target.
#: In relative entropy a margin missed by d then costs d^2 / (2 SLACK target), and a cell moved by d about d^2 / (2 target).
SLACK = 0.05


def _margins(cells: list[tuple], share: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, targets, slack): everything, and each bucket, language and number of entries, as overlapping categories of the cells."""
    names = [("all", None), *dict.fromkeys((i, c[i]) for i in range(3) for c in cells)]
    member = np.array([[1.0 if i == "all" or c[i] == v else 0.0 for i, v in names] for c in cells]).reshape(len(cells), len(names))
    targets = n * share @ member
    slack = SLACK * np.maximum(targets, 1.0)
    slack[0] = 0.0
    return member, targets, slack


def quota_sample(plans: DataFrame, quota: DataFrame, fraction: float = 0.25, seed: int = 42, key: str = "plan_id", bucket: str = "bucket", language: str = "language", gold: str = "target_gold") -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    A unit is a distinct key; its category is (bucket, language, entries of gold), bucket and language trimmed and in
    lower case. Units with a null in any of these are in no category, are never drawn, and count in the total. A key
    with rows in several categories counts in each and is drawn in the least of them. Null keys are no units.

    The sample has n = floor(fraction * units) units, or as many as there are in the categories if these are fewer.
    The floors (min_rows) are kept first, as far as the units go; the rest of n is calibrated to the target shares of
    buckets, languages and numbers of entries, near to those of the categories, so that what one category can't give
    goes to its relatives. Floors of more than n units together make the sample so much larger.

    sample: key, quota_id.
    report: quota_id, available, target_share, floor_rows, wanted (share of n or the floor, whichever is more), reached (what the calibration
    to the wanted rows of every category, each by itself, can reach), short (reached is less than wanted), expected (units by
    the calibrated sample), drawn, share (of all drawn), gap (share less target_share), elsewhere (units drawn in another category).
    A quota row that repeats the category of another one shares its units, and the first of them has the sample's.
    """
    cats = quota.select(
        "quota_id", plain("bucket").alias("b"), plain("language").alias("l"), F.col("gold_labels").cast("int").alias("g"),
        F.coalesce("target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("least"),
    )
    units = plans.where(F.col(key).isNotNull()).select(F.col(key).alias("unit"), plain(bucket).alias("b"), plain(language).alias("l"), F.size(gold).alias("g")).withColumn("g", F.when(F.col("g") >= 0, F.col("g")))
    total = units.select(F.count_distinct("unit")).first()[0]
    celled = cut(units.where("b is not null and l is not null and g is not null").distinct())
    size = celled.groupBy("b", "l", "g").agg(F.count(F.lit(1)).alias("available"))
    # as many rows as there are quotas, whatever the size of plans
    rows = cats.join(size, ["b", "l", "g"], "left").select("quota_id", "b", "l", "g", "share", "least", F.coalesce("available", F.lit(0)).alias("available")).orderBy("quota_id").toPandas()
    n = int(total * fraction + 1e-9)
    spark = plans.sparkSession
    share, have = rows["share"].to_numpy(float), rows["available"].to_numpy(float)
    want = np.maximum(share * n, rows["least"].to_numpy(float))
    # what every quota by itself can reach: its category is fixed at all of its units where the tilt would exceed them
    reached = have * calibrate(have, np.eye(len(rows)), want, max(n, 1) / max(total, 1)) if len(rows) else have
    short = reached < want - 1e-9 * np.maximum(1, want)

    cells = list(dict.fromkeys((*map(_plain, c),) for c in zip(rows["b"], rows["l"], rows["g"])))
    at = {c: i for i, c in enumerate(cells)}
    own = np.array([at[(*map(_plain, c),)] for c in zip(rows["b"], rows["l"], rows["g"])], int)
    named = [(*c, i) for c, i in at.items() if c[0] and c[1] and c[2] == c[2] and c[2] is not None]
    # quota rows are few; a unit of several categories is drawn in the least of them
    table = F.broadcast(spark.createDataFrame(named, "b string, l string, g int, cell int"))
    once = cut(celled.join(table, ["b", "l", "g"]).groupBy("unit").agg(F.min("cell").alias("cell")))
    mine = np.zeros(len(cells))
    for r in once.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        mine[r.cell] = r.n
    goal, floor = np.zeros(len(cells)), np.zeros(len(cells))
    np.add.at(goal, own, share)
    np.maximum.at(floor, own, rows["least"].to_numpy(float))
    floor = np.minimum(floor, mine)
    goal = goal / goal.sum() if goal.sum() else goal
    m = min(max(n, floor.sum()), mine.sum())
    chance = np.zeros(len(cells))
    if m > 0:
        member, targets, slack = _margins(cells, goal, m)
        near = np.minimum(np.maximum(goal * m, 1e-3 * m / len(cells)) / np.maximum(mine, 1), 1.0)
        chance = calibrate(mine, member, targets, near, floor / np.maximum(mine, 1), slack)
    odds = F.broadcast(spark.createDataFrame([(i, float(p)) for i, p in enumerate(chance)], "cell int, p double"))
    drawn = pivotal(once.join(odds, "cell").select("cell", "unit", "p"), int(mine.max(initial=0)), seed)
    first = {own[i]: q for i, q in reversed(list(enumerate(rows["quota_id"])))}
    names = spark.createDataFrame([(int(c), q) for c, q in first.items()], "cell int, quota_id string")
    sample = cut(drawn.join(F.broadcast(names), "cell").select(F.col("unit").alias(key), "quota_id"))
    whole = {r.quota_id: r["count"] for r in sample.groupBy("quota_id").count().collect()}
    everything = sum(whole.values())
    lines = []
    for i, q in enumerate(rows["quota_id"]):
        c, got = own[i], whole.get(q, 0)
        mean = got / everything if everything else 0.0
        lines.append((q, int(have[i]), float(share[i]), int(rows["least"][i]), float(want[i]), float(reached[i]), bool(short[i]), float(mine[c] * chance[c]) if first[c] == q else 0.0, got, mean, mean - float(share[i]), int(have[i] - mine[c]) if have[i] else 0))
    report = spark.createDataFrame(lines, "quota_id string, available long, target_share double, floor_rows long, wanted double, reached double, short boolean, expected double, drawn long, share double, gap double, elsewhere long")
    return sample, report


def _plain(x):
    return int(x) if isinstance(x, (float, np.number)) and x == x else None if x is None or x != x else x
