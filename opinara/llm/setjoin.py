"""Exact set-similarity join on hashes of canonical records, for records too many for pairwise comparison.

Records are sets of tokens.  Two records go together when common / (distinct of both) >= tau, that is, when the
Hamming distance of the sets is at most (1 - tau) / (1 + tau) * (|x| + |y|).  The steps:

1.  Every record is reduced to a hash of its canonical token set; equal hashes are one class, and only one record of
    a class goes on, so that copies cost nothing further.
2.  A sketch of 2^20 to 2^24 counters, by the number of records, counts the rows that hold each token.  It gives one
    order of all tokens, rare ones first.  Two similar records share a token among the first |x| - ceil(tau |x|) + 1
    of each.
3.  Each record sends a hash key for each of these tokens.  A token that the sketch counts more than ``hot`` times is
    sent in pairs with the tokens after it, up to one place further: if it is the first common token, the second
    common one is there in both.  Pairs that a second sketch counts more than ``hot`` times are sent in threes the
    same way.  Tokens counted once are not sent.  So that the keys of a record grow with its length and not with a
    power of it, records of PART tokens and more are cut into parts by the tokens' hashes, two to the power that
    their size gives; in some part the records are as similar as they are altogether, and each part sends keys by
    itself.  A record whose shorter partners may have another number of parts sends keys for both.
4.  Records that meet at a key are pruned by their sizes, by the places of the token, and by a 128-bit parity image
    of their sets: chains of consecutive segments must keep their cumulative differences within the proportional
    budgets (the pigeonring principle), then the whole image must stay within the distance.
5.  What is left is compared token by token.

No step drops a pair that reaches tau: 2 to 4 are necessary conditions, 5 is the definition.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.plans.runtime import cut, join_with_hot

BITS, MOST_BITS = 20, 24
CHUNK = 12
#: Tokens from which on a record is cut into parts, and the least tokens of a part on average.
PART, LEAST = 128, 32
#: Across roles, a token is hot beyond one in so many records; pairs of key rows that are compared at a time.
RARE, AT_ONCE = 400, 1 << 19
TokenMaker = Callable[[], Callable[[object], list[str]]]


class _Hashes(dict):
    """64-bit hashes of tokens, kept for the next records."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        v = self[token] = xxhash.xxh3_64_intdigest(token)
        return v


def _sets(values: list, tokens: Callable[[object], list[str]], known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens of all values one after another; how many each value has, and how many with repeats."""
    flat = array("Q")
    sizes, totals = [], []
    for v in values:
        t = tokens(v)
        s = set(t)
        flat.extend(map(known.__getitem__, s))
        sizes.append(len(s))
        totals.append(len(t))
    return np.frombuffer(flat, np.uint64) if flat else np.zeros(0, np.uint64), np.array(sizes, np.int64), np.array(totals, np.int64)


def _set_hashes(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits for each set, whatever the order of its tokens: two sums of mixed token hashes."""
    ends = np.cumsum(sizes)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(flat, salt).view(np.uint64), dtype=np.uint64)]) for salt in (1, 0x5BD1E995)]
    both = np.stack([x[ends] - x[ends - sizes] for x in sums], axis=1)
    return [r.tobytes() for r in both]


def _cut(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each record's tokens as bytes."""
    raw, ends = flat.tobytes(), 8 * np.cumsum(sizes)
    return [raw[e - 8 * k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _sketch_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counters as chunks that hold anything: numbers and compressed counts."""
    import zlib

    parts = counts.reshape(-1, 1 << CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    return pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())


def _count(counts: np.ndarray, hashes: np.ndarray) -> None:
    at, n = np.unique(hashes.view(np.uint64) & np.uint64(len(counts) - 1), return_counts=True)
    counts[at.astype(np.int64)] += n.astype(np.uint32)


def records(df: DataFrame, rid: str, value: str, role: Column, make: TokenMaker, bits: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """(recs, sketch): recs has rid, rec binary, size, total, role, tokens binary (null unless ``keep``); sketch has the token counters by chunk. One pass, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, h = make(), _Hashes()
        counts = np.zeros(1 << bits, np.uint32)
        names = ["rid", "rec", "size", "total", "role", "tokens", "chunk", "counts"]
        for b in batches:
            flat, sizes, totals = _sets(b.column(1).to_pylist(), tokens, h)
            _count(counts, flat)
            n = b.num_rows
            held = pa.array(_cut(flat, sizes), pa.binary()) if keep else pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_set_hashes(flat, sizes), pa.binary()), pa.array(sizes, pa.int32()), pa.array(totals, pa.int32()), b.column(2), held, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        used, blobs = _sketch_rows(counts)
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.binary()), used, blobs], names=names)

    both = cut(
        df.select(F.col(rid).cast("long").alias("rid"), F.col(value).alias("value"), role.cast("int").alias("role"))
        .mapInArrow(run, "rid long, rec binary, size int, total int, role int, tokens binary, chunk int, counts binary")
    )
    return both.where("chunk is null").drop("chunk", "counts"), both.where("chunk is not null").select("chunk", "counts")


def counters(sketch: DataFrame, bits: int) -> np.ndarray:
    """The sketch as one array of 2^bits short numbers: counts up to 255, larger ones in steps of a sixty-fourth of a doubling."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(1 << CHUNK, np.uint64)
        for b in batches:
            for blob in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(blob), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_level(total).tobytes()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << bits, np.uint16)
    # 2^bits counters at most, whatever the size of the data
    for r in sketch.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r.chunk << CHUNK : (r.chunk + 1) << CHUNK] = np.frombuffer(r.counts, np.uint16)
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """Counts below 256 as they are, larger ones on a logarithmic scale; keeps their order."""
    big = 256 + 64 * (np.log2(np.maximum(n, 256).astype(float)) - 8)
    return np.where(n < 256, n, np.minimum(big, 65535)).astype(np.uint16)


def _mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a + (b * np.uint64(0xC2B2AE3D27D4EB4F) if isinstance(b, np.ndarray) else np.uint64(b))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _parts(sizes: np.ndarray) -> np.ndarray:
    """Numbers of parts of records of these sizes: powers of two, 1 below PART tokens."""
    return np.where(sizes < PART, 1, np.left_shift(1, np.log2(np.maximum(sizes, PART) / LEAST + 1e-12).astype(np.int64)))


def _images(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity images: bit i tells whether a set has an odd number of tokens whose hash falls on i."""
    bit = (flat >> np.uint64(40)).astype(np.int64) & 127
    image = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 128 + bit, minlength=len(sizes) * 128).astype(np.uint8).reshape(-1, 128)
    return np.packbits(image & 1, axis=1, bitorder="little").view(np.int64).reshape(-1, 2)


def _keys(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray, marks: np.ndarray | None, tau: float, hot: int, count: bool = False) -> tuple[np.ndarray, ...]:
    """row, key, local: the keys that records send; local holds the part's size, and its place less the common tokens before it.

    With ``count``, only the pairs that hot tokens form are returned, for the sketch of pairs.
    """
    # of two similar records, the longer one has the shorter one's number of parts as its own or as that of its least partner
    variants = [_parts(np.ceil(tau * sizes - 1e-9).astype(np.int64)), _parts(sizes)]
    use = [np.ones(len(sizes), bool), variants[1] != variants[0]]
    starts = np.cumsum(sizes) - sizes
    owner = np.concatenate([np.flatnonzero(u) for u in use])
    parts = np.concatenate([v[u] for v, u in zip(variants, use, strict=True)])
    n = sizes[owner]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = flat[np.repeat(starts[owner], n) + inner]
    many = np.repeat(parts, n)
    group = np.repeat(np.cumsum(parts) - parts, n) + ((flat >> np.uint64(47)).astype(np.int64) & (many - 1))
    level = levels[(flat & np.uint64(len(levels) - 1)).astype(np.int64)]
    order = np.lexsort((flat, (group << 16) | level))
    flat, level, group, many = flat[order], level[order], group[order], many[order]
    local = np.bincount(group, minlength=int(parts.sum()))
    first = np.cumsum(local) - local
    need = np.ceil(tau * local - 1e-9).astype(np.int64)
    row_of = np.repeat(owner, parts)
    hot_level = int(_level(np.array([hot]))[0])
    token = _mix(flat, np.where(many > 1, many.astype(np.uint64) * np.uint64(0x9E3779B1), np.uint64(0))).view(np.uint64)

    at = np.flatnonzero(np.arange(len(flat)) - first[group] < local[group] - need[group] + 1)
    key, is_hot = token[at], level[at] > hot_level
    alone = level[at] <= 1
    done = [(at[~is_hot & ~alone], key[~is_hot & ~alone], 1)]
    at, key = at[is_hot], key[is_hot]
    for depth in (2, 3):
        if depth == 3:
            stop = np.ones(len(at), bool) if marks is None else ~marks[(key & np.uint64(len(marks) - 1)).astype(np.int64)]
            done.append((at[stop], key[stop], 2))
            at, key = at[~stop], key[~stop]
        g = group[at]
        # where fewer tokens have to be common, there may be no further one
        end = need[g] < depth
        done.append((at[end], key[end], depth - 1))
        at, key, g = at[~end], key[~end], g[~end]
        last = first[g] + np.minimum(local[g] - need[g] + depth, local[g]) - 1
        times = np.maximum(last - at, 0)
        before = np.repeat(np.arange(len(at)), times)
        at = at[before] + 1 + np.arange(len(before)) - np.repeat(np.cumsum(times) - times, times)
        key = _mix(key[before], token[at]).view(np.uint64)
        if count:
            return (key,)
    done.append((at, key, 3))
    at = np.concatenate([x[0] for x in done])
    key = np.concatenate([x[1] for x in done])
    depth = np.repeat([x[2] for x in done], [len(x[0]) for x in done])
    g = group[at]
    place = at - first[g] - (depth - 1)
    return row_of[g], key.view(np.int64), (local[g] << 32) | np.maximum(place, 0)


def _budget(tau: float, n: Column) -> Column:
    return F.floor(n * ((1 - tau) / (1 + tau)) + 1e-9)


def _ring(tau: float) -> Column:
    """Two neighbouring segments of the parity image, of four in a ring, keep their cumulative differences within the proportional budgets.

    Of sets within the distance n, some segment differs in at most n / 4 places and, with the one after it, in at
    most 2 n / 4. The second sum is only formed where the first one passes.
    """
    x = [F.col("x.b1").bitwiseXOR(F.col("y.b1")), F.col("x.b2").bitwiseXOR(F.col("y.b2"))]
    d = [F.bit_count(h) for w in x for h in (F.shiftrightunsigned(w, 32), F.shiftleft(w, 32))]
    total = _budget(tau, F.col("x.size") + F.col("y.size"))
    ok = F.lit(False)
    for i in range(4):
        ok = ok | ((d[i] * 4 <= total) & ((d[i] + d[(i + 1) % 4]) * 2 <= total))
    return ok


def links(df: DataFrame, rid: str, value: str, role: Column, make: TokenMaker, tau: float, min_total: int = 0, across: bool = False, hot: int = 1024, ring: bool = True, few: int = 1_000_000, refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of df.

    rid is a unique long, value what ``make`` turns into tokens, role a bit set (1 or 2; a class has the roles of all
    its records).  members has rid, cls, role, size: every record with the least rid of its class.  links has a < b,
    classes with different token sets that reach tau; with across only those where one class has role 1 and the
    other role 2.  Records with fewer than min_total tokens (repeats counted), and those without any token, are in no
    class.  The copies to leave out when keys are sent go to all tasks if they are at most ``few``, and are joined
    away otherwise.  Keys that many records send are split between tasks by the adaptive skew join.  With ``refine``
    the token hashes are written with the records, 8 bytes for each token, and hot pairs are counted and sent in threes;
    without, the values are turned into tokens again and pairs are sent as they are.
    """
    context = df.sparkSession.sparkContext
    rows = df.count()
    bits = min(MOST_BITS, max(BITS, (max(rows, 1) - 1).bit_length()))
    # what is compared at a key is cheap across roles, so the keys of a record stay as few as the table grows
    hot = max(hot, rows // RARE) if across else hot
    recs, sketch = records(df, rid, value, role, make, bits, refine)
    levels = context.broadcast(counters(sketch, bits))
    recs = recs.where((F.col("size") > 0) & (F.col("total") >= min_total))
    classes = recs.groupBy("rec").agg(F.min("rid").alias("cls"), F.bit_or("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    # a record alone in its class needs no partner; a class of very many records is sent to all tasks
    copied = cut(classes.where("n > 1"))
    plain = recs.select("rid", "rec", "role", "size")
    known = join_with_hot(plain, copied, "rec", "n")
    single = F.coalesce("cls", "rid").alias("cls"), F.coalesce("roles", "role").alias("roles"), F.coalesce("n", F.lit(1).cast("long")).alias("n")
    members = cut(known.select("rid", single[0], "role", single[1], "size", single[2]))
    others = members.where("rid <> cls").select("rid")
    held = recs.select("rid", "tokens", "role") if refine else df.select(F.col(rid).cast("long").alias("rid"), F.col(value).alias("tokens"), role.cast("int").alias("role"))
    if others.limit(few + 1).count() <= few:
        skip = context.broadcast(_numbers(others))
        sent = held
    else:
        skip = None
        sent = held.select("rid", "tokens").join(members.where("rid = cls").select("rid", F.col("roles").alias("role")), "rid")

    def sets(b: pa.RecordBatch, tokens: Callable[[object], list[str]], h: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, roles, tokens one after another and sizes of the records that stand for their classes."""
        if skip is not None and len(skip.value) and b.num_rows:
            ids = b.column(0).to_numpy()
            b = b.filter(pa.array(~_isin(ids, skip.value)))
        if refine:
            held = b.column(1).to_pylist()
            return b.column(0).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(held), np.uint64), np.array([len(x) // 8 for x in held], np.int64)
        flat, sizes, totals = _sets(b.column(1).to_pylist(), tokens, h)
        good = (totals >= min_total) & (sizes > 0)
        return b.column(0).to_numpy()[good], b.column(2).to_numpy()[good], flat[np.repeat(good, sizes)], sizes[good]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            _, _, flat, sizes = sets(b, None, None)
            _count(counts, _keys(flat, sizes, levels.value, None, tau, hot, count=True)[0])
        yield pa.RecordBatch.from_arrays(list(_sketch_rows(counts)), names=["chunk", "counts"])

    marks = None
    if refine and levels.value.max(initial=0) > int(_level(np.array([hot]))[0]):
        pairs = counters(sent.mapInArrow(count, "chunk int, counts binary"), bits)
        marks = context.broadcast(pairs > int(_level(np.array([hot]))[0]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, h = make(), _Hashes()
        for b in batches:
            ids, roles, flat, sizes = sets(b, tokens, h)
            # a batch at a time, as long records send many keys
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 200_000)) + at)
                mine = sizes[at:end]
                start = int(sizes[:at].sum())
                own = flat[start : start + int(mine.sum())]
                row, key, local = _keys(own, mine, levels.value, None if marks is None else marks.value, tau, hot)
                image = _images(own, mine)
                row_ = row + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids[row_]), pa.array(image[row, 0]), pa.array(image[row, 1]), pa.array(mine[row], pa.int32()), pa.array(local), pa.array(roles[row_], pa.int32())],
                    names=["key", "rid", "b1", "b2", "size", "local", "role"],
                )
                at = end

    posted = sent.mapInArrow(post, "key long, rid long, b1 long, b2 long, size int, local long, role int")
    if across and skip is not None:
        # a class has its members' roles: what its copies add is known from the copied classes alone, at most ``few``
        posted = posted.join(F.broadcast(copied.select(F.col("cls").alias("c"), "roles")), F.col("rid") == F.col("c"), "left").select("key", "rid", "b1", "b2", "size", "local", F.coalesce("roles", "role").alias("role"))
    if across:
        found = cut(_met(posted, tau, ring).distinct())
        return members, _verified(held.select("rid", "tokens"), found, None if refine else make, tau, few)
    x, y = posted.alias("x"), posted.alias("y")
    size = F.col("x.size") + F.col("y.size")
    whole = lambda s: F.shiftright(f"{s}.local", 32)
    rest = lambda s: whole(s) - F.col(f"{s}.local").bitwiseAND(F.lit((1 << 32) - 1))
    apart = F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))
    # some part has its own share of common tokens, and the key is the first of them there
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")) & (F.least(rest("x"), rest("y")) >= F.ceil((whole("x") + whole("y")) * (tau / (1 + tau)) - 1e-9))
    meets &= F.least("x.size", "y.size") >= F.ceil(size * (tau / (1 + tau)) - 1e-9)
    if ring:
        meets &= _ring(tau)
    meets &= apart <= _budget(tau, size)
    found = cut(x.join(y, meets).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct())
    return members, _verified(held.select("rid", "tokens"), found, None if refine else make, tau, few)


def _ring_of(d: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """As ``_ring``, of the differences of the four segments in the columns of d."""
    return np.any((d * 4 <= budget[:, None]) & ((d + np.roll(d, -1, axis=1)) * 2 <= budget[:, None]), axis=1)


def _meet(rows: list[np.ndarray], tau: float, ring: bool) -> tuple[np.ndarray, np.ndarray]:
    """a, b: pairs of different records, one of either role, that the rows of whole keys, in order of key and side, leave for comparison.

    Of two records that meet, the one with the shorter part needs its first common token within the first
    w - ceil(2 tau / (1 + tau) w) + 1 of its own, as the other part has w tokens at least: only such rows look for others.
    """
    key, side, rid, b1, b2, size, local = rows
    part = local >> 32
    rest = part - (local & 0xFFFFFFFF)
    total = 2 * int(max(part.max(initial=0), size.max(initial=0))) + 1
    need = np.ceil(np.arange(total) * (tau / (1 + tau)) - 1e-9).astype(np.int64)
    budget = np.floor(np.arange(total) * ((1 - tau) / (1 + tau)) + 1e-9).astype(np.int64)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(begins[1:], len(key))
    group = np.repeat(np.arange(len(begins)), ends - begins)
    # where the sides 1 and 2 begin in each key
    firsts = [begins + np.bincount(group[side < s], minlength=len(begins)) for s in (1, 2)]
    at = np.flatnonzero(rest >= need[2 * part])
    g = group[at]
    low = np.where(side[at] == 0, firsts[0][g], begins[g])
    high = np.where(side[at] == 2, firsts[1][g], ends[g])
    at, low, many = at[high > low], low[high > low], (high - low)[high > low]
    until, done, out = np.cumsum(many), 0, []
    while done < len(at):
        end = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + AT_ONCE, "right")))
        n = many[done:end]
        x = np.repeat(at[done:end], n)
        y = np.arange(n.sum()) + np.repeat(low[done:end] - (np.cumsum(n) - n), n)
        done = end
        both = need[part[x] + part[y]]
        ok = (part[x] <= part[y]) & (rest[x] >= both) & (rest[y] >= both)
        x, y = x[ok], y[ok]
        sizes = size[x] + size[y]
        ok = (np.minimum(size[x], size[y]) >= need[sizes]) & (rid[x] != rid[y])
        x, y, most = x[ok], y[ok], budget[sizes[ok]]
        words = np.stack([b1[x] ^ b1[y], b2[x] ^ b2[y]], axis=1).view(np.uint64)
        ok = np.bitwise_count(words).sum(axis=1, dtype=np.int64) <= most
        if ring:
            halves = np.stack([words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)], axis=2).reshape(-1, 4)
            ok &= _ring_of(np.bitwise_count(halves).astype(np.int64), most)
        out.append((np.minimum(rid[x], rid[y])[ok], np.maximum(rid[x], rid[y])[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _met(posted: DataFrame, tau: float, ring: bool) -> DataFrame:
    """a < b: records of different roles that meet at a key and aren't pruned, in one pass over the keys in order; a pair may come several times.

    In a self-join, all rows of a key would be held against all; here only rows of the one role with a short prefix
    are held against those of the other.
    """
    names = ["key", "side", "rid", "b1", "b2", "size", "local"]
    # the records of one role, of both, of the other
    sided = posted.withColumn("side", F.when(F.col("role") == 1, 0).when(F.col("role") == 3, 1).otherwise(2)).select(*names)

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _meet(rows, tau, ring)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy().astype(np.int64, copy=False) for c in b.columns]
            held.append(rows)
            last = rows[0][-1]
            if held[0][0][0] == last:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.flatnonzero(whole[0] != last)[-1]) + 1
            held = [[c[end:] for c in whole]]
            yield pairs([c[:end] for c in whole])
        if held:
            yield pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    return sided.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "a long, b long")


def _numbers(df: DataFrame) -> np.ndarray:
    """The longs of a column, in order."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64))


def _isin(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the numbers are among the known ones, which are in order."""
    if not len(known):
        return np.zeros(len(numbers), bool)
    return known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers


def _verified(recs: DataFrame, found: DataFrame, make: TokenMaker | None, tau: float, few: int) -> DataFrame:
    """Of the pairs found, those whose whole token sets reach tau."""
    ids = found.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    wanted = None
    if ids.limit(few + 1).count() <= few:
        # 8 bytes for each number; a broadcast join would keep rows and a hash table of them on the driver
        wanted = recs.sparkSession.sparkContext.broadcast(_numbers(ids))
        words = recs if make else recs.mapInArrow(lambda batches: (b.filter(pa.array(_isin(b.column(0).to_numpy(), wanted.value))) for b in batches), recs.schema)
    else:
        words = recs.join(ids, "rid", "left_semi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common >= math.ceil(tau * (len(s) + len(t) - common) - 1e-9))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, h = make(), _Hashes()
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(_isin(b.column(0).to_numpy(), wanted.value)))
            flat, sizes, _ = _sets(b.column(1).to_pylist(), tokens, h)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_cut(flat, sizes), pa.binary())], names=["rid", "tokens"])

    words = words if make is None else words.mapInArrow(sets, "rid long, tokens binary")
    pairs = (
        found.join(words.select(F.col("rid").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(words.select(F.col("rid").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")
    )
    return cut(pairs.mapInArrow(compare, "a long, b long"))
