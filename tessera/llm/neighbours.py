"""Nearest neighbours of every vector by cross-polytope hashing with several probes.

A bounded sample of the distinct vectors (``SAMPLE``, those of least hash) gives the mean, the
principal axes and the plan; every vector is indexed. A vector is centred and turned to the
principal axes. Its code has one digit for each level: the level's block of axes, the leading ones first, goes through
a fast pseudo-rotation (three rounds of random signs and a Hadamard transform), and the digit is
the nearest signed axis of the block's full cross-polytope. Each table has rotations of its own. A vector is stored under its
nearest code and meets what is stored under its ``probes`` nearest ones; of two vectors it is
enough that one finds the other's bucket.

Levels, tables and probes are planned, not set: for ``QUERIES`` vectors of the sample the true
neighbours among all rows are found by one pass, and the cheapest plan is taken under which so
many of those pairs meet that the true share is above ``recall`` with 95 % confidence. Probes can
go up to all buckets, which is exact, so there always is such a plan, and small tables come out exact.

What moves is small: a placement carries its vector in 16 bits a component with the scale, from
which distances follow within a proven bound. Candidates that the bound cannot tell
apart at the cut, and equal distances, are ranked again by the exact vectors and the ids; the
others need not be.

A bucket of more than ``block`` placements is dealt into blocks by vector hash, and each pair of
blocks is a cell of its own, so one crowded direction does not end in one task and loses nothing;
its work grows with the square of its size, and each of its rows is moved once for each block.

Exact copies are one vector here: they are grouped before and expanded after the search, so
groups of copies cost nothing and lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Distinct vectors the index is fitted on, and how many of them are searched to measure recall.
SAMPLE, QUERIES, RECALL = 4096, 400, 0.97
#: Greatest number of probes a table with several levels may have, and of tables.
PROBES, TABLES = 64, 12
#: Placements of a crowded bucket in one block, comparisons that cost as much as moving a
#: placement, and rows and columns compared at once.
BLOCK, MOVE, TILE = 131_072, 6000, 2048


# ---------------------------------------------------------------- hashing


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def pseudo_rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).choice(np.float32([-1, 1]), (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


#: Axes of the polytopes to choose from, by number of buckets.
LADDER = ((8,), (16,), (32,), (8, 4), (8, 8), (16, 8), (16, 16), (8, 8, 8), (16, 16, 16), (32, 32, 32))


def ladder(width: int) -> list[tuple[int, ...]]:
    """Levels to choose from; vectors of fewer than eight components have one polytope of them."""
    lead = 1 << int(math.log2(width))
    return [levels for levels in LADDER if sum(levels) <= lead] or [(min(8, lead),)]


@dataclass
class Hasher:
    """What the passes over the vectors share; its size depends on the width alone."""

    mean: np.ndarray
    frame: np.ndarray
    levels: tuple[int, ...]
    tables: int = 1
    probes: int = 1

    @property
    def buckets(self) -> int:
        return math.prod(2 * d for d in self.levels)

    def codes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the ``probes`` nearest buckets (rows x probes, nearest first), never negative."""
        y = (x - self.mean) @ self.frame
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        y = y / np.where(norm > 0, norm, 1)
        most = min(self.probes, self.buckets)
        for t in range(self.tables):
            code, loss = np.zeros((len(y), 1), np.int64), np.zeros((len(y), 1), np.float32)
            for level, dims in enumerate(self.levels):
                begin = sum(self.levels[:level])
                r = pseudo_rotate(y[:, begin : begin + dims], 1000 * t + level)
                v = np.concatenate([-r, r], axis=1)  # digit: axis, plus dims where positive
                near = np.argsort(-v, axis=1, kind="stable")[:, : min(most, 2 * dims)]
                v = np.take_along_axis(v, near, 1)
                lost = (loss[:, :, None] + ((v[:, :1] - v) ** 2)[:, None, :]).reshape(len(y), -1)
                both = (code[:, :, None] * (2 * dims) + near[:, None, :]).reshape(len(y), -1)
                if level:
                    best = np.argpartition(lost, min(most, lost.shape[1]) - 1, axis=1)[:, :most]
                    best = np.take_along_axis(best, np.argsort(np.take_along_axis(lost, best, 1), axis=1, kind="stable"), 1)
                    both, lost = np.take_along_axis(both, best, 1), np.take_along_axis(lost, best, 1)
                code, loss = both, lost
            yield code * self.tables + t

    @classmethod
    def fit(cls, sample: np.ndarray) -> Hasher:
        """Mean and principal axes of a sample."""
        mean = sample.mean(0, dtype=np.float64)
        centred = sample.astype(np.float64) - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        return cls(mean.astype(np.float32), axes[:, ::-1].astype(np.float32), (1,))

    def plan(self, n: int, sample: np.ndarray, queries: np.ndarray, q: np.ndarray, near: np.ndarray, recall: float) -> Hasher:
        """The cheapest levels, tables and probes under which the pairs (queries[q], near) meet often enough.

        The cost of a plan is its placements, each with the moves and the comparisons it causes.
        Without a pair everything is one's neighbour, and all buckets are probed.
        """
        best, least, worse = self._with(ladder(len(self.mean))[0]), math.inf, 0
        best.probes = best.buckets
        for levels in ladder(len(self.mean)) if len(q) else ():
            before, worse = least, worse + 1
            stored, wide = self._with(levels, TABLES), self._with(levels, TABLES)
            wide.probes = min(wide.buckets, PROBES) if len(levels) > 1 else wide.buckets
            if worse > 3 or wide.buckets > max(4 * n, 4 * levels[0]):
                break  # three times no better, or hardly a vector in a bucket
            first = np.full(len(q), wide.probes, np.int64)
            for t, (a, b, own) in enumerate(zip(wide.codes(queries), wide.codes(near), stored.codes(sample)), 1):
                _, share = np.unique(own[:, 0], return_counts=True)
                crowd = n * float(((share / len(sample)) ** 2).sum())
                if t * (1 + crowd / MOVE) >= least:
                    break
                a, last = a[q], np.ones((len(q), 1), bool)
                hit, back = (np.concatenate([z, last], 1).argmax(1) for z in (b[:, :1] == a, a[:, :1] == b))
                first = np.minimum(first, np.minimum(hit, back))
                met = np.cumsum(np.bincount(first, minlength=wide.probes + 1)[: wide.probes]) / len(q)
                good = np.flatnonzero(met - 1.645 * np.sqrt(met * (1 - met) / len(q)) >= recall)
                if len(good) and t * (good[0] + 1) * (1 + crowd / MOVE) < least:
                    least, best = t * (good[0] + 1) * (1 + crowd / MOVE), self._with(levels, t, int(good[0]) + 1)
            worse = worse if least == before else 0
        return best

    def _with(self, levels: tuple[int, ...], tables: int = 1, probes: int = 1) -> Hasher:
        return Hasher(self.mean, self.frame, levels, tables, probes)


# ---------------------------------------------------------------- rounded vectors


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit components and the scale of each row; no component is off by more than half a scale."""
    scale = (np.abs(x).max(1) / 32767).astype(np.float32)
    safe = np.where(scale > 0, scale, 1)[:, None]
    return np.rint(x.astype(np.float64) / safe).clip(-32767, 32767).astype(np.int16), scale


def off_by(scale: np.ndarray, width: int) -> np.ndarray:
    """Greatest distance of a vector from its rounded one."""
    return scale.astype(np.float64) * (0.503 * math.sqrt(width))


# ---------------------------------------------------------------- blocks


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """For each column its k-th least entry or a little more, infinite where it has fewer.

    The least of every few rows stand for their rows.
    """
    r, c = d.shape
    if r < k:
        return np.full(c, np.inf, np.float32)
    cells = max(1, min(8, r // (4 * k)))
    least = d[: r - r % cells].reshape(cells, -1, c).min(axis=0) if cells > 1 else d
    return np.partition(np.ascontiguousarray(least.T), k - 1, axis=1)[:, k - 1]


def _kth_of_rows(d: np.ndarray, k: int) -> np.ndarray:
    """The same for each row."""
    r, c = d.shape
    if c < k:
        return np.full(r, np.inf, np.float32)
    cells = max(1, min(8, c // (4 * k)))
    least = d[:, : c - c % cells].reshape(r, cells, -1).min(axis=1) if cells > 1 else d
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def block_pairs(stored: np.ndarray, side: np.ndarray, x: np.ndarray, err: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (row of, row near, distance of the rounded vectors) among what met in one cell.

    Stored rows meet all others, rows that probe meet the stored ones. Rows of side 0 meet each
    other; those of side 1 meet those of side 2 only. Of each row those are kept that may be
    among its k nearest here, by its bound and the others'.
    """
    sq = np.einsum("ij,ij->i", x, x)
    ones = np.ones((len(x), 1), np.float32)
    left, right = np.hstack([x, ones, sq[:, None]]), np.hstack([-2 * x, sq[:, None], ones])  # their product is the squares
    cut = np.full(len(x), np.inf, np.float32)  # no less than the k-th least square, by what was seen
    slack = 2 * (err + err.max(initial=0))
    noise = 8e-6 * (sq + sq.max(initial=0))  # squares are in single precision
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bound(rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            high = (np.sqrt(np.maximum(cut[rows] + noise[rows], 0)) + slack[rows]) ** 2 + noise[rows]
        return np.minimum(high, 3e38).astype(np.float32)  # what is set infinite is never within

    def cross(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        for j in range(0, len(b), TILE):
            near = b[j : j + TILE]
            y = np.ascontiguousarray(right[near].T)
            for i in range(0, len(a), TILE):
                of = a[i : i + TILE]
                d = left[of] @ y
                if own and i == j:
                    np.fill_diagonal(d, np.inf)
                cut[of] = np.minimum(cut[of], _kth_of_rows(d, k))
                at = np.flatnonzero(d <= bound(of)[:, None])
                found.append((of[at // len(near)], near[at % len(near)], d.ravel()[at]))
                if not own:
                    cut[near] = np.minimum(cut[near], _kth(d, k))
                    at = np.flatnonzero(d <= bound(near)[None, :])
                    found.append((near[at % len(near)], of[at // len(near)], d.ravel()[at]))

    at = lambda keep, z: np.flatnonzero(keep & (side == z))
    cross(at(stored, 0), at(stored, 0), True)
    cross(at(stored, 0), at(~stored, 0), False)
    for a, b in ((at(stored, 1), at(stored, 2)), (at(stored, 1), at(~stored, 2)), (at(~stored, 1), at(stored, 2))):
        cross(a, b, False)
    of, near, d = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    good = d <= bound(of)
    of, near = of[good], near[good]
    if not len(of):
        return of, near, np.zeros(0)
    d = np.empty(len(of))
    for i in range(0, len(of), 100_000):
        diff = x[of[i : i + 100_000]].astype(np.float64) - x[near[i : i + 100_000]]
        d[i : i + 100_000] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    order = np.lexsort((d, of))
    of, near, d = of[order], near[order], d[order]
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[begin, len(of)])
    e = err[of] + err[near]
    rank = np.arange(len(of)) - np.repeat(begin, size)
    high = np.repeat(np.maximum.reduceat(np.where(rank < k, d + e, -np.inf), begin), size)
    keep = (d - e <= high) | np.repeat(size <= k, size)
    return of[keep], near[keep], d[keep]


# ---------------------------------------------------------------- decision


def decide(row: np.ndarray, need: np.ndarray, d: np.ndarray, err: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is certain of candidates sorted by row: (taken ids of each, -1 where open; still needed of each row).

    ``need`` is how many ids each row looks for, ``size`` how many ids a candidate has, and its
    true distance is within ``err`` of d.
    """
    take = np.zeros(len(d), np.int64)
    left = need.astype(np.int64).copy()
    if not len(d):
        return take, left
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[begin, len(row)])
    lo, hi = d - err, d + err
    # rows of about the same length at once
    for longest in sorted(set((1 << np.ceil(np.log2(count)).astype(int)).tolist())):
        some = np.flatnonzero((count <= longest) & (count > longest // 2))
        per = max(1, 4_000_000 // longest**2)
        for i in range(0, len(some), per):
            part = some[i : i + per]
            at = np.minimum(begin[part][:, None] + np.arange(longest)[None, :], len(d) - 1)
            real = np.arange(longest)[None, :] < count[part][:, None]
            l, h, s = np.where(real, lo[at], np.inf), np.where(real, hi[at], np.inf), np.where(real, size[at], 0)
            n = need[row[begin[part]]][:, None]
            surely = ((h[:, None, :] < l[:, :, None]) * s[:, None, :]).sum(2)
            maybe = ((l[:, None, :] <= h[:, :, None]) * s[:, None, :]).sum(2) - s
            got = np.where(n - maybe >= s, s, np.where(surely >= n, 0, np.where(surely == maybe, n - surely, -1)))
            take[at[real]] = got[real]
            left[row[begin[part]]] = n[:, 0] - np.where(real, np.maximum(got, 0), 0).sum(1)
    return take, left


# ---------------------------------------------------------------- the operator


def usable(e: Column, width: int) -> Column:
    """A vector takes part if it has the width and neither nulls, NaN nor infinities.

    No function of a lambda is used, as those are interpreted: a search for NaN gives null where
    an array has nulls.
    """
    nan, inf = F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")
    return F.coalesce((F.size(e) == width) & ~F.array_contains(e, nan) & (F.array_max(e) < inf) & (F.array_min(e) > -inf), F.lit(False))


def pack(value: Column) -> Column:
    """A string as bytes, half as long if it is lower-case hex; ``unpack`` undoes it."""
    return F.when(value.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\1"), F.unhex(value))).otherwise(
        F.concat(F.lit(b"\0"), F.encode(value, "UTF-8"))
    )


def unpack(value: Column) -> Column:
    rest = F.substring(value, 2, 2**31 - 2)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _sample(keyed: DataFrame, rows: int, sample: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(vids, vectors, number of distinct vectors) of about ``sample`` distinct vectors, all of them if there are no more.

    The share of hashes that is read says how many there are. Where copies leave less than an
    eighth of the sample, a greater share is read.
    """
    share = min(1.0, sample / max(1, rows))
    while True:
        least = min(2**63 - 1, -(2**63) + int(share * 2**64))
        some = keyed.select(F.xxhash64("x").alias("vid"), "x").where(F.xxhash64("vid", F.lit(5)) <= F.lit(least).cast("long"))
        got = some.groupBy("vid").agg(F.first("x").alias("x")).orderBy(F.xxhash64("vid", F.lit(5)), "vid").limit(2 * sample).collect()
        if share == 1 or 8 * len(got) >= sample:
            return np.array([r["vid"] for r in got], np.int64), np.array([r["x"] for r in got], np.float32), round(len(got) / share)
        share = min(1.0, share * min(1024, sample / (len(got) + 1)))


def _truth(keyed: DataFrame, vids: np.ndarray, x: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a given vector, near): each with its k nearest other vectors of all rows.

    A task keeps k candidates of a vector; what reaches the driver is k vectors for each.
    """
    sq = np.einsum("ij,ij->i", x, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple[float, bytes]]] = {i: {} for i in range(len(x))}
        last = np.full(len(x), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            vid, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            y = _matrix(batch.column(1), width)[first]
            for lo in range(0, len(y), 4096):
                z, v = y[lo : lo + 4096], vid[lo : lo + 4096]
                d = sq[:, None] + np.einsum("ij,ij->i", z, z)[None] - 2 * (x @ z.T)
                d[vids[:, None] == v[None, :]] = np.inf
                kk = min(k, d.shape[1])
                cut = np.minimum(np.partition(d, kk - 1, axis=1)[:, kk - 1], last)
                for i, j in zip(*np.nonzero((d <= cut[:, None]) & np.isfinite(d))):
                    best[i][int(v[j])] = (float(d[i, j]), z[j].tobytes())
                for i, found in best.items():
                    if len(found) > k:
                        best[i] = dict(sorted(found.items(), key=lambda f: f[1][0])[:k])
                    if len(best[i]) >= k:
                        last[i] = max(f[0] for f in best[i].values())
        rows = [(i, v, d, z) for i, found in best.items() for v, (d, z) in found.items()]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.binary()))], ["q", "vid", "d", "x"])

    found = keyed.select(F.xxhash64("x").alias("vid"), "x").mapInArrow(run, "q int, vid long, d double, x binary").groupBy("q", "vid").agg(F.min("d").alias("d"), F.min("x").alias("x"))
    rows = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "vid"))).where(F.col("r") <= k).select("q", "x").collect()
    return np.array([r["q"] for r in rows], np.int64), np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, width)


def _crowded(vectors: DataFrame, hasher: Hasher, n: int, width: int, block: int) -> dict[int, int]:
    """Buckets of more than a block, with the number of blocks of each.

    A vector has one placement in a bucket, so up to ``block`` vectors there are none. Rows are
    counted within a task and then by bucket; copies that are in one batch count once, others
    make blocks smaller than they need be. At most placements / block counts reach the driver.
    """
    if n <= block:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            for at in hasher.codes(_matrix(batch.column(1), width)[first]):
                bucket, m = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(m)], ["bucket", "m"])

    rows = vectors.mapInArrow(count, "bucket long, m long").groupBy("bucket").agg(F.sum("m").alias("m"))
    return {r["bucket"]: -(-r["m"] // block) for r in rows.where(F.col("m") > block).collect()}


def _cells(crowded: dict[int, int], vid: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where rows are compared, as (rows, cell, side): in their bucket or, if it is crowded, in a
    negative cell for each pair of their block with one of the bucket, itself included."""
    keys = np.array(sorted(crowded), np.int64)
    blocks = np.array([crowded[b] for b in sorted(crowded)], np.int64)
    begin = np.cumsum(blocks**2) - blocks**2
    full = np.isin(bucket, keys)
    plain = np.flatnonzero(~full)
    yield plain, bucket[plain], np.zeros(len(plain), np.int8)
    rows = np.flatnonzero(full)
    if not len(rows):
        return
    at = np.searchsorted(keys, bucket[rows])
    own = vid[rows] % blocks[at]
    for other in range(blocks[at].max()):
        some = np.flatnonzero(other < blocks[at])
        i, c = own[some], at[some]
        cell = -1 - (begin[c] + np.minimum(i, other) * blocks[c] + np.maximum(i, other))
        yield rows[some], cell, np.where(i == other, 0, np.where(i < other, 1, 2)).astype(np.int8)


def _record(width: int) -> np.dtype:
    """What a placement carries: ``role`` is twice the side, and one more where it is stored."""
    return np.dtype([("vid", "<i8"), ("scale", "<f4"), ("own", "i1"), ("role", "i1"), ("x", "<i2", (width,))])


def _place(vectors: DataFrame, hasher: Hasher, crowded: dict[int, int], width: int) -> DataFrame:
    """A row for each vector, table, probe and cell: cell (see ``_cells``) and the record."""
    kind = _record(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                vid, x = part.column(0).to_numpy(), _matrix(part.column(1), width)
                whole = np.zeros(len(vid), kind)
                whole["vid"], whole["own"] = vid, part.column(2).to_numpy()
                whole["x"], whole["scale"] = rounded(x)
                for code in hasher.codes(x):
                    for p in range(code.shape[1]):
                        for rows, cell, side in _cells(crowded, vid, code[:, p]):
                            if not len(rows):
                                continue
                            some = whole[rows]
                            some["role"] = 2 * side + (p == 0)
                            data = pa.py_buffer(some.tobytes())
                            at = pa.py_buffer(np.arange(0, (len(some) + 1) * kind.itemsize, kind.itemsize, dtype=np.int32).tobytes())
                            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, at, data])], ["cell", "v"])

    return vectors.select("vid", "x", "own").mapInArrow(run, "cell long, v binary")


_FOUND = np.dtype([("vid", "<i8"), ("d", "<f4"), ("err", "<f4"), ("own", "i1")])


def _compare(placed: DataFrame, width: int, k: int) -> DataFrame:
    """Candidates of each vector from each cell: vid, own, found (records of ``_FOUND``, packed)."""
    kind = _record(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cell = None

        def flush():
            rec = np.concatenate(held)
            held.clear()
            x = rec["x"].astype(np.float32) * rec["scale"][:, None]
            err = off_by(rec["scale"], width)
            of, near, d = block_pairs(rec["role"] % 2 == 1, rec["role"] // 2, x, err, k)
            if len(of):
                out = np.zeros(len(of), _FOUND)
                out["vid"], out["d"], out["own"] = rec["vid"][near], d, rec["own"][near]
                out["err"] = (err[of] + err[near]) * 1.0001 + 2e-7 * d
                begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                data = out.tobytes()
                at = np.r_[begin, len(of)].astype(np.int32) * _FOUND.itemsize
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(rec["vid"][of[begin]]), pa.array(rec["own"][of[begin]]), lists], ["vid", "own", "found"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            rec = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
            cuts = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and b[lo] != cell:
                    yield from flush()
                cell = b[lo]
                held.append(rec[lo:hi].copy())
        if held:
            yield from flush()

    spread = placed.repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(run, "vid long, own byte, found binary")


_EDGES = "vid long, other long, take int, need int"


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """vid, other, take (how many ids of the other are linked), need: where take is -1 the bound
    does not tell, and ``need`` ids are to be taken from all such candidates of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [b"".join(x) for x in batch.column(2).to_pylist()]
            rec = np.frombuffer(b"".join(parts), _FOUND)
            row = np.repeat(np.arange(len(vid)), [len(p) // _FOUND.itemsize for p in parts])
            order = np.lexsort((rec["vid"], row))
            rec, row = rec[order], row[order]
            first = np.r_[True, (rec["vid"][1:] != rec["vid"][:-1]) | (row[1:] != row[:-1])][: len(rec)]
            rec, row = rec[first], row[first]
            d, err, size = rec["d"].astype(np.float64), rec["err"].astype(np.float64), rec["own"].astype(np.int64)
            order = np.lexsort((d + err, row))
            rec, row, d, err, size = rec[order], row[order], d[order], err[order], size[order]
            need = np.maximum(0, k + 1 - own)
            # beyond the upper bounds that already hold enough ids nothing can be near enough
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            count = np.diff(np.r_[begin, len(row)])
            total = np.cumsum(size) - size
            before = total - np.repeat(total[begin], count)
            high = np.full(len(vid), -np.inf)
            inside = before < need[row]
            np.maximum.at(high, row[inside], (d + err)[inside])
            keep = (d - err <= high[row]) & (need[row] > 0)
            rec, row, d, err, size = rec[keep], row[keep], d[keep], err[keep], size[keep]
            take, left = decide(row, need, d, err, size)
            some = take != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(vid[row[some]]), pa.array(rec["vid"][some]), pa.array(take[some], pa.int32()), pa.array(np.where(take < 0, left[row], 0)[some], pa.int32())], ["vid", "other", "take", "need"]
            )

    merged = candidates.groupBy("vid").agg(F.first("own").alias("own"), F.collect_list("found").alias("found"))
    return merged.mapInArrow(run, _EDGES)


def knn_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", k: int = 5, width: int = 64, recall: float = RECALL, sample: int = SAMPLE, queries: int = QUERIES, block: int = BLOCK, plans: list | None = None) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of which one is among the k nearest of the other.

    Distance is Euclidean, ties go to the smaller id. A key takes part once, with its least
    usable vector (see ``usable``); null keys take no part. Keys with one vector are 0 apart, so
    in a group of more than k such keys the neighbours of each are the smallest others of its
    group. Fewer than k + 1 keys give all pairs; an empty table gives none. Pairs are distinct.

    What the search can miss is the links of vectors that share no bucket under any table. The
    plan is made so that on the sample more than ``recall`` of the links are found, with 95 %
    confidence, whatever the size of the table; if the sample is the whole table nothing is missed.
    ``plans`` (a list) is given the plan.

    Skew: copies are counted before they move (at most k + 1 keys of a group are kept in one
    place); keys beyond those of large groups are joined with the group's row, by broadcast where
    a group holds over a thousandth of all keys (so at most a thousand rows) and otherwise by key.
    """
    vid = F.xxhash64("x")
    rows = df.where(usable(df[vector], width) & df[key].isNotNull()).select(df[key].cast("string").alias("id"), df[vector].cast("array<float>").alias("x"))
    keyed = rows.select(pack(F.col("id")).alias("id"), "x")
    count = df.count()
    vids, fitted, n = _sample(keyed, count, sample)
    if not len(vids):
        return df.sparkSession.createDataFrame([], "id_a string, id_b string")
    some = min(len(vids), queries)
    hasher = Hasher.fit(fitted)
    q, near = _truth(keyed, vids[:some], fitted[:some], k, width)
    hasher = hasher.plan(n, fitted, fitted[:some], q, near, recall if len(vids) > some else 1.0)
    if plans is not None:
        plans.append(hasher)
    crowded = _crowded(keyed.select(vid.alias("vid"), "x"), hasher, n, width, block)

    members = keyed.groupBy("id").agg(F.min(vid).alias("vid"))
    order = W.partitionBy("vid").orderBy(unpack(F.col("id")))
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    groups = first.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))
    vectors = keyed.select(vid.alias("vid"), "x").groupBy("vid").agg(F.first("x").alias("x"))
    whole = vectors.join(groups.select("vid", F.size("ids").cast("byte").alias("own")), "vid")

    ranked = _ranked(_compare(_place(whole, hasher, crowded, width), width, k), k)
    edges = ranked.where(F.col("take") > 0).select("vid", "other", "take")
    edges = edges.unionByName(_settled(ranked.where(F.col("take") < 0), vectors, groups))
    up = F.col("vid") < F.col("other")
    linked = edges.groupBy(F.least("vid", "other").alias("lo"), F.greatest("vid", "other").alias("hi")).agg(
        F.coalesce(F.max(F.when(up, F.col("take"))), F.lit(0)).alias("of_hi"), F.coalesce(F.max(F.when(~up, F.col("take"))), F.lit(0)).alias("of_lo")
    )
    ends = linked.join(groups.select(F.col("vid").alias("lo"), F.col("ids").alias("lo_ids")), "lo").join(groups.select(F.col("vid").alias("hi"), F.col("ids").alias("hi_ids")), "hi")

    def product(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))

    some_of = lambda ids, m: F.slice(ids, 1, m)
    lo, hi = F.col("lo_ids"), F.col("hi_ids")
    between = ends.select(
        F.explode(
            F.array_union(
                F.when(F.col("of_hi") > 0, product(lo, some_of(hi, F.col("of_hi")))).otherwise(F.array().cast("array<struct<a: binary, b: binary>>")),
                F.when(F.col("of_lo") > 0, product(some_of(lo, F.col("of_lo")), hi)).otherwise(F.array().cast("array<struct<a: binary, b: binary>>")),
            )
        ).alias("p")
    ).select("p.a", "p.b")

    # within a group: the first k + 1 ids among themselves, and each later id with the first k
    ids = F.col("ids")
    among = groups.where(F.size("ids") > 1).select(
        F.explode(F.flatten(F.transform(ids, lambda x, i: F.transform(F.slice(ids, i + 2, k + 1), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")
    ).select("p.a", "p.b")
    large = members.groupBy("vid").agg(F.count("*").alias("m")).where(F.col("m") > k + 1)
    heads = large.join(groups, "vid").select("vid", "m", F.slice("ids", 1, k).alias("ids"))
    hot = F.col("m") > max(1000, count // 1000)
    later = [
        members.join(F.broadcast(heads.where(hot)), "vid"),
        members.join(heads.where(~hot), "vid"),
    ]
    beyond = later[0].unionByName(later[1]).where(~F.array_contains("ids", F.col("id"))).select("id", F.explode("ids").alias("b"))
    # the (k + 1)-th id is among the later ones too; its pairs were made already
    known = groups.where(F.size("ids") == k + 1).select(F.col("ids")[k].alias("id"))
    beyond = beyond.join(known, "id", "left_anti").select(F.col("id").alias("a"), "b")

    a, b = unpack(F.col("a")), unpack(F.col("b"))
    return between.unionByName(among).unionByName(beyond).select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))


def _settled(open_: DataFrame, vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Open candidates ranked by exact distances and ids: vid, other, take."""
    there = vectors.join(groups, "vid").select(F.col("vid").alias("other"), F.col("x").alias("y"), "ids")
    both = open_.join(there, "other").join(vectors, "vid")
    d = F.aggregate(F.zip_with("x", "y", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    flat = both.select("vid", "other", "need", d.alias("d"), F.explode(F.transform("ids", unpack)).alias("id"))
    best = flat.withColumn("r", F.row_number().over(W.partitionBy("vid").orderBy("d", "id"))).where(F.col("r") <= F.col("need"))
    return best.groupBy("vid", "other").agg(F.count("*").cast("int").alias("take"))
