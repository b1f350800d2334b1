"""Byte-level BPE in two tiers: a minimal perfect hash, then merges from a heap.

Whole pre-tokens that are entries of the vocabulary are resolved by a minimal perfect hash,
evaluated for a whole batch at once. The others are merged byte by byte: the pieces form a
linked list, a heap holds the ranks of neighbouring pairs, and pairs that a merge made stale are
skipped when they come up. A piece of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how this vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Keys a bucket of the hash holds on average, and pieces remembered by a worker.
LOAD, REMEMBERED = 4, 200_000

_M64 = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _mix(h: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """Place of a 64-bit hash under a seed."""
    x = h ^ (seed * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(20)) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys on the places 0 to n - 1.

    Buckets are placed from the fullest down; each tries seeds until its keys fall on free
    places. ``find`` gives the number stored with a key, or -1: the key at the place is compared,
    so a key that isn't in the table never matches.
    """

    def __init__(self, entries: dict[bytes, int]):
        keys = list(entries)
        n = len(keys)
        self.size, self.buckets = n, max(1, n // LOAD)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two entries have one 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(count)])
        self.seeds = np.zeros(self.buckets, np.uint64)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int32)
        taken = np.zeros(n, bool)
        step = 64
        for b in np.argsort(-count, kind="stable"):
            own = order[begin[b] : begin[b + 1]]
            if not len(own):
                break
            base = 0
            while True:
                seeds = np.arange(base, base + step, dtype=np.uint64)
                at = _mix(h[own][None, :], seeds[:, None], n).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.seeds[b], places = seeds[hit[0]], at[hit[0]]
                    break
                base += step
            taken[places] = True
            for k, p in zip(own, places):
                self.keys[p] = keys[k]
                self.values[p] = entries[keys[k]]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        if not keys or not self.size:
            return np.full(len(keys), -1, np.int32)
        h = self.hashes(keys)
        at = _mix(h, self.seeds[h % np.uint64(self.buckets)], self.size).astype(np.int64)
        same = np.fromiter((self.keys[p] == k for p, k in zip(at.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[at], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the merge of least rank, of equals the leftmost."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the piece that begins here ends; 0: merged away
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two was merged in the meantime
        end[i], end[j] = stop, 0
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i : end[k]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[k]))
        if (k := before[i]) >= 0:
            rank = ranks.get(piece[k:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder:
    """Both tiers over one vocabulary; small enough to broadcast (about 50,000 entries)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern, self.table = ranks, pattern, PerfectHash(ranks)
        self._seen: dict[str, list[int]] = {}
        self._split = None

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}, "_split": None}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty or null text has none."""
        split = self._split = self._split or regex.compile(self.pattern).findall
        pieces = [split(t) if t else () for t in texts]
        seen = self._seen
        fresh = [p for p in {p for ps in pieces for p in ps} if p not in seen]
        raw = [p.encode() for p in fresh]
        for p, b, one in zip(fresh, raw, self.table.find(raw).tolist()):
            seen[p] = [one] if one >= 0 else merge(b, self.ranks)
        out = []
        for ps in pieces:
            ids: list[int] = []
            for p in ps:
                ids += seen[p]
            out.append(ids)
        if len(seen) > REMEMBERED:  # forget all; what is frequent comes back at once
            seen.clear()
        return out


@functools.lru_cache(4)
def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once on a driver."""
    return Encoder(read_ranks(path))


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a vocabulary file: in the folder the session's ``spark.tessera.tokenizers`` names, else in ``TOKENIZERS``."""
    return f"{spark.conf.get('spark.tessera.tokenizers', TOKENIZERS)}/{name}"


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Columns key and ids of every row: the token ids of its text, without special tokens.

    Null and empty texts get an empty list. Every row gives one row, repeated keys included;
    other columns are dropped. ``path`` is the vocabulary's (see ``vocabulary``). The vocabulary (read once on the driver, some 3 MB) is broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(encoder_of(path or vocabulary(spark)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
