"""Hybrid search: nearest vectors, BM25, reciprocal-rank fusion, filters, paging, budget."""

from __future__ import annotations

import functools
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.globs import matches_any
from tessera.functions.text import token_estimate
from tessera.operators.fulltext import COLUMNS, phrases_of, postings
from tessera.operators.fulltext import bm25 as ranked_text
from tessera.session import checkpointed

#: Candidates a side beyond which they are no longer broadcast.
RRF, BLOCK, STEP, FETCHED = 60, 65_536, 1024, 10_000


def _usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Keys and vectors of a width, without nulls and NaN (a search for NaN gives null where there are nulls)."""
    good = (F.size(vector) == width) & ~F.array_contains(vector, F.lit(float("nan")).cast("float"))
    return df.select(key, F.col(vector).cast("array<float>").alias(vector)).where(good)


def _kept(rows: DataFrame, ids: list | None, queries: np.ndarray, k: int, key: str) -> DataFrame:
    """What each task keeps of rows (key, vector) for some queries, k of each: key, d and, where
    queries have ids, qid.

    The queries go to the tasks by broadcast. A task compares its rows with ``STEP`` queries in one
    product of matrices.
    """
    kind, width = rows.schema[key].dataType.simpleString(), queries.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        sq = (q * q).sum(1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, distance, key
        worst, kept, arrow = np.full(len(q), np.inf), 0, pa.string()

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, d, keys = (np.concatenate(z) for z in zip(*held))
            order = np.lexsort((keys, d, at))
            at, d, keys = at[order], d[order], keys[order]
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            return at[rank < k], d[rank < k], keys[rank < k]

        for batch in batches:
            if not batch.num_rows:
                continue
            names, arrow = np.array(batch.column(0).to_pylist()), batch.column(0).type
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            own = (x * x).sum(1)[None]
            for lo in range(0, len(q), STEP):
                part = q[lo : lo + STEP]
                d = sq[lo : lo + STEP, None] + own - 2 * part @ x.T
                kk = min(k, d.shape[1])
                if kk == k:
                    worst[lo : lo + STEP] = np.minimum(worst[lo : lo + STEP], np.partition(d, kk - 1, axis=1)[:, kk - 1])
                r, c = np.nonzero(d <= worst[lo : lo + STEP, None] + 1e-9)
                held.append((r + lo, ((part[r] - x[c]) ** 2).sum(1), names[c]))
                kept += len(r)
            if kept > 4 * k * len(q) + 100_000:
                held[:] = [best()]
                kept = len(held[0][0])
        if held:
            at, d, keys = best()
            cols = {key: pa.array(keys.tolist()).cast(arrow), "d": pa.array(d)}
            if ids is not None:
                cols["qid"] = pa.array([ids[i] for i in at.tolist()]).cast(arrow)
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, f"{key} {kind}, d double" + (f", qid {kind}" if ids is not None else ""))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query: key, rn; ties by key. Vectors of another width, null or
    with null or NaN take no part. Each task keeps k rows."""
    if k <= 0 or not len(query):
        return vectors.limit(0).select(key, F.lit(0).alias("rn"))
    found = _kept(_usable(vectors, key, vector, len(query)), None, np.array([query], np.float64), k, key)
    top = found.orderBy("d", key).limit(k)
    return top.withColumn("rn", F.row_number().over(W.orderBy("d", key))).select(key, "rn")


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", width: int = 64) -> DataFrame:
    """The k nearest rows of every query: qid, key, rn; ties by key.

    Queries are taken ``BLOCK`` at a time (32 MB at width 64) in one pass over the vectors; more
    take more passes. What the tasks kept is ranked.
    """
    rows, out = _usable(vectors, key, vector, width), None
    for block in _blocks(_usable(queries, key, vector, width).orderBy(key).toLocalIterator(), BLOCK):
        part = _kept(rows, [r[key] for r in block], np.array([r[vector] for r in block], np.float64), k, key)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.limit(0).select(F.col(key).alias("qid"), key, F.lit(0).alias("rn"))
    order = W.partitionBy("qid").orderBy("d", key)
    return out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("qid", key, "rn")


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def bm25(chunks: DataFrame, text: str, filters: Column | None = None, key: str = "id", columns: tuple[str, ...] = COLUMNS, index: DataFrame | None = None) -> DataFrame:
    """Rows that hold every phrase in some column: key, score (see ``fulltext.bm25``).

    Without an index the postings of the query's terms are made in one pass over the texts and
    written once to the shared folder.
    """
    if index is None:
        terms = frozenset(t for p in phrases_of(text) for t in p)
        index = checkpointed(postings(chunks, key, columns, terms)) if terms else postings(chunks, key, columns, terms)
    return ranked_text(index, text, chunks.where(filters).select(key) if filters is not None else None, key)


# ---------------------------------------------------------------- fusion


@dataclass(frozen=True)
class Query:
    text: str = ""
    embedding: tuple[float, ...] = ()
    limit: int = 10
    offset: int = 0
    max_tokens: int = 0
    languages: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    node_kinds: tuple[str, ...] = ()
    package: str = ""
    metadata_only: bool = False
    columns: tuple[str, ...] = field(default=COLUMNS)

    def checked(self) -> Query:
        """With bounds applied; ValueError for what cannot be asked."""
        if not self.text and not self.embedding:
            raise ValueError("a query is required")
        package = posixpath.normpath(self.package) if self.package else ""
        if package in (".", "..") or package.startswith(("/", "../")):
            raise ValueError("package must be a folder within the project")
        for p in self.paths:
            if p.startswith("/") or ".." in p.split("/") or "**" in (p[:-3] if p.endswith("/**") else p):
                raise ValueError(f"path pattern {p!r} is not supported")
        cap = lambda xs: tuple(xs[:50])
        return replace(
            self, package=package, limit=10 if self.limit <= 0 else min(self.limit, 100), offset=max(0, self.offset), max_tokens=max(0, self.max_tokens),
            languages=cap(self.languages), paths=cap(self.paths), names=cap(self.names), node_kinds=cap(self.node_kinds),
        )

    def attributes(self) -> Column:
        out = F.lit(True)
        for column, values in (("language", self.languages), ("name", self.names), ("node_kind", self.node_kinds)):
            if values:
                out = out & F.col(column).isin(*values)
        return out

    def globs(self) -> list[str]:
        return [*self.paths, *([f"{self.package}/**"] if self.package else [])]

    def filtered(self) -> bool:
        return bool(self.languages or self.names or self.node_kinds or self.globs())


def sides(chunks: DataFrame, q: Query, fetch: int, index: DataFrame | None = None) -> DataFrame:
    """The best ``fetch`` rows of each side: id, rn (place on its side).

    The vector side is filtered before its cut only by one language, the text side by all attributes.
    """
    found = []
    if q.embedding:
        rows = chunks.where(F.col("language") == q.languages[0]) if len(q.languages) == 1 else chunks
        found.append(nearest(rows, list(q.embedding), fetch))
    if q.text:
        some = q.attributes() if q.languages or q.names or q.node_kinds else None
        ranked = bm25(chunks, q.text, some, columns=q.columns, index=index).orderBy("score", "id").limit(fetch)
        found.append(ranked.withColumn("rn", F.row_number().over(W.orderBy("score", "id"))).select("id", "rn"))
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def fused(chunks: DataFrame, q: Query, fetch: int, index: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """Candidates by reciprocal ranks: id, score; of each side its best ``fetch`` rows. ``ranked``
    are the sides, if they are known to that depth."""
    both = (sides(chunks, q, fetch, index) if ranked is None else ranked).where(F.col("rn") <= fetch)
    return both.groupBy("id").agg(F.sum(1.0 / (RRF + F.col("rn"))).cast("float").alias("score"))


def search(chunks: DataFrame, q: Query, index: DataFrame | None = None) -> DataFrame:
    """One page of results with rank ``rn`` and ``score``, best first.

    The fetch starts at three times what the page needs; while filters leave the page short it is
    tripled, at most twice, as fused scores depend on the cut. The sides are ranked once, to the
    greatest depth that may be asked for. Ids must be unique. ``index`` are stored postings.
    """
    q = q.checked()
    fetch = (q.limit + q.offset) * 3
    wanted = [c for c in chunks.columns if not (q.metadata_only and c in ("content", "content_hash")) and c not in ("score", "rn")]
    ranked = checkpointed(sides(chunks, q, fetch * 9 if q.filtered() else fetch, index))
    for turn in range(3):
        hits = fused(chunks, q, fetch, ranked=ranked)
        kept = chunks.select(*wanted).join(F.broadcast(hits) if fetch <= FETCHED else hits, "id").where(q.attributes() & matches_any(F.col("file_path"), q.globs()))
        order = W.orderBy(F.desc("score"), "id")
        page = kept.withColumn("rn", F.row_number().over(order)).where(F.col("rn").between(q.offset + 1, q.offset + q.limit)).withColumn("rn", F.col("rn") - q.offset)
        if not q.filtered() or turn == 2 or page.count() >= q.limit:
            break
        fetch *= 3
    return within_budget(page, q.max_tokens) if q.max_tokens else page


def within_budget(ranked: DataFrame, max_tokens: int, group: str | None = None, rn: str = "rn") -> DataFrame:
    """The leading results that fit the budget; the first is always kept. Results without content
    cost nothing."""
    if "content" not in ranked.columns or max_tokens <= 0:
        return ranked
    window = (W.partitionBy(group) if group else W.partitionBy()).orderBy(rn).rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum(token_estimate(F.col("content"))).over(window)
    return ranked.withColumn("_spent", spent).where((F.col(rn) == 1) | (F.col("_spent") <= max_tokens)).drop("_spent")
