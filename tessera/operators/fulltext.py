"""Full-text index: postings with places, and BM25 over them.

A posting is a row (term, id, col, pos, dl): the places of a term in one column of a chunk, and how many
terms the chunk has in all. A row of the empty term, col -1, stands for each chunk, so the
table alone gives the statistics. Written at index time and sorted by term, a search reads the
row groups of its own terms and those of the empty one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import index_terms, parted, search_tokens

K1, B = 1.2, 0.75
COLUMNS = ("content", "name", "parent")


def phrases_of(text: str) -> list[list[str]]:
    """The phrases of a query: each search token's terms, empty ones left out."""
    return [p for p in map(parted, search_tokens(text)) if p]


def postings(chunks: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS, terms: frozenset[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The postings of chunks, all or those of some terms, in one pass over the texts; the columns
    ``keep`` go along. Null texts have no terms; rows without a key are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, col, pos, dl = [], [], [], [], []
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1 + len(keep) :]))):
                found = [index_terms(t) for t in texts]
                length = sum(map(len, found))
                listed: dict[tuple[str, int], list[int]] = {("", -1): []}
                for c, words in enumerate(found):
                    for p, w in enumerate(words):
                        if terms is None or w in terms:
                            listed.setdefault((w, c), []).append(p)
                for (w, c), places in listed.items():
                    row.append(i)
                    term.append(w)
                    col.append(c)
                    pos.append(places)
                    dl.append(length)
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[: 1 + len(keep)]]
            rest = [pa.array(term, pa.string()), pa.array(col, pa.int8()), pa.array(pos, pa.list_(pa.int32())), pa.array(dl, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *rest], [key, *keep, "term", "col", "pos", "dl"])

    rows = chunks.where(F.col(key).isNotNull()).select(key, *keep, *columns)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (key, *keep)) + ", term string, col byte, pos array<int>, dl int")


def _times(phrase: list[str]) -> Column:
    """How often a phrase is in a column, of the map ``at`` from terms to places; overlaps count."""
    first = F.col("at")[phrase[0]]
    if len(phrase) > 1:
        follows = lambda p: functools.reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(F.col("at")[t], p + i), F.lit(False)) for i, t in enumerate(phrase) if i])
        first = F.filter(first, follows)
    return F.when(F.col("at")[phrase[0]].isNull(), 0).otherwise(F.size(first))


def bm25(index: DataFrame, text: str, allowed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Chunks that hold every phrase of the text in some column: key, score (less is better).

    Statistics are those of all chunks, allowed (key) or not; idf of a phrase in half of the chunks
    or more is 1e-6. No phrase, no rows. One row of sums reaches the driver.
    """
    phrases = phrases_of(text)
    if not phrases:
        return index.limit(0).select(key, F.lit(0.0).alias("score"))
    terms = sorted({t for p in phrases for t in p})
    by = index.where(F.col("term").isin(*terms)).groupBy(key, "col").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("at"), F.first("dl").alias("dl"))
    each = by.select(key, "dl", *[_times(p).alias(f"f{j}") for j, p in enumerate(phrases)])
    found = each.groupBy(key).agg(F.first("dl").alias("dl"), *[F.sum(f"f{j}").cast("double").alias(f"f{j}") for j in range(len(phrases))])
    all_of = index.where(F.col("term") == "").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    stats = all_of.crossJoin(found.agg(*[F.count(F.when(F.col(f"f{j}") > 0, 1)).alias(f"n{j}") for j in range(len(phrases))])).first()
    score = F.lit(0.0)
    for j in range(len(phrases)):
        idf = math.log((stats["n"] - stats[f"n{j}"] + 0.5) / (stats[f"n{j}"] + 0.5))
        idf, f = (idf if idf > 0 else 1e-6), F.col(f"f{j}")
        score = score - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avg"] or 1.0)))
    every = functools.reduce(lambda a, b: a & b, [F.col(f"f{j}") > 0 for j in range(len(phrases))])
    rows = found.where(every).select(key, score.alias("score"))
    return rows if allowed is None else rows.join(allowed.select(key), key, "left_semi")
