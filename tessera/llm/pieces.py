"""Oversized items cut at natural boundaries (problem 6), by content-defined chunking.

A rolling hash over the bytes marks landmarks wherever its low bits vanish; they depend on the
bytes near them alone, so an edit moves only the cuts around it. Each landmark snaps to the best
natural boundary near it: a blank line before a definition, a blank line, the end of a statement
or line at the least indentation, a sentence, a blank, and last a character. Pieces lie between
a least and a greatest size; without a landmark in reach the best boundary before the greatest
size is taken. Each piece then takes the whole lines before it that fit the overlap asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

LIMIT, OVERLAP, LEAST_SHARE, SPAN, BITS = 4096, 256, 4, 32, 9
PROSE = {"section", "comment"}
DEFINES = re.compile(rb"[ \t]*(?:@|def |class |async |func |function |export |public |private |static |type |interface |struct |#{1,6} |const |var |let |impl |fn )")
_TABLE = np.random.default_rng(2024).integers(0, 2**62, 256, dtype=np.uint64)


def landmarks(data: bytes, span: int = SPAN, bits: int = BITS, block: int = 1 << 20) -> np.ndarray:
    """Places where the rolling hash of the ``span`` bytes before has its low bits zero.

    The hash is a buzhash: each byte's random word, turned by its age; computed for all places of
    a block at once as an exclusive-or of turned tables, so memory is that of a block.
    """
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(data) - span + 1, block):
        x = _TABLE[np.frombuffer(data[lo : lo + block + span - 1], np.uint8)]
        n = len(x) - span + 1
        h = np.zeros(n, np.uint64)
        for age in range(span):
            turn = np.uint64(age % 64)
            part = x[span - 1 - age : span - 1 - age + n]
            h ^= (part << turn) | (part >> (np.uint64(64) - turn) if turn else part)
        found.append(np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0) + span + lo)
    return np.concatenate(found)


def boundaries(data: bytes, prose: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places one may cut at (the beginning of what follows), sorted, and how natural each is.

    One byte is held for each byte of the data, besides the places found.
    """
    size = len(data)
    rank = np.zeros(size + 1, np.int8)
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw == 9)
    rank[np.flatnonzero(gap[:-1] & ~gap[1:] & (raw[1:] != 10)) + 1] = 1
    pattern = rb"(?<=[.!?])[ \t]+(?=\S)" if prose else rb"(?<=[;,{}])[ \t]*(?=[^\s;,{}])"
    for m in re.finditer(pattern, data):
        rank[m.end()] = 2
    at = 0
    blank = False
    while at < size:
        stop = data.find(b"\n", at)
        stop = size if stop < 0 else stop
        line = data[at:stop]
        bare = line.strip()
        if at:
            depth = len(line) - len(line.lstrip(b" \t"))
            if blank and bare:
                rank[at] = 7 if DEFINES.match(line) and depth <= 4 else 6
            elif bare:
                rank[at] = 5 if depth == 0 or prose else 4 if depth <= 4 else 3
        blank = not bare
        at = stop + 1
    places = np.flatnonzero(rank)
    return places, rank[places].astype(np.int64)


def whole(data: bytes, at: int) -> int:
    """The place itself, or the beginning of the character it falls into; \\r\\n stays together."""
    while 0 < at < len(data) and (data[at] & 0xC0) == 0x80:
        at -= 1
    return at - 1 if 0 < at < len(data) and data[at - 1 : at + 1] == b"\r\n" else at


def cuts(data: bytes, greatest: int, least: int, prose: bool) -> list[int]:
    """Where pieces begin and the last one ends."""
    out, size = [0], len(data)
    marks = landmarks(data)
    places, ranks = boundaries(data, prose)
    while size - out[-1] > greatest:
        lo, hi = out[-1] + least, out[-1] + greatest
        a, b = np.searchsorted(places, [lo, hi + 1])
        cut = 0
        if a < b:
            near, how = places[a:b], ranks[a:b]
            best = how.max()
            natural = near[how >= min(best, max(3, best - 1))] if best >= 3 else near[how == best]
            i = np.searchsorted(marks, lo)
            if i < len(marks) and marks[i] <= hi:  # snap the first landmark in reach
                cut = int(natural[np.abs(natural - marks[i]).argmin()])
            else:
                cut = int(natural[-1])
        else:
            i = np.searchsorted(marks, lo)
            cut = whole(data, int(marks[i]) if i < len(marks) and marks[i] <= hi else hi)
        out.append(cut if cut > out[-1] else max(out[-1] + 1, whole(data, hi)))
    return [*out, size]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, kind: str | None = None) -> list[tuple[str, int, int]]:
    """Pieces (text, first line, last line) of at most ``limit`` bytes in UTF-8, lines from 0.

    Without its overlap the pieces joined are the text. The overlap is as many bytes as asked for
    at most, from a line's beginning on where one is in reach, else from a character's.
    """
    if overlap < 0 or limit < 8 or overlap * 2 > limit:
        raise ValueError("the overlap must be within half of a limit of 8 bytes or more")
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return [(text, 0, text.count("\n"))]
    at = cuts(data, limit - overlap, max(4, (limit - overlap) // LEAST_SHARE), kind in PROSE)
    pieces = []
    line, done = 0, 0
    for a, b in zip(at, at[1:]):
        begin = a
        if a and overlap:
            reach = max(0, a - overlap)
            newline = data.find(b"\n", max(0, reach - 1), a - 1)
            begin = newline + 1 if newline >= 0 else whole(data, reach)
            if begin < reach or begin >= a:
                begin = reach
                while begin < a and (data[begin] & 0xC0) == 0x80:
                    begin += 1
        line += data.count(b"\n", done, begin) if begin >= done else -data.count(b"\n", begin, done)
        done = begin
        piece = data[begin:b]
        last = line + piece.count(b"\n") - (piece.endswith(b"\n") and b < len(data))
        pieces.append((piece.decode("utf-8", "surrogatepass"), line, last))
    return pieces


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks above the limit: id, file_path, piece (from 0), content, start_line,
    end_line.

    Lines are those of the file, by the chunk's start_line (from 1 where that is null). Chunks
    within the limit, null ones and repeated rows of an id give nothing more. A task holds one
    batch; nothing but the oversized rows moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "file_path", "piece", "content", "start_line", "end_line"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for key, path, text, start, kind in zip(*(c.to_pylist() for c in batch.columns)):
                first = 1 if start is None else start
                rows = [(key, path, i, t, first + a, first + b) for i, (t, a, b) in enumerate(split(text, limit, overlap, kind))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    large = chunks.where(F.octet_length("content") > limit).select("id", "file_path", "content", "start_line", "node_kind").dropDuplicates(["id"])
    return large.mapInArrow(run, "id string, file_path string, piece int, content string, start_line int, end_line int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that came out in pieces."""
    return pieces(table(spark, sf_dir, "chunks")).groupBy("id").agg(F.max("piece").alias("last")).where(F.col("last") > 0).select("id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return pieces(table(spark, sf_dir, "chunks"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {"p6_found": "SELECT DISTINCT id FROM chunks WHERE octet_length(encode(content)) > 4096 AND id IS NOT NULL"}
