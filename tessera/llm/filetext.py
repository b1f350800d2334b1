"""Files put together again from their chunks, one at a time within a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_file(chunks: DataFrame, columns: list[str], function: Callable[[str, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``function(file_path, rows)`` to the chunks of every file.

    ``rows`` are the distinct tuples of ``columns`` (the first is the order, as a rule
    ``start_line``), sorted; results are rows of ``schema``. Chunks without a path are left out.
    Files are spread by path and streamed in sorted order, so a task holds one file at a time,
    however many a repository or a task has.
    """
    rows = chunks.where(chunks["file_path"].isNotNull()).select("file_path", *[chunks[c] for c in columns])
    spread = rows.repartition("file_path").sortWithinPartitions("file_path", *columns)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = chunks.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names)
            out.clear()
            return batch

        path, held = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                row = tuple(row)
                if p != path:
                    if held:
                        out.extend(function(path, held))
                        if len(out) >= 2000:
                            yield emit()
                    path, held = p, [row]
                elif row != held[-1]:
                    held.append(row)
        if held:
            out.extend(function(path, held))
        yield emit()

    return spread.mapInArrow(run, kinds)


def text_of(rows: list[tuple]) -> str:
    """The file's text from (start_line, content, ...): chunks at their lines, blanks between.

    Null contents are blank; a chunk without a line, or whose line is taken, follows on the next.
    """
    lines: list[str] = []
    for start, content, *_ in rows:
        if content is None:
            continue
        if start is not None and start - 1 > len(lines):
            lines += [""] * (start - 1 - len(lines))
        lines.append(content)
        lines += [None] * content.count("\n")
    return "\n".join(x for x in lines if x is not None)
