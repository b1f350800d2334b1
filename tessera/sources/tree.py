"""Files of a folder tree, listed and read by tasks.

The file sources of the session leave out names that begin with a dot or an underscore, and so
many a source file; here tasks list folders themselves. A task goes down its folders until it has
seen ``ENTRIES`` entries and leaves the rest to the next round, so a large tree spreads over the
tasks and a small one takes one round. Folders of a given name are never entered; links to
folders and links to nothing are left out.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpointed

ENTRIES, BYTES = 20_000, 16 << 20
LISTED = "path string, mtime long, size long"


def root_path(root: str) -> str:
    """A folder without its file system and the stroke at its end."""
    return re.sub(r"^\w+:(?://[^/]*(?=/))?/*(?=/)", "", root).rstrip("/")


def relative(path: Column, root: str) -> Column:
    """A path of a file source relative to a root."""
    base = root_path(root)
    plain = F.regexp_replace(path, "^\\w+:(//[^/]*(?=/))?/*", "/")
    return F.when(F.startswith(plain, F.lit(base + "/")), F.substring(plain, F.lit(len(base) + 2), F.length(plain))).otherwise(plain)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    if ":" not in root.split("/")[0]:
        return fs.LocalFileSystem(), root.rstrip("/")
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root))
    return system, at.rstrip("/")


def _seconds(info: fs.FileInfo) -> int:
    return int((info.mtime_ns or 0) // 1_000_000_000)


def _list(root: str, skipped: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, base = _opened(root)
    local = isinstance(system, fs.LocalFileSystem)
    for batch in batches:
        todo, rows, seen = batch.column(0).to_pylist(), [], 0
        while todo:
            folder = todo.pop()
            if seen >= ENTRIES:
                rows.append((folder, None, None))
                continue
            for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                seen += 1
                path = f"{folder}/{info.base_name}".lstrip("/")
                if info.type == fs.FileType.File:
                    rows.append((path, _seconds(info), info.size))
                elif info.type == fs.FileType.Directory and info.base_name not in skipped and not (local and os.path.islink(info.path)):
                    todo.append(path)
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["path", "mtime", "size"])


def listed(spark: SparkSession, root: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """All files below a folder: path (relative), mtime (s), size. A folder that is not there has none."""
    todo, parts = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = checkpointed(todo.mapInArrow(functools.partial(_list, root, frozenset(skipped)), LISTED))
        parts.append(found.where(F.col("size").isNotNull()))
        todo = found.where(F.col("size").isNull()).select("path")
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts)
        todo = todo.repartition(spark.sparkContext.defaultParallelism * 4)


def stated(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Of some relative paths those that are files: path, mtime (s), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            infos = system.get_file_info([f"{base}/{n}" for n in names]) if names else []
            rows = [(n, _seconds(i), i.size) for n, i in zip(names, infos) if i.type == fs.FileType.File]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["path", "mtime", "size"])

    return spark.createDataFrame([(p,) for p in paths], "path string").distinct().mapInArrow(run, LISTED)


def read(files: DataFrame, root: str) -> DataFrame:
    """Files (path, mtime, size) with their text, ``content``, and the hash of their bytes, ``content_hash``.

    What is no UTF-8 is replaced by the sign for it; files gone in the meantime are left out.
    """
    names = ["path", "mtime", "size", "content", "content_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            at, texts, hashes, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(texts, pa.string()), pa.array(hashes, pa.string())], names)  # noqa: B023

            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                except FileNotFoundError:
                    continue
                at.append(i)
                texts.append(data.decode("utf-8", "replace"))
                hashes.append(hashlib.sha256(data).hexdigest())
                size += len(data)
                if size >= BYTES:
                    yield made()
                    at, texts, hashes, size = [], [], [], 0
            yield made()

    return files.select("path", "mtime", "size").mapInArrow(run, f"{LISTED}, content string, content_hash string")
