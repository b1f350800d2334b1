"""The stored index: snapshot diff, staleness, reuse, isolation of failures, replacement."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.globs import ignore_rule, ignored, matches_any
from tessera.functions.text import extension, package_of
from tessera.sources.tree import listed, read, stated


class BadWidth(ValueError):
    """A vector has another width than the index."""


def current_files(files: DataFrame) -> DataFrame:
    """The current row of each path: that of the greatest indexed_at (then hash)."""
    order = F.struct("indexed_at", "content_hash", "mtime", "size")
    return files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(order).alias("r")).select("path", "r.*")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op: ``create``, ``remove``, or ``write`` where the new mtime is strictly later."""
    a, b = old.select("path", F.col("mtime").alias("was")), new.select("path", F.col("mtime").alias("now"))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "path", "full_outer")
    op = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "remove").when(F.col("now") > F.col("was"), "write")
    return both.withColumn("op", op).where(F.col("op").isNotNull()).select("path", "op")


def changed(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned rows whose hash is not the stored one's."""
    return scanned.join(stored.select("path", F.col("content_hash").alias("_s")), "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("_s"))).drop("_s")


def deleted(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    return stored.join(scanned.select("path"), "path", "left_anti")


def stale(asked: DataFrame, stored: DataFrame, disk: DataFrame, max_size: int = 1 << 20) -> DataFrame:
    """path, stale: gone or unreadable is stale; equal time and size, or over the size limit, is
    fresh; else the hash decides. A path that was never stored is stale."""
    s = stored.select("path", F.col("content_hash").alias("sh"), F.col("mtime").alias("sm"), F.col("size").alias("ss"))
    d = disk.select("path", F.col("content_hash").alias("dh"), F.col("mtime").alias("dm"), F.col("size").alias("ds"), F.lit(True).alias("there"))
    rule = (
        F.when(F.col("there").isNull() | F.col("dm").isNull(), True)
        .when((F.col("dm") == F.col("sm")) & (F.col("ds") == F.col("ss")), False)
        .when(F.col("ds") > max_size, False)
        .otherwise(~F.col("dh").eqNullSafe(F.col("sh")))
    )
    return asked.select("path").distinct().join(s, "path", "left").join(d, "path", "left").select("path", rule.alias("stale"))


def reusable(chunks: DataFrame, width: int | None = None) -> DataFrame:
    """content_hash, id, embedding: of rows with equal content the vector of the least id."""
    rows = chunks.where(F.col("embedding").isNotNull() & F.col("content_hash").isNotNull())
    rows = rows if width is None else rows.where(F.size("embedding") == width)
    return rows.groupBy("content_hash").agg(F.min(F.struct("id", "embedding")).alias("r")).select("content_hash", "r.id", "r.embedding")


def isolate_failures(rows: DataFrame, failed: str, file: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """(rows of files without a failure, files with one): a failed chunk keeps its whole file out."""
    bad = rows.groupBy(file).agg(F.max(F.coalesce(F.col(failed), F.lit(False))).alias("bad"), F.count(F.when(F.col(failed), 1)).alias("failures")).where("bad")
    return rows.join(bad.select(file), file, "left_anti"), bad.select(file, "failures")


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Stored rows with the new ones in place of those of the same key; of a key given more than
    once the last by ``order`` counts."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(stored: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def replace_by_files(tables: dict[str, DataFrame], new: dict[str, DataFrame], width: int | None = None, gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables with the rows of the new files in place of the old; one vector of another width
    rejects everything. Keys are ``path`` in files and ``file_path`` elsewhere. ``gone`` (path) are
    the files whose old rows go, by default those of the new ones."""
    if width is not None and "chunks" in new and not new["chunks"].where(F.col("embedding").isNotNull() & (F.size("embedding") != width)).isEmpty():
        raise BadWidth(f"a vector is not of width {width}")
    gone = (new["files"] if gone is None else gone).select("path").distinct()
    out = {}
    for name, rows in tables.items():
        key = "path" if name == "files" else "file_path"
        kept = rows.join(gone.select(F.col("path").alias(key)), key, "left_anti")
        out[name] = kept.unionByName(new[name]) if name in new else kept
    return out


#: Names of ignore files, and folders that are never entered.
IGNORE_FILES, SKIPPED = (".gitignore",), (".git", ".tessera")
RULES = "dir string, no int, regex string, negated boolean, folders_only boolean"


def ignore_rules(files: DataFrame) -> DataFrame:
    """The rules of ignore files (path, content), see ``RULES``: dir is the file's folder (a dot for the root).

    Of several files in one folder those of the later name follow; a line that is no rule is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder, contents in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [line for text in contents for line in (text or "").replace("\r\n", "\n").split("\n")]
                rows += [(folder, n, r.regex, r.negated, r.folders_only) for n, r in enumerate(map(ignore_rule, lines)) if r]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["dir", "no", "regex", "negated", "folders_only"])

    name = F.element_at(F.split("path", "/"), -1)
    each = files.groupBy(package_of(F.col("path")).alias("dir")).agg(F.transform(F.array_sort(F.collect_list(F.struct(name.alias("name"), "content"))), lambda f: f["content"]).alias("contents"))
    return each.mapInArrow(run, RULES)


def not_ignored(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Paths that the rules of their folders let through.

    A rule applies below its folder, to paths relative to it. For each folder on a path and the
    path itself the last matching rule of the deepest folder with one decides; nothing below an
    ignored folder comes back. Folders are looked up once, however many files are in them.
    """
    parts = F.split(F.col("_p"), "/")
    rows = paths.select(F.col(path).alias("_p")).distinct()
    steps = rows.select("_p", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("_p", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/").alias("at"), (F.col("n") < F.size(parts)).alias("folder"))
    own = F.split("at", "/")
    layers = steps.select("at", "folder").distinct().select("at", "folder", F.explode(F.sequence(F.lit(0), F.size(own) - 1)).alias("depth"))
    layers = layers.select("at", "folder", "depth", F.when(F.col("depth") == 0, ".").otherwise(F.array_join(F.slice(own, F.lit(1), F.col("depth")), "/")).alias("dir"), F.array_join(F.slice(own, F.col("depth") + 1, F.size(own)), "/").alias("rel"))
    hits = layers.join(rules, "dir").where((F.col("folder") | ~F.col("folders_only")) & F.regexp("rel", F.col("regex")))
    bad = hits.groupBy("at", "folder").agg(F.max_by("negated", F.struct("depth", "no")).alias("negated")).where(~F.col("negated"))
    gone = steps.join(bad, ["at", "folder"], "left_semi").select("_p").distinct()
    return paths.join(gone.withColumnRenamed("_p", path), path, "left_anti")


def delete_by_file(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of some files (path)."""
    return {n: t.join(gone.select(F.col("path").alias(k)).distinct(), k, "left_anti") for n, t in tables.items() for k in ["path" if n == "files" else "file_path"]}


def candidates(paths: DataFrame, rules: list[str], include: list[str] = (), exclude: list[str] = (), extensions: list[str] = (), path: str = "path", below: DataFrame | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """Paths the walker would give: no ignore files themselves, no ignored paths, then excluded and
    included globs (by name or whole path), then extensions; ``SKIPPED`` folders are never entered.

    ``rules`` are those of the root; ``below`` are rules of folders (see ``RULES``).
    """
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    keep = ~ignored(p, [*rules, *(f"{s}/" for s in SKIPPED)]) & ~name.isin(*ignore_files)
    if exclude:
        keep = keep & ~(matches_any(p, list(exclude)) | matches_any(name, list(exclude)))
    if include:
        keep = keep & (matches_any(p, list(include)) | matches_any(name, list(include)))
    if extensions:
        keep = keep & extension(p).isin(*[e.lower() for e in extensions])
    kept = paths.where(keep)
    return kept if below is None else not_ignored(kept, below, path)


def walk(spark: SparkSession, root: str, max_size: int = 1 << 20, only: list[str] | None = None, choose: Callable[[DataFrame], DataFrame] = lambda files: files) -> DataFrame:
    """Files below a folder: path (relative), content, content_hash, mtime (s), size.

    Files over the size limit and those ``choose`` leaves out (it is given path, mtime, size) are not
    read. With ``only`` those relative paths are looked at, and nothing else is.
    """
    files = listed(spark, root, SKIPPED) if only is None else stated(spark, root, only)
    return read(choose(files.where(F.col("size") <= max_size)), root).select("path", "content", "content_hash", "mtime", "size")


def length_bucket(tokens, longest: int = 512):
    """Padded length: eight times a power of two, at most the longest."""
    return F.least(F.lit(longest), (8 * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col(tokens) / 8.0)).cast("double")))).cast("int"))


def bucketize(rows: DataFrame, tokens: str, key: str, most: int = 32, longest: int = 512, spread: Column | None = None) -> DataFrame:
    """key, bucket, batch: rows of one padded length in batches of ``most``, every row once.

    Batches are counted within spreads of a bucket, by default by hash, as a bucket may hold most rows.
    """
    part = F.pmod(F.xxhash64(key), F.lit(64)) if spread is None else spread
    bucketed = rows.select(key, length_bucket(tokens, longest).alias("bucket"), part.alias("part"))
    order = W.partitionBy("bucket", "part").orderBy(key)
    return bucketed.withColumn("batch", F.concat(F.col("part").cast("string"), F.lit("-"), F.floor((F.row_number().over(order) - 1) / most).cast("string"))).select(key, "bucket", "batch")


class Store:
    """Index tables in versioned snapshots.

    A version is a small file ``versions/N.json``, written under another name and renamed; the
    greatest counts, so there is no moment without one, and a failed write leaves the old one. It
    names for each table the folders its rows are in: a write adds one folder with the rows of the files it brings, and
    names the paths whose older rows no longer hold. What is in no version
    kept is deleted. After ``FOLDERS`` writes, or where ``compact`` asks for it, a table is written whole.
    """

    FOLDERS, KEPT = 16, 2

    def __init__(self, spark: SparkSession, root: str, model: str = "", width: int = 0):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self.metadata()
        if meta and ((model and meta["model"] != model) or (width and meta["width"] != width)):
            raise ValueError(f"the index was made by {meta['model']!r} with width {meta['width']}")
        self.model, self.width = (meta["model"], meta["width"]) if meta else (model, width)

    def _numbers(self, folder: str) -> list[int]:
        at = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def metadata(self, version: int | None = None) -> dict | None:
        """The present version's, or a given one's: version, model, width, tables, notes."""
        numbers = self._numbers("versions")
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"{self.root}/versions/{version or numbers[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table of the present version: of each path the rows of the last write that brought or removed it."""
        meta = self.metadata()
        if meta is None:
            raise LookupError("the index is empty")
        return self._read(meta, name)

    def _read(self, meta: dict, name: str) -> DataFrame:
        key = "path" if name == "files" else "file_path"
        out = None
        for n in meta["tables"][name]:
            part = self.spark.read.parquet(f"{self.root}/data/{n}/{name}")
            if out is None:
                out = part
            else:
                gone = self.spark.read.parquet(f"{self.root}/data/{n}/gone").select(F.col("path").alias(key))
                out = out.join(gone, key, "left_anti").unionByName(part, allowMissingColumns=True)
        return out

    def write(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, notes: dict | None = None) -> int:
        """Add rows to the tables; ``gone`` (path) are the files whose older rows they replace or which
        were removed. Without it, or after many writes, the tables become those given or the whole."""
        meta = self.metadata()
        version = meta["version"] + 1 if meta else 1
        at = f"{self.root}/data/{max([version - 1, *self._numbers('data')]) + 1}"
        number = int(at.rpartition("/")[2])
        known = meta["tables"] if meta else {}
        whole = gone is None or not known
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        if not whole:
            gone.select("path").distinct().write.mode("overwrite").parquet(f"{at}/gone")
        listed = {n: [number] if whole or n not in known else [*known[n], number] for n in tables} | {n: x for n, x in known.items() if n not in tables}
        meta = {"version": version, "model": self.model, "width": self.width, "tables": listed, "notes": {**(meta or {}).get("notes", {}), **(notes or {})}}
        if not whole and any(len(x) > self.FOLDERS for x in listed.values()):
            for name in listed:
                self._read(meta, name).write.mode("overwrite").parquet(f"{self.root}/data/{number + 1}/{name}")
            meta["tables"] = {n: [number + 1] for n in listed}
        self._commit(version, meta)
        self._clean()
        return version

    def _commit(self, version: int, meta: dict) -> None:
        tmp, to = self._path(f"{self.root}/versions/{version}.tmp"), self._path(f"{self.root}/versions/{version}.json")
        self._fs.mkdirs(to.getParent())
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(meta).encode()))
        finally:
            stream.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            raise OSError(f"version {version} was written by someone else")

    def note(self, **notes) -> None:
        """Set notes of the index, a version of its own with the same tables."""
        meta = self.metadata()
        if meta is None:
            raise LookupError("the index is empty")
        self._commit(meta["version"] + 1, meta | {"version": meta["version"] + 1, "notes": {**meta.get("notes", {}), **notes}})

    def _clean(self) -> None:
        """Delete versions but the last ones, and data none of those names."""
        numbers = self._numbers("versions")
        held = {n for v in numbers[-self.KEPT :] for x in self.metadata(v)["tables"].values() for n in x}
        for v in numbers[: -self.KEPT]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        for n in self._numbers("data"):
            if n not in held:
                self._fs.delete(self._path(f"{self.root}/data/{n}"), True)

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)
