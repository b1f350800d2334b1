"""The engine: index a folder, search it, map it, walk its graph."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, duration, layered
from tessera.models import lookup
from tessera.operators import analysis as A
from tessera.operators import graph as G
from tessera.operators import indexing as I
from tessera.operators import repomap as M
from tessera.operators import search as S
from tessera.operators.fulltext import postings
from tessera.session import checkpointed, prepare, shared_dir
from tessera.sources import tree as T
from tessera.streaming.watch import next_interval, run_batches, stream_files

#: Paths of a batch of events beyond which everything is indexed.
MANY = 1000


def symbol(text: str, limit: int = 50) -> tuple[str, int]:
    """A symbol's name and a limit within bounds; ValueError for what is no symbol."""
    name = (text or "").strip()
    if not name or len(name.encode()) > 255:
        raise ValueError("a symbol of 1 to 255 bytes is required")
    return name, 50 if limit <= 0 else min(limit, 100)


class References(list):
    """References as rows; ``truncated`` if there are more than the limit, ``text`` to print."""

    def __init__(self, rows: list[dict], truncated: bool, text: str):
        super().__init__(rows)
        self.truncated, self.text = truncated, text


class Engine:
    """All operations over one index."""

    def __init__(self, spark: SparkSession, config: Config, embed: Callable | None = None):
        self.spark, self.config = prepare(spark), layered(config)
        if not self.config.root or not self.config.store:
            raise ValueError("root and store are required")
        width, model = self.config.embedding_width, lookup(self.config.embedding_model)
        if model.width and model.width != width:
            raise ValueError(f"{self.config.embedding_model} has width {model.width}, not {width}")
        self._prefix = model.query_prefix if self.config.query_prefix is None else self.config.query_prefix
        self.embed = embed or A.hashing_embedder(width)
        self.store = I.Store(spark, self.config.store, self.config.embedding_model, width)
        self._query_vector = functools.lru_cache(64)(self._embed_query)
        self._refreshed = 0.0
        self._symbols: tuple[int, DataFrame] | None = None

    # ---- indexing

    def _scan(self, only: list[str] | None = None) -> DataFrame:
        """The files there are, or of some paths those that are files, with content; what is ignored is left out."""
        c = self.config
        size = c.max_file_size if c.max_file_size >= 0 else 1 << 62
        names = tuple(c.ignore_files)
        if only is None:
            rules = I.walk(self.spark, c.root, choose=lambda files: files.where(F.element_at(F.split("path", "/"), -1).isin(*names)))
        else:
            folders = sorted({"/".join(p.split("/")[:n]) for p in only for n in range(p.count("/") + 1)})
            rules = I.walk(self.spark, c.root, only=[f"{d}/{n}".lstrip("/") for d in folders for n in names])
        rules = checkpointed(I.ignore_rules(rules))
        choose = lambda files: I.candidates(files, list(c.ignore), list(c.include), list(c.exclude), list(c.extensions), below=rules, ignore_files=names)
        return I.walk(self.spark, c.root, size, only, choose)

    def _empty(self) -> dict[str, DataFrame]:
        make = lambda s: self.spark.createDataFrame([], s)
        return {
            "files": make("path string, content_hash string, indexed_at long, mtime long, size long"),
            "chunks": make("id string, file_path string, language string, content string, content_hash string, node_kind string, name string, parent string, start_line int, end_line int, embedding array<float>"),
            "edges": make("src_id string, file_path string, src_name string, kind string, dst_name string, dst_qualifier string, line int"),
            "imports": make("file_path string, module string, alias string, line int"),
            "postings": make("id string, file_path string, term string, col byte, pos array<int>, dl int"),
        }

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.store.read(n) for n in self._empty()} if self.store.metadata() else self._empty()

    def index(self, only: list[str] | None = None, progress: Callable[[str, int], None] | None = None) -> dict:
        """Bring the index up to date, wholly or for some paths; counts of what was done.

        Unchanged files cost their hash alone; equal contents are embedded once, and not at all
        if any file of the index has their vector. A file with a failing chunk keeps its
        stored version. Files of unsupported languages are stored without chunks, so they aren't
        read again. Of a partial index only the paths asked for are looked at, and those excluded by filters
        keep their rows. Only rows of files that changed are written. ``progress`` is told
        the stage and the number of files it is for.
        """
        tell = progress or (lambda stage, n: None)
        stored = self.tables()
        scanned = checkpointed(self._scan(only))
        fresh = checkpointed(A.analysed(I.changed(stored["files"], scanned)))
        tell("chunking", fresh.count())
        chunks = A.chunk_rows(fresh)
        known = I.reusable(stored["chunks"], self.config.embedding_width).select("content_hash", "embedding")
        new = A.embedded(chunks.join(known, "content_hash", "left_anti"), self.embed, self.config.embedding_width)
        vectors = known.withColumn("error", F.lit(None).cast("string")).unionByName(new)
        whole = chunks.join(vectors, "content_hash", "left").withColumn("failed", F.col("error").isNotNull())
        good, bad = I.isolate_failures(checkpointed(whole), "failed")
        broken = checkpointed(bad.select(F.col("file_path").alias("path")).union(fresh.where(F.col("error").isNotNull()).select("path")).distinct())
        done = scanned.join(fresh.select("path"), "path", "left_semi").join(broken, "path", "left_anti")
        files = checkpointed(done.select("path", "content_hash", F.lit(int(time.time())).alias("indexed_at"), "mtime", "size"))
        rows = checkpointed(good.select(*stored["chunks"].columns).dropDuplicates(["id"]))
        edges, imports = A.edge_rows(fresh.join(broken, "path", "left_anti"), rows) if self.config.graph else (stored["edges"].limit(0), stored["imports"].limit(0))
        if only is None:
            vanished = I.deleted(stored["files"], scanned).select("path")
        else:
            asked = self.spark.createDataFrame([(p,) for p in only], "path string")
            vanished = stored["files"].join(asked.join(T.stated(self.spark, self.config.root, only), "path", "left_anti"), "path", "left_semi").select("path")
        vanished = checkpointed(vanished)
        counts = {"indexed": files.count(), "failed": broken.count(), "deleted": vanished.count()}
        tell("writing", counts["indexed"])
        if counts["indexed"] or counts["deleted"] or self.store.metadata() is None:
            parts = {"files": files, "chunks": rows, "edges": edges, "imports": imports, "postings": postings(rows, keep=("file_path",)).sort("term")}
            notes = {"indexed_at": int(time.time())} if only is None and not counts["failed"] else None
            counts["version"] = self.store.write(parts, files.select("path").union(vanished), notes)
            self._symbols = None
        else:
            counts["version"] = self.store.metadata()["version"]
        tell("done", counts["indexed"])
        return counts

    def stale(self, paths: list[str]) -> list[str]:
        """Of some paths those whose stored state is not the disk's; only these are read."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        rows = I.stale(asked, self.tables()["files"], I.walk(self.spark, self.config.root, 1 << 62, paths), self.config.max_file_size)
        return sorted(r["path"] for r in rows.where("stale").collect())

    def watch(self, folder: str, checkpoint: str, available_now: bool = True):
        """Index what comes in a folder below the root as a stream: a batch's paths, or everything
        if a reindex event is among them. Gives the running query."""
        def each(paths: DataFrame, full: bool) -> None:
            names = [r["path"] for r in paths.select(T.relative(F.col("path"), self.config.root).alias("path")).distinct().collect()]
            if full or names:
                self.index(None if full or len(names) > MANY else names)

        return run_batches(stream_files(self.spark, folder), each, checkpoint, available_now)

    def poll(self, rounds: int, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
        """Index again and again, waiting longer while nothing changes; the counts of each round."""
        done, idle = [], 0
        for n in range(rounds):
            done.append(self.index())
            idle = 0 if done[-1]["indexed"] or done[-1]["deleted"] else idle + 1
            if n + 1 < rounds:
                sleep(next_interval(duration(self.config.poll_interval), idle))
        return done

    # ---- queries

    def _embed_query(self, text: str) -> tuple[float, ...]:
        v = self.embed([self._prefix + text])[0]
        if isinstance(v, Exception):
            raise v
        return tuple(float(x) for x in v)

    def search(self, text: str, refresh_index: bool = False, freshness: bool = False, **options) -> tuple[list[dict], bool]:
        """(results, truncated). With ``freshness`` stale files among the results are indexed
        again if they are few, else their results are flagged; the token budget is applied last."""
        if refresh_index and time.monotonic() - self._refreshed > duration(self.config.reindex_cooldown):
            self.index()
            self._refreshed = time.monotonic()
        q = S.Query(text=text, embedding=self._query_vector(text), **options).checked()
        budget = q.max_tokens
        from dataclasses import replace

        def run() -> list[dict]:
            t = self.tables()
            return [r.asDict() | {"stale": False} for r in S.search(t["chunks"], replace(q, max_tokens=0), t["postings"]).orderBy("rn").collect()]

        rows = run()
        if freshness and rows:
            old = self.stale(sorted({r["file_path"] for r in rows}))
            if old and len(old) <= self.config.stale_refresh:
                self.index(old)
                rows = run()
            else:
                rows = [r | {"stale": r["file_path"] in set(old)} for r in rows]
        kept, spent = [], 0
        for i, r in enumerate(rows):
            spent += len((r.get("content") or "").encode()) // 4
            if i and budget and spent > budget:
                break
            r.pop("embedding", None)
            kept.append(r)
        return kept, len(kept) < len(rows)

    def symbols(self) -> DataFrame:
        """The named chunks without contents and vectors, written once for each version of the index."""
        version = (self.store.metadata() or {}).get("version", 0)
        if self._symbols is None or self._symbols[0] != version:
            slim = self.tables()["chunks"].select("id", "file_path", "language", "node_kind", "name", "parent", "start_line", "end_line")
            self._symbols = (version, checkpointed(slim))
        return self._symbols[1]

    def map(self, max_tokens: int | None = None, code_only: bool = True, summary: bool = True, marks: bool = True) -> str:
        named = M.mapped_symbols(self.symbols(), code_only, self.config.non_code)
        return M.render(named, max(0, self.config.map_tokens if max_tokens is None else max_tokens), summary, marks)

    def _refs(self, rows: DataFrame, name: str, limit: int, order: list, relation: str, **how) -> References:
        got = [r.asDict() for r in G.formatted(rows, **how).orderBy(*order).limit(limit + 1).collect()]
        lines = [r.pop("line_text") for r in got]
        return References(got[:limit], len(got) > limit, G.listing(lines, relation, name, limit))

    def callers(self, name: str, limit: int = 50) -> References:
        name, limit = symbol(name, limit)
        t = self.tables()
        G.require_graph(t["edges"])
        return self._refs(G.callers(t["edges"].where(F.col("dst_name") == name), self.symbols()), name, limit, ["ref_file", "line", "name"], "callers of", at_reference=True)

    def callees(self, name: str, limit: int = 50) -> References:
        name, limit = symbol(name, limit)
        t = self.tables()
        G.require_graph(t["edges"])
        mine = G.edges_of(t["edges"], self.symbols(), name)
        return self._refs(G.callees(mine, self.symbols(), G.imports_of(t["imports"], mine)), name, limit, ["ref_file", "line", "name"], "callees of")

    def impact(self, name: str, depth: int = G.DEPTH, limit: int = 50) -> References:
        name, limit = symbol(name, limit)
        t = self.tables()
        G.require_graph(t["edges"])
        return self._refs(G.impact(t["edges"], self.symbols(), name, depth), name, limit, ["depth", "ref_file", "line", "name"], "impact of", at_reference=True, show_depth=True)

    def stats(self) -> dict:
        t = self.tables()
        by = {r["language"]: r["count"] for r in t["chunks"].groupBy("language").count().collect()}
        return {"files": t["files"].count(), "chunks": sum(by.values()), "edges": t["edges"].count(), "languages": dict(sorted(by.items(), key=lambda x: -x[1])), "model": self.store.model, "width": self.store.width}

    def doctor(self) -> list[tuple[str, bool, str]]:
        """Checks of the set-up: (what, whether it is well, what was found)."""
        found: list[tuple[str, bool, str]] = []

        def check(what: str, f: Callable[[], str]) -> None:
            try:
                found.append((what, True, f()))
            except Exception as e:  # whatever is wrong is told
                found.append((what, False, f"{type(e).__name__}: {e}"))

        def vector() -> str:
            v = self._query_vector("test")
            if len(v) != self.config.embedding_width:
                raise ValueError(f"width {len(v)}, not {self.config.embedding_width}")
            return f"{self.config.embedding_model}, width {len(v)}"

        def stats() -> str:
            s = self.stats()
            return f"{s['files']} files, {s['chunks']} chunks, {s['edges']} edges; " + ", ".join(f"{k} {n}" for k, n in s["languages"].items())

        check("root", lambda: f"{self._scan().select('path').count()} files")
        check("embedder", vector)
        check("index", lambda: "none yet" if self.store.metadata() is None else stats())
        check("graph", lambda: G.require_graph(self.tables()["edges"]) or "built")
        check("shared folder", lambda: shared_dir(self.spark))
        return found

    def reset(self) -> None:
        self.store.reset()
