"""Chunks, edges and vectors of source texts, in Arrow batches on the workers.

The chunker takes Python apart by its syntax tree, Go, JavaScript, TypeScript, C and C++ by their
declarations (see ``islands``) and other texts by paragraphs; both it and the embedder are plain
callables and can be exchanged.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, record_id
from tessera.operators.islands import FAMILY, island_chunks

#: Extensions of each language.
EXTENSIONS = {
    "go": (".go",), "python": (".py", ".pyw"), "javascript": (".js", ".mjs", ".cjs", ".jsx"), "typescript": (".ts", ".mts"), "tsx": (".tsx",),
    "ruby": (".rb",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp"), "bash": (".sh", ".bash"), "html": (".html", ".htm"), "css": (".css",),
    "markdown": (".md", ".markdown"), "json": (".json",), "yaml": (".yaml", ".yml"), "vue": (".vue",),
}
LANGUAGES = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}


class Unsupported(ValueError):
    """No chunker knows the file's language."""


def analyse(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Chunks (content, language, node_kind, name, parent, start, end) and edges (kind, source,
    target, qualifier, line; kind ``import`` for imports with the alias as source) of a file."""
    language = LANGUAGES.get("." + path.rpartition(".")[2].lower() if "." in path else "")
    if language is None:
        raise Unsupported(path)
    if language == "python":
        try:
            return _python(text)
        except SyntaxError:
            pass
    if language in FAMILY:
        return island_chunks(text, language)
    chunks, lines, begin = [], text.split("\n"), None
    for i, line in enumerate([*lines, ""]):
        if line.strip() and begin is None:
            begin = i
        elif not line.strip() and begin is not None:
            chunks.append(("\n".join(lines[begin:i]), language, "block", "", "", begin + 1, i))
            begin = None
    return chunks, []


def _python(text: str) -> tuple[list[tuple], list[tuple]]:
    tree, lines = ast.parse(text), text.split("\n")
    chunks: list[tuple] = []
    edges: list[tuple] = []

    def visit(nodes: list, parent: str) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                kind = "class_definition" if isinstance(n, ast.ClassDef) else "method_definition" if parent else "function_definition"
                chunks.append(("\n".join(lines[start - 1 : n.end_lineno]), "python", kind, n.name, parent, start, n.end_lineno))
                if isinstance(n, ast.ClassDef):
                    visit(n.body, n.name)
            elif not parent:
                chunks.append(("\n".join(lines[n.lineno - 1 : n.end_lineno]), "python", "block", "", "", n.lineno, n.end_lineno))

    def link(node: ast.AST, source: str) -> None:
        for n in ast.iter_child_nodes(node):
            inside = n.name if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else source
            if isinstance(n, ast.Call):
                if isinstance(n.func, ast.Name):
                    edges.append(("call", source, n.func.id, "", n.lineno))
                elif isinstance(n.func, ast.Attribute):
                    qualifier = n.func.value.id if isinstance(n.func.value, ast.Name) else ""
                    edges.append(("call", source, n.func.attr, qualifier, n.lineno))
            elif isinstance(n, ast.ClassDef):
                edges.extend(("inherit", n.name, b.id, "", n.lineno) for b in n.bases if isinstance(b, ast.Name))
            elif isinstance(n, ast.Import):
                edges.extend(("import", a.asname or "", a.name, "", n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                edges.append(("import", "", "." * n.level + (n.module or ""), "", n.lineno))
            link(n, inside)

    visit(tree.body, "")
    link(tree, "")
    return chunks, edges


ANALYSED = (
    "path string, error string, chunks array<struct<content: string, language: string, node_kind: string, name: string, parent: string, start_line: int, end_line: int>>, "
    "edges array<struct<kind: string, source: string, target: string, qualifier: string, line: int>>"
)


def analysed(files: DataFrame, chunker: Callable = analyse) -> DataFrame:
    """path, error, chunks, edges of files (path, content). A file of an unsupported language has
    neither chunks nor error; one the chunker fails on has the error, and no other is touched."""
    kinds = [pa.struct([(n, pa.string()) for n in ("content", "language", "node_kind", "name", "parent")] + [("start_line", pa.int32()), ("end_line", pa.int32())]), pa.struct([(n, pa.string()) for n in ("kind", "source", "target", "qualifier")] + [("line", pa.int32())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                error, chunks, edges = None, [], []
                try:
                    chunks, edges = chunker(path, text or "")
                except Unsupported:
                    pass
                except Exception as e:  # of this file alone
                    error = f"{type(e).__name__}: {e}"
                for column, v in zip(out, (path, error, [dict(zip([f.name for f in kinds[0]], c)) for c in chunks], [dict(zip([f.name for f in kinds[1]], c)) for c in edges])):
                    column.append(v)
            types = [pa.string(), pa.string(), pa.list_(kinds[0]), pa.list_(kinds[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["path", "error", "chunks", "edges"])

    return files.select("path", "content").mapInArrow(run, ANALYSED)


def chunk_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("error").isNull()).select(F.col("path").alias("file_path"), F.explode("chunks").alias("c")).select("file_path", "c.*")
    return rows.withColumn("id", record_id(F.col("file_path"), F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))


def edge_rows(parsed: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, imports): edges belong to the innermost chunk of their line, or keep an empty id if
    the parser knew a source; others are dropped."""
    from tessera.operators.graph import attribute

    raw = parsed.where(F.col("error").isNull()).select(F.col("path").alias("file_path"), F.explode("edges").alias("e")).select("file_path", "e.*")
    imports = raw.where("kind = 'import'").select("file_path", F.col("target").alias("module"), F.col("source").alias("alias"), "line")
    links = attribute(raw.where("kind <> 'import'"), chunks)
    edges = links.where(F.col("chunk_id").isNotNull() | (F.col("source") != "")).select(
        F.coalesce("chunk_id", F.lit("")).alias("src_id"), "file_path", F.col("source").alias("src_name"), "kind", F.col("target").alias("dst_name"), F.col("qualifier").alias("dst_qualifier"), "line"
    )
    return edges, imports


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[np.ndarray | Exception]]:
    """A deterministic embedder without a model: signed hashes of words, of unit length. A blank
    text is an error of its own."""

    def embed(texts: list[str]) -> list[np.ndarray | Exception]:
        out: list = []
        for t in texts:
            if not t or not t.strip():
                out.append(ValueError("empty text"))
                continue
            v = np.zeros(width, np.float32)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append(v / n if n else v + np.float32(width**-0.5))
        return out

    return embed


def embedded(chunks: DataFrame, embed: Callable, width: int, key: str = "content_hash") -> DataFrame:
    """key, embedding, error: each distinct content once; exactly one of the two is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = embed(batch.column(1).to_pylist())
            bad = [None if not isinstance(v, Exception) and len(v) == width else v if isinstance(v, Exception) else ValueError(f"width {len(v)}") for v in got]
            vectors = [None if e else [float(x) for x in v] for v, e in zip(got, bad)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([str(e) if e else None for e in bad], pa.string())], [key, "embedding", "error"])

    distinct = chunks.groupBy(key).agg(F.min("content").alias("content"))
    return distinct.mapInArrow(run, f"{key} string, embedding array<float>, error string")
