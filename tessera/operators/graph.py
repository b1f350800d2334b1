"""The code graph: attribution of edges, name resolution, callers, callees, impact."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import package_of
from tessera.session import checkpointed

DEPTH, DEEPEST, SALTS = 2, 10, 8


class GraphNotBuilt(LookupError):
    """There are no edges at all."""


def symbols(chunks: DataFrame) -> DataFrame:
    """Named chunks, one row per id: id, name, file_path, node_kind, parent, start_line, end_line."""
    return (
        chunks.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("id").isNotNull())
        .groupBy("id")
        .agg(*[F.min(c).alias(c) for c in ("name", "file_path", "node_kind", "parent", "start_line", "end_line")])
    )


def attribute(edges: DataFrame, chunks: DataFrame, step: int = 64) -> DataFrame:
    """Edges with the innermost chunk whose lines hold theirs: all edge columns and ``chunk_id``.

    Of chunks that hold the line the one that begins last wins, then the greater id; edges of
    lines in no chunk get null. The range join goes by stretches of ``step`` lines: a chunk is
    listed under each stretch it touches and a line looks only into its own, so no pair of a
    file's edges and chunks is made that cannot match. Lines are looked up once, however many
    edges they have.
    """
    spans = chunks.where(F.col("start_line") <= F.col("end_line")).select("file_path", "start_line", "end_line", F.col("id").alias("_id")).distinct()
    listed = spans.withColumn("_at", F.explode(F.sequence(F.floor(F.col("start_line") / step), F.floor(F.col("end_line") / step))))
    lines = edges.select("file_path", "line").where(F.col("line").isNotNull()).distinct().withColumn("_at", F.floor(F.col("line") / step))
    hits = (
        lines.join(listed, ["file_path", "_at"])
        .where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        .groupBy("file_path", "line")
        .agg(F.max_by("_id", F.struct("start_line", "_id")).alias("chunk_id"))
    )
    return edges.join(hits, ["file_path", "line"], "left").select(*edges.columns, "chunk_id")


def edges_of(edges: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """The edges that begin in definitions of a name."""
    return edges.join(symbols(chunks).where(F.col("name") == name).select(F.col("id").alias("src_id")), "src_id", "left_semi")


def imports_of(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """The imports of the files that edges are in."""
    return imports.join(edges.select("file_path").distinct(), "file_path", "left_semi")


def module_tail(module: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(module, "/+$", ""), "([^/]*)$", 1)


def qualifier_modules(imports: DataFrame) -> DataFrame:
    """For each file and qualifier the module meant: an alias before a module's last part, then
    the first line."""
    tails = imports.where(F.col("module").isNotNull())
    named = tails.where(F.coalesce(F.col("alias"), F.lit("")) != "").select("file_path", F.col("alias").alias("qualifier"), "module", "line", F.lit(0).alias("way"))
    plain = tails.select("file_path", module_tail(F.col("module")).alias("qualifier"), "module", "line", F.lit(1).alias("way"))
    return (
        named.unionByName(plain)
        .where(F.col("qualifier") != "")
        .groupBy("file_path", "qualifier")
        .agg(F.min_by("module", F.struct("way", "line", "module")).alias("module"))
        .withColumn("module", F.regexp_replace(F.regexp_replace("module", "/+$", ""), "^[./]+|[./]+$", ""))
    )


def resolve(refs: DataFrame, defs: DataFrame, imports: DataFrame | None, name: str = "dst_name", file: str = "file_path", qualifier: str | None = "dst_qualifier") -> DataFrame:
    """``refs`` with ``target`` (a struct of the definition's place, or null): one of the same
    file, else one in a folder the qualifier's import names, else the first by place.

    Three joins with one row per key on the right side take the place of a join with all
    definitions of a name, so a name defined everywhere costs no more than others. A name may be
    that of a third of the references: joins by the name alone are salted by the referring file.
    """
    place = F.struct(*[F.col(c) for c in ("file_path", "start_line", "id", "node_kind", "parent", "end_line")])
    keyed = defs.select("name", "file_path", place.alias("place"))
    here = keyed.groupBy(F.col("name").alias("_n"), F.col("file_path").alias("_f")).agg(F.min("place").alias("_here"))
    first = keyed.groupBy(F.col("name").alias("_n2")).agg(F.min("place").alias("_first")).withColumn("_s2", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64(refs[file]), F.lit(SALTS)).cast("int")
    out = refs.join(here, (refs[name] == F.col("_n")) & (refs[file] == F.col("_f")), "left").join(first, (refs[name] == F.col("_n2")) & (salt == F.col("_s2")), "left")
    imported = F.lit(None).cast(T.StructType(keyed.schema["place"].dataType.fields))
    if imports is not None and qualifier is not None:
        modules = qualifier_modules(imports).select(F.col("file_path").alias("_mf"), F.col("qualifier").alias("_q"), F.col("module").alias("_m"))
        parts = F.split(package_of(F.col("file_path")), "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        below = keyed.select("name", F.explode(tails).alias("_tail"), "place").groupBy(F.col("name").alias("_n3"), "_tail").agg(F.min("place").alias("_imp"))
        out = out.join(modules, (out[file] == F.col("_mf")) & (out[qualifier] == F.col("_q")) & (out[qualifier] != ""), "left")
        out = out.join(below, (out[name] == F.col("_n3")) & (F.col("_m") == F.col("_tail")), "left")
        imported = F.col("_imp")
    return out.withColumn("target", F.coalesce("_here", imported, "_first")).select(*[refs[c] for c in refs.columns], "target")


def _place(field: str, default: object) -> Column:
    return F.coalesce(F.col(f"target.{field}"), F.lit(default)).alias(field)


def callees(edges: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """What each definition refers to: src_id, name, qualifier, kind, resolved, the target's
    file_path, node_kind, parent, start_line, end_line (empty or 0 where unresolved), line, ref_file.

    A reference that resolves to nothing is dropped, a call or inheritance kept. Repeated
    references of one line count once.
    """
    refs = edges.where(F.coalesce(F.col("src_id"), F.lit("")) != "").withColumn("dst_qualifier", F.coalesce("dst_qualifier", F.lit(""))).dropDuplicates(["src_id", "dst_name", "dst_qualifier", "kind", "file_path", "line"])
    got = resolve(refs, symbols(chunks), imports)
    return got.where(F.col("target").isNotNull() | (F.col("kind") != "reference")).select(
        "src_id", F.col("dst_name").alias("name"), F.col("dst_qualifier").alias("qualifier"), "kind", F.col("target").isNotNull().alias("resolved"),
        _place("file_path", ""), _place("node_kind", ""), _place("parent", ""), _place("start_line", 0), _place("end_line", 0), "line", F.col("file_path").alias("ref_file"),
    )


#: What is told of a caller, in the order in which one of several references is chosen.
CALLER = ("ref_file", "line", "start_line", "qualifier", "kind", "node_kind", "parent", "end_line")


def references(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every reference with the definition it is in: target, name, file_path and ``CALLER``.

    The caller's name is the edge's source name, else its chunk's; without either the edge is
    left out. Its place is that of the name, else of the chunk, else of the reference. Edges
    without a chunk, which may be a third of all, don't go through the join by chunk.
    """
    kept = edges.where(F.col("dst_name").isNotNull())
    sourced = F.coalesce(F.col("src_id"), F.lit("")) != ""
    place = F.struct("name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("file_path", "node_kind", "parent")], "start_line", "end_line")
    byid = chunks.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("src_id")).agg(F.min(place).alias("_c"))
    refs = kept.where(sourced).join(byid, "src_id", "left").unionByName(kept.where(~sourced).withColumn("_c", F.lit(None).cast(byid.schema["_c"].dataType)))
    refs = refs.withColumn("caller", F.when(F.coalesce(F.col("src_name"), F.lit("")) != "", F.col("src_name")).otherwise(F.col("_c.name"))).where(F.coalesce(F.col("caller"), F.lit("")) != "")
    got = resolve(refs, symbols(chunks), None, name="caller", qualifier=None)
    known, blank = F.coalesce(F.col("target.id").isNotNull(), F.lit(False)), lambda c: F.coalesce(c, F.lit(""))
    pick = lambda c, last: F.when(known, F.col(f"target.{c}")).when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(last).alias(c)
    return got.select(
        F.col("dst_name").alias("target_name"), F.col("caller").alias("name"), pick("file_path", F.col("file_path")), F.col("file_path").alias("ref_file"), "line",
        pick("start_line", F.col("line")), blank(F.col("dst_qualifier")).alias("qualifier"), "kind", blank(pick("node_kind", F.lit(""))).alias("node_kind"), blank(pick("parent", F.lit(""))).alias("parent"),
        pick("end_line", F.lit(0)),
    ).withColumnRenamed("target_name", "target")


def callers(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Who refers to each name: target, name, file_path and ``CALLER``.

    A caller with one place counts once for a target, by its first reference (ref_file, line).
    """
    by = ["target", "name", "file_path"]
    return references(edges, chunks).groupBy(*by).agg(F.min(F.struct(*CALLER)).alias("r")).select(*by, *[f"r.{c}" for c in CALLER])


def impact(edges: DataFrame, chunks: DataFrame, name: str, depth: int = DEPTH) -> DataFrame:
    """Names that reach ``name`` over callers, each by its first discovery: name, depth, file_path
    and ``CALLER``.

    Breadth first over names, at most ten levels. Of one level a name is found from the caller
    found first, by its first reference. Each level is one join, and its result is written to the
    shared folder, so a lost executor costs no more than a level.
    """
    depth = DEPTH if depth <= 0 else min(depth, DEEPEST)
    links = references(edges, chunks).groupBy("target", "name").agg(F.min(F.struct(*CALLER[:2], "file_path", *CALLER[2:])).alias("r"))
    links = checkpointed(links)
    spark = edges.sparkSession
    step = "ref_file string, line int, name string"
    seen = spark.createDataFrame([(name,)], "name string")
    frontier = spark.createDataFrame([(name, [])], f"name string, way array<struct<{step.replace(' ', ': ').replace(',:', ',')}>>")
    levels = []
    for level in range(1, depth + 1):
        new = links.join(seen, "name", "left_anti").join(frontier.select(F.col("name").alias("target"), F.col("way").alias("before")), "target")
        way = F.concat("before", F.array(F.struct(F.col("r.ref_file").alias("ref_file"), F.col("r.line").alias("line"), F.col("name"))))
        first = new.select("name", F.struct(way.alias("way"), F.col("r").alias("r")).alias("o")).groupBy("name").agg(F.min("o").alias("o"))
        found = checkpointed(first.select("name", F.lit(level).alias("depth"), F.col("o.way").alias("way"), "o.r.*"))
        if found.isEmpty():
            break
        levels.append(found)
        frontier, seen = found.select("name", "way"), seen.unionByName(found.select("name"))
    out = ["name", "depth", "file_path", *CALLER]
    if not levels:
        return links.select("name", F.lit(0).alias("depth"), "r.*").select(*out).limit(0)
    return functools.reduce(DataFrame.unionByName, levels).select(*out)


def require_graph(edges: DataFrame) -> None:
    if edges.isEmpty():
        raise GraphNotBuilt("graph not built: index the project with its graph first")


def formatted(refs: DataFrame, at_reference: bool = False, show_depth: bool = False) -> DataFrame:
    """References as lines of text, ``line_text``: place and name, with what contains it, the kind
    unless it is a call, and the depth if wanted. The place is the definition's or, for callers
    and impact, that of the reference; what is unresolved is external."""
    have = lambda c, other: F.col(c) if c in refs.columns else F.lit(other)
    resolved, parent = have("resolved", True), F.coalesce(have("parent", ""), F.lit(""))
    file = F.when(resolved & F.lit(not at_reference), F.col("file_path")).otherwise(F.col("ref_file"))
    line = F.when(resolved & F.lit(not at_reference), F.col("start_line")).otherwise(F.col("line"))
    before = F.when(resolved, parent).otherwise(F.coalesce(have("qualifier", ""), F.lit("")))
    name = F.when(before != "", F.concat(before, F.lit("."), "name")).otherwise(F.col("name"))
    text = F.concat(F.lit("  "), file, F.lit(":"), line.cast("string"), F.lit(" "), name, F.when(resolved, "").otherwise(" (external)"))
    text = F.concat(text, F.when(F.coalesce(F.col("kind"), F.lit("")).isin("", "call"), "").otherwise(F.concat(F.lit(" ("), "kind", F.lit(")"))))
    if show_depth:
        text = F.concat(text, F.lit(" depth="), F.col("depth").cast("string"))
    return refs.withColumn("line_text", text)


def listing(lines: list[str], relation: str, symbol: str, limit: int = 0) -> str:
    """The text of a list of references (lines of ``formatted``), with its heading; it says so if
    it was cut at the limit."""
    if not lines:
        return f"No {relation} {symbol} found.\n"
    cut = 0 < limit < len(lines)
    lines = lines[:limit] if cut else lines
    end = f"\n(truncated to {limit}; raise the limit to see more)\n" if cut else ""
    return "\n".join([f"{len(lines)} {relation} {symbol}:", *lines]) + "\n" + end
