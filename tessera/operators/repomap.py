"""Structural maps of a corpus: packages, files and their symbols under a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import kind_label, line_range, package_of, visibility
from tessera.operators.graph import symbols
from tessera.operators.ordering import numbered

#: Languages that are no code, and the symbols a file needs to have a summary.
NON_CODE = ("markdown", "yaml", "json")
LEAST = 5


def mapped_symbols(chunks: DataFrame, code_only: bool = True, non_code: tuple[str, ...] = NON_CODE) -> DataFrame:
    """Symbols with package, label, mark and lines.

    The language of a file's first symbol is the file's: it leaves the file out as a whole if it
    is no code, and it decides on the marks.
    """
    langs = chunks.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.lower("language")).alias("language"))
    named = symbols(chunks).join(langs, "id")
    first = named.groupBy("file_path").agg(F.coalesce(F.min_by("language", F.struct("start_line", "id")), F.lit("")).alias("_first"))
    if code_only:
        first = first.where(~F.col("_first").isin(*non_code))
    named = named.join(first, "file_path")
    return named.select(
        *[c for c in named.columns if c != "_first"], package_of(F.col("file_path")).alias("package"), kind_label(F.col("node_kind")).alias("label"),
        visibility(F.col("_first"), F.col("name"), F.col("node_kind")).alias("mark"), line_range(F.col("start_line"), F.col("end_line")).alias("lines"),
    )


def _packages(named: DataFrame) -> DataFrame:
    return named.groupBy("package").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))


def package_ranks(named: DataFrame) -> DataFrame:
    """package, symbols, files, rn: most symbols first, then by name."""
    return numbered(_packages(named), [F.desc("symbols"), F.asc("package")], "rn")


def kind_summary(named: DataFrame, least: int = LEAST) -> DataFrame:
    """file_path, symbols, summary (counts by label, labels sorted, in brackets) of files with enough symbols."""
    by = named.groupBy("file_path", "label").agg(F.count("*").alias("n"))
    each = by.groupBy("file_path").agg(F.sum("n").alias("symbols"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"])), ", ")
    return each.where(F.col("symbols") >= least).select("file_path", "symbols", F.concat(F.lit("("), text, F.lit(")")).alias("summary"))


def common_root(paths: DataFrame, path: str = "path", by: str | None = None) -> DataFrame:
    """One row, root: the longest folder all paths are below; empty if there is none. The least
    and greatest path, part by part, have it in common. With ``by`` a row for each of its values."""
    keys = [by] if by else []
    parts = F.split(package_of(F.col(path)), "/")
    ends = paths.where(F.col(path).isNotNull()).groupBy(*keys).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("a"), F.size("b")))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    n = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(*keys, F.coalesce(F.array_join(F.slice("a", F.lit(1), n), "/"), F.lit("")).alias("root"))


def nested(named: DataFrame) -> DataFrame:
    """id, level: 1 for a symbol whose parent is a symbol of its file without a parent, else 0."""
    return _laid_out(named).groupBy("id").agg(F.max("level").alias("level"))


def _laid_out(named: DataFrame) -> DataFrame:
    """Symbols in the places of their file: the columns given, part (0 for those without a parent
    and what is below them, 1 for the rest), at (start_line and id of the symbol above), level.

    A symbol below several of its parent's name is listed below each.
    """
    top = F.coalesce(F.col("parent"), F.lit("")) == ""
    at = F.struct("start_line", "id")
    heads = named.where(top).select("file_path", F.col("name").alias("parent"), at.alias("_at"))
    below = named.where(~top).join(heads, ["file_path", "parent"], "left")
    return named.where(top).select(*named.columns, F.lit(0).alias("part"), at.alias("at"), F.lit(0).alias("level")).unionByName(
        below.select(*named.columns, F.when(F.col("_at").isNull(), 1).otherwise(0).alias("part"), F.coalesce("_at", at).alias("at"), F.when(F.col("_at").isNull(), 0).otherwise(1).alias("level"))
    )


def symbol_line(level: Column) -> Column:
    """The line of a symbol in the map, with its end."""
    marked = F.when(F.col("mark") != "", F.concat("mark", F.lit(" "))).otherwise("")
    return F.concat(F.repeat(F.lit(" "), 2 + 2 * level), marked, "label", F.lit(" "), "name", "lines", F.lit("\n"))


def file_lines(named: DataFrame, summary: bool = True, marks: bool = True) -> DataFrame:
    """Per file: package, file_path, symbols, text (its block of the map: path, summary of files
    with many symbols, and symbols with their marks, those below another after it)."""
    named = named if marks else named.withColumn("mark", F.lit(""))
    flat = _laid_out(named).select("package", "file_path", "id", F.struct("part", "at", "level", "start_line", "id", symbol_line(F.col("level")).alias("t")).alias("s"))
    blocks = flat.groupBy("package", "file_path").agg(F.countDistinct("id").alias("symbols"), F.array_sort(F.collect_list("s")).alias("l"))
    sums = kind_summary(named).select("file_path", F.concat(F.lit(" "), "summary").alias("summary"))
    head = F.concat("file_path", F.coalesce("summary", F.lit("")) if summary else F.lit(""), F.lit("\n"))
    return blocks.join(sums, "file_path", "left").select("package", "file_path", "symbols", F.concat(head, F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("\n")).alias("text"))


def package_header(package: Column, files: Column, symbols_: Column) -> Column:
    return F.concat(F.lit("# package: "), package, F.lit(" ("), files.cast("string"), F.lit(" files, "), symbols_.cast("string"), F.lit(" symbols)\n\n"))


def budgeted(named: DataFrame, max_tokens: int, summary: bool = True, marks: bool = True) -> DataFrame:
    """The map's blocks in order, as far as the budget of four bytes a token goes: rn, package,
    file_path (null for the package's heading), symbols, text.

    Packages with most symbols come first, and in them files with most; the map ends before the
    first block that is over the budget, and the first file is always there. 0 means no bound.
    Every block has more than four bytes, so with a budget only its first ``max_tokens`` + 2 blocks
    are looked at in one task; without one they are numbered by ranges.
    """
    files = file_lines(named, summary, marks)
    ranks = _packages(named).select("package", F.col("symbols").alias("all"), "files")
    heads = ranks.select("package", "all", F.lit(-1).cast("bigint").alias("less"), F.lit(None).cast("string").alias("file_path"), F.col("all").alias("symbols"), package_header(F.col("package"), F.col("files"), F.col("all")).alias("text"))
    blocks = heads.unionByName(files.join(ranks, "package").select("package", "all", F.lit(0).cast("bigint").alias("less"), "file_path", "symbols", "text"))
    order = [F.desc("all"), F.asc("package"), F.asc("less"), F.desc("symbols"), F.asc_nulls_first("file_path")]
    if max_tokens <= 0:
        return numbered(blocks, order, "rn").select("rn", "package", "file_path", "symbols", "text")
    leading = blocks.orderBy(*order).limit(max_tokens + 2)
    spent = F.sum(F.octet_length("text").cast("long")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = leading.withColumn("rn", F.row_number().over(W.orderBy(*order)).cast("long")).withColumn("spent", spent)
    return out.where((F.col("rn") <= 2) | (F.col("spent") <= max_tokens * 4)).select("rn", "package", "file_path", "symbols", "text")


def render(named: DataFrame, max_tokens: int, summary: bool = True, marks: bool = True) -> str:
    """The map as text, with a closing line if files were left out."""
    rows = budgeted(named, max_tokens, summary, marks).orderBy("rn").collect()
    text = "".join(r["text"] for r in rows)
    written = [r for r in rows if r["file_path"] is not None]
    total = named.agg(F.countDistinct("file_path").alias("f"), F.countDistinct("package").alias("p")).first()
    more = total["f"] - len(written)
    if more:
        rest = total["p"] - len({r["package"] for r in written})
        text += f"# ... {more} more files in {rest} packages (truncated to ~{max_tokens} tokens)\n"
    return text
