"""Source files that do not parse (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filetext import per_file, text_of
from tessera.llm.languages import language_of, place
from tessera.sources.tables import table


def _check(path: str, rows: list[tuple]):
    language = language_of(path)
    if language is not None:
        yield path, path.partition("/")[0], language, *(place(text_of(rows), language) or (None, None, None))


def file_syntax(chunks: DataFrame) -> DataFrame:
    """One row per file with a known extension: file_path, repo, language, problem, token, line.

    ``language`` is that of the extension, whatever the chunks say. ``problem`` is null if the
    text put together from the chunks parses, ``token`` if no parse is left at some token, and
    ``truncated`` if something is still open at its end. Markdown always parses, and so does a
    file of blanks alone (but for json, which needs a value, and go, which needs its package).
    ``token`` is the number of the token at which no parse is left, and ``line`` its line.
    Repeated chunks count once; an empty table gives no rows.
    """
    return per_file(chunks, ["start_line", "content"], _check, "file_path string, repo string, language string, problem string, token int, line int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be parsed in the language of their extension."""
    return file_syntax(table(spark, sf_dir, "chunks")).where(F.col("problem").isNotNull()).select("file_path")


def p1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file that cannot be parsed fails."""
    return file_syntax(table(spark, sf_dir, "chunks")).where(F.col("problem").isNotNull()).select("file_path", "language", "problem", "token", "line")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, failing files and their share by repository and language."""
    failing = F.count("problem")
    return (
        file_syntax(table(spark, sf_dir, "chunks"))
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), failing.alias("failing"), (failing / F.count("*")).alias("rate"))
    )


QUERIES = {"p1_found": p1_found, "p1_places": p1_places, "p1_rates": p1_rates}
SQL: dict[str, str] = {}
