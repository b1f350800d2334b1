"""Generated, minified, vendored files and data saved as code (problem 4).

Vendored copies are found by winnowing: the token stream of a file (comments and blanks left
out) is hashed in windows of ``GRAM`` tokens, and of every ``WINDOW`` neighbouring hashes the
least is kept as a fingerprint. A file is a copy if at least ``SHARE`` of its fingerprints are
those of chunks released upstream, or if nearly all (``MOST``) of many (``MANY``) recur in many
repositories: ``REPOS`` of them, and ``REPO_SHARE`` of all. What more than half of all repositories have is boilerplate and counts neither way,
unless it was released. A borrowed function in a file of one's own stays below the share; a copy with some lines changed above it.

The other kinds show in a file by itself: a generator's note in the comments before the first
code, a token stream made up of one short pattern over and over, very long lines without blanks,
literals making up most of the text, or a folder where package managers put third-party code.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filetext import per_file, text_of
from tessera.llm.languages import language_of
from tessera.session import checkpointed
from tessera.sources.tables import table

GRAM, WINDOW, SALTS, PATTERN = 20, 12, 8, 0.6
SHARE, MOST, MANY, REPOS, REPO_SHARE = 0.5, 0.75, 8, 3, 0.05

#: Folders of third-party and of generated code, and names that generators give.
THIRD_PARTY = re.compile(r"(?i)(?:^|/)(?:vendor|third[-_]?party|node_modules|bower_components|jspm_packages|godeps|site-packages|external|externals|extern|deps)/(?=[^/]+/)")
GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:gen|generated|autogen|auto-generated|generated-sources|__generated__)/|[._-](?:generated|gen|g)\.\w+$|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.go$|\.pb-c\.[ch]$|\.pb\.(?:cc|h)$|_(?:pb|grpc_pb)\.(?:js|d\.ts)$|\.designer\.\w+$|(?:^|/)zz_generated")
MINIFIED_PATH = re.compile(r"(?i)[.-]min\.(?:js|mjs|cjs|css)$|\.bundle\.js$")
NOTE = re.compile(
    r"(?i)\bcode generated\b.{0,80}\bdo not (?:edit|modify)|<auto-?generated|(?<![\w@])@generated\b|\bauto-?generated (?:file|code|by)\b|\bthis (?:file|code|class|module) (?:is|was|has been) (?:\w+ )?(?:auto-?|automatically )?(?:generated|produced|created) (?:by|from|with)\b"
    r"|\bgenerated (?:by|from|with)\b.{0,80}\b(?:do not|don't) (?:edit|modify|change|touch)|\b(?:do not|don't) (?:edit|modify)\b.{0,20}(?:re)?(?:built|generated|created)|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bgenerado autom|\barchivo generado|\bgénéré automatiquement|\bmachine[- ]generated\b"
)
TOKEN = re.compile(
    r"""(//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)|(\#[^\n]*)|(\"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"{3}|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`[^`]*`)|([0-9][\w.]*)|([^\W\d][\w$]*|\$[\w$]*)|(\S)"""
)
HASH_COMMENTS = {"python", "yaml", "c"}  # in C the lines of the preprocessor, no code of its own
KEYWORDS = frozenset("if else elif for while do return def class function const let var int static func fn switch case default break continue import from as in is not and or try catch except finally with pass raise throw new this self lambda package type struct interface map go defer range nil null None null true false True False void char unsigned export async await".split())


def read(text: str, language: str | None) -> tuple[list[str], list[str], str, float]:
    """Tokens, their shapes, the comments before the first code, and the literals' share."""
    tokens: list[str] = []
    shapes: list[str] = []
    head: list[str] = []
    total = literal = 0
    hashes = language in HASH_COMMENTS
    for comment, sharp, string, number, word, sign in TOKEN.findall(text):
        if comment or sharp and hashes:
            if not tokens:
                head.append(comment or sharp)
            continue
        t = string or number or word or sign or sharp
        total += len(t)
        if string:
            shapes.append("S")
            if len(t) > 3 and " " not in t:
                literal += len(t)
            t = "S"
        elif number:
            shapes.append("N")
            literal += len(t)
        else:
            shapes.append(t if not word or word in KEYWORDS else "I")
        tokens.append(t)
    return tokens, shapes, "\n".join(head), literal / total if total else 0.0


def one_pattern(shapes: list[str], gram: int = 8, period: int = 30) -> float:
    """Share of the stream that its ``period`` most frequent shapes of ``gram`` tokens make up.

    Shapes of words alone, as prose has them, count for nothing.
    """
    grams = Counter(zip(*(shapes[i:] for i in range(gram))))
    total = sum(grams.values())
    code = ((g, n) for g, n in grams.items() if n >= 3 and not all(t == "I" or t in KEYWORDS for t in g))
    return sum(sorted((n for _, n in code), reverse=True)[:period]) / total if total else 0.0


def fingerprints(tokens: list[str], gram: int = GRAM, window: int = WINDOW) -> list[int]:
    """Winnowed hashes of the stream, distinct; any common run of gram + window - 1 tokens gives
    a common one. Streams shorter than ``gram`` have none."""
    n = len(tokens) - gram + 1
    if n < 1:
        return []
    one = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    h ^= h >> np.uint64(29)
    if n > window:
        h = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    return np.unique(h).view(np.int64).tolist()


def kind_by_itself(path: str, text: str, tokens: list[str], shapes: list[str], head: str, literal: float, language: str | None) -> str | None:
    """generated, minified, data or vendored, as far as the file alone shows it."""
    if THIRD_PARTY.search(path):
        return "vendored"
    if MINIFIED_PATH.search(path):
        return "minified"
    if language in ("markdown", "json", "yaml", None):
        return None
    if NOTE.search(re.sub(r"\s*\n[ \t]*(?:\*|//|#)?[ \t]*", " ", head)) or GENERATED_PATH.search(path):
        return "generated"
    lines = [x for x in text.split("\n") if x.strip()]
    if lines and tokens and len(text) >= 400:
        blank = sum(map(text.count, " \t\n\r")) / len(text)
        mean = len(text) / len(lines)
        if mean > 200 and blank < 0.08 and len(tokens) > 100:
            return "minified"
    if literal >= 0.6 and len(text) >= 400:
        return "data" if one_pattern(shapes) >= 0.4 or literal >= 0.85 else None
    if len(tokens) >= 60 and one_pattern(shapes) >= PATTERN:
        return "generated"
    return None


def _features(path: str, rows: list[tuple]):
    language = language_of(path)
    text = text_of([(s, c) for s, c, _ in rows])
    tokens, shapes, head, literal = read(text, language)
    known: list[int] = []
    prints: list[int] = []
    if language not in ("markdown", "json", "yaml", None):
        prints = fingerprints(tokens)
        for _, content, upstream in rows:
            if upstream and content:
                known += fingerprints(read(content, language)[0])
    yield path, path.partition("/")[0], kind_by_itself(path, text, tokens, shapes, head, literal, language), prints, sorted(set(known))


def file_kinds(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row per file with chunks: file_path, kind (generated, minified, data, vendored or null).

    What a file shows by itself goes before what its fingerprints show. Null contents are blank,
    chunks without a path are left out; files of unknown languages, prose and configuration are
    judged by their path alone. Empty tables give no rows, or no copies.

    Fingerprints move as two long numbers each. Their counts by repository are combined on the
    map side; the join back to the files is salted, as one fingerprint may be in any number of
    files. The number of repositories, one row, reaches the driver.
    """
    released = upstream.select("content_hash").where(F.col("content_hash").isNotNull()).distinct().withColumn("upstream", F.lit(True))
    marked = chunks.select("file_path", "start_line", "content", "content_hash").join(released, "content_hash", "left")
    files = per_file(marked, ["start_line", "content", "upstream"], _features, "file_path string, repo string, kind string, prints array<long>, known array<long>")
    files = files.withColumn("file", F.xxhash64("file_path"))
    files = checkpointed(files)
    repos = files.agg(F.count_distinct("repo").alias("n")).first()["n"]
    prints = files.select("file", F.hash("repo").alias("repo"), F.explode("prints").alias("print"))
    spread = prints.groupBy("print", "repo").agg(F.lit(1).alias("one")).groupBy("print").agg(F.count("*").alias("repos"))
    known = files.select(F.explode("known").alias("print")).distinct().withColumn("up", F.lit(True))
    marks = spread.where(F.col("repos") >= max(REPOS, REPO_SHARE * repos)).join(known, "print", "full_outer").select("print", F.coalesce("up", F.lit(False)).alias("up"), (F.col("up").isNull() & (2 * F.col("repos") > max(2 * REPOS, repos))).alias("boiler"))
    salted = marks.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    hits = (
        prints.withColumn("salt", F.pmod("file", F.lit(SALTS)).cast("int")).join(salted, ["print", "salt"])
        .groupBy("file").agg(F.count(F.when(F.col("up"), 1)).alias("up"), F.count(F.when(~F.col("boiler"), 1)).alias("recur"), F.count(F.when(F.col("boiler"), 1)).alias("boiler"))
    )
    of = F.size("prints") - F.col("boiler")
    copied = (of > 2) & ((F.col("up") >= SHARE * of) | (F.col("recur") >= MOST * of) & (of >= MANY))
    return files.join(hits, "file", "left").select("file_path", F.coalesce("kind", F.when(copied, F.lit("vendored"))).alias("kind"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote here by hand."""
    kinds = file_kinds(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "upstream_chunks"))
    return kinds.where(F.col("kind").isNotNull()).select(F.col("file_path").alias("path"))


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by kind, hand-written ones as such."""
    kinds = file_kinds(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "upstream_chunks"))
    return kinds.groupBy(F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count("*").alias("files"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
