"""Column expressions of the retrieval engine; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The short label of a node kind, where it is not the kind itself.
KIND_LABELS = {
    "function_declaration": "func", "function_definition": "func", "method_declaration": "func", "method_definition": "func",
    "type_declaration": "type", "type_spec": "type", "class_declaration": "class", "class_definition": "class",
    "interface_declaration": "interface", "interface_type": "interface", "struct_type": "struct", "export_statement": "export",
}


def words_of(identifier: Column) -> Column:
    """An identifier in lower case, then its parts at underscores and humps, in order.

    The parts of an underscore part follow it; repeated parts count once. An identifier that
    has one part gives itself alone. Null gives null.
    """
    spaced = F.regexp_replace(F.regexp_replace(identifier, r"([^\p{Lu}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    snake = F.filter(F.split(spaced, "_"), lambda p: p != "")
    parts = F.flatten(
        F.transform(snake, lambda p: F.concat(F.array(F.lower(F.replace(p, F.lit(" "), F.lit("")))), F.filter(F.transform(F.split(p, " "), lambda x: F.lower(x)), lambda x: x != "")))
    )
    distinct = F.array_distinct(parts)
    whole = F.lower(identifier)
    rest = F.array_except(distinct, F.array(whole))
    return F.when(F.size(distinct) <= 1, F.array(whole)).otherwise(F.concat(F.array(whole), rest))


def search_tokens(text: Column) -> Column:
    """Tokens of a text for search, in order.

    Words part at blanks; one without a letter stays as it is. Signs before the identifier are a
    token, those after it are dropped, and the identifier is taken apart by ``words_of``.
    """
    def of(word: Column) -> Column:
        head = F.regexp_extract(word, r"^([^\p{L}\p{Nd}_]*)", 1)
        name = F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{Nd}_]+", ""), r"[^\p{L}\p{Nd}_]+$", "")
        lead = F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))
        return F.when(~word.rlike(r"\p{L}"), F.array(word)).otherwise(F.concat(lead, words_of(name)))

    bare = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.flatten(F.transform(bare, of))


def record_id(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\0"), content), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def token_estimate(content: Column) -> Column:
    """Tokens as a quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(F.coalesce(content, F.lit(""))) / 4)


def package_of(path: Column) -> Column:
    """The folder of a path relative to its root; the root itself is a dot."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit(".")).otherwise(folder)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def kind_label(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    return F.coalesce(table[kind], kind)


def visibility(language: Column, name: Column, kind: Column) -> Column:
    """``+`` for exported and ``-`` for private symbols where the language tells, else empty."""
    mark = lambda c: F.when(c, "+").otherwise("-")
    return (
        F.when(language == "go", mark(name.rlike(r"^\p{Lu}")))
        .when(language.isin("python", "ruby"), mark(~name.startswith("_")))
        .when(language.isin("javascript", "typescript", "tsx"), mark(kind == "export_statement"))
        .otherwise("")
    )


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit(":"), start.cast("string"))).otherwise(F.format_string(":%d-%d", start, end))


def project_hash(path: Column) -> Column:
    return F.sha1(F.trim(path, F.lit("/")))


def path_tail(path: Column, width: int) -> Column:
    """The last signs of a path with an ellipsis before them, if it has more than ``width``; none for no width."""
    if width <= 0:
        return F.when(path.isNotNull(), F.lit(""))
    return F.when(F.char_length(path) <= width, path).otherwise(F.concat(F.lit("…"), F.substring(path, -(width - 1), width - 1) if width > 1 else F.lit("")))


def human_bytes(n: Column) -> Column:
    """A number of bytes in units of 1024, with one decimal from a KiB on."""
    out = F.format_string("%.1f PiB", n / F.lit(2.0**50))
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")):
        out = F.when(n < F.lit(2 ** (power + 10)), F.format_string(f"%.1f {unit}", n / F.lit(2.0**power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def truncated(tokens: Column, most: int = 512) -> Column:
    """The leading tokens an embedder takes."""
    return F.slice(tokens, 1, most)
