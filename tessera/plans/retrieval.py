"""Queries of search, map, graph and index, with their SQL."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import terms
from tessera.functions import text as X
from tessera.functions.globs import matches_any
from tessera.operators import graph as G
from tessera.operators import indexing as I
from tessera.operators import repomap as M
from tessera.operators import search as S
from tessera.operators.fulltext import phrases_of, postings
from tessera.session import checkpointed
from tessera.sources.tables import table
from tessera.streaming import watch as E

QUERIES: dict = {}
SQL: dict[str, str] = {}
GLOBS = ["*/core/*.go", "fernhollow/**", "*/src/model/[a-m]*.py"]
IGNORES = ["*.min.js", "vendor/", "/larkspur-ui/api", "build_*", "!build_info", "node_modules/", "gen/**", "# note", "report/[!a-k]*.json"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Repeated rows of an id are told apart by these, greatest first, and then by having a vector.
_ORDER = [f"coalesce({c}, '')" for c in ("language", "name", "parent", "file_path", "node_kind")] + ["coalesce(start_line, 0)", "coalesce(end_line, 0)"]

_ONE = f"""c AS (SELECT id, file_path, lower(nullif(language, '')) AS language, content, content_hash, node_kind, nullif(name, '') AS name, nullif(parent, '') AS parent, start_line, end_line, embedding
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(f'{o} DESC' for o in _ORDER)}, (embedding IS NOT NULL) DESC) AS one FROM chunks WHERE id IS NOT NULL) t WHERE one = 1)"""


def plain(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per chunk id, the first by ``_ORDER``: language in lower case, and null for the empty
    strings of language, name and parent. Of content, hash and vector only those asked for are
    read and shuffled."""
    rows = table(spark, sf, "chunks").where(F.col("id").isNotNull())
    own = ("file_path", "language", "node_kind", "name", "parent", "start_line", "end_line", *columns)
    order = F.expr(f"struct({', '.join(_ORDER + (['embedding IS NOT NULL'] if 'embedding' in columns else []))})")
    one = rows.groupBy("id").agg(F.max_by(F.struct(*own), order).alias("r")).select("id", "r.*")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return one.select("id", "file_path", F.lower(blank("language")).alias("language"), "node_kind", blank("name").alias("name"), blank("parent").alias("parent"), "start_line", "end_line", *columns)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return plain(spark, sf, "content", "content_hash", "embedding")


def _knn_sql(where: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT q.qid, v.vec_id, list_sum(list_transform(list_zip(q.e, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d
      FROM q, embeddings v WHERE {where})
SELECT qid, vec_id, rn FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(d, 12), vec_id) AS rn FROM d) t WHERE rn <= 10
"""


@query(_knn_sql("true"))
def knn_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return S.nearest_many(v, v.where(F.col("vec_id") % 100 == 0), 10, "vec_id")


@query(_knn_sql("v.label = 3"))
def knn_lang_prefilter(spark, sf):
    v = table(spark, sf, "embeddings")
    return S.nearest_many(v.where(F.col("label") == 3), v.where(F.col("vec_id") % 100 == 0), 10, "vec_id")


@query(
    r"""
WITH n AS (SELECT DISTINCT name FROM chunks WHERE name IS NOT NULL AND name <> ''),
s AS (SELECT name, list_filter(string_split(regexp_replace(regexp_replace(name, '([^\p{Lu}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '_'), lambda x: x <> '') AS snake FROM n),
p AS (SELECT name, flatten(list_transform(snake, lambda x: list_concat([lower(replace(x, ' ', ''))], list_filter(list_transform(string_split(x, ' '), lambda y: lower(y)), lambda y: y <> '')))) AS parts FROM s),
u AS (SELECT name, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS parts FROM p)
SELECT name, CASE WHEN len(parts) <= 1 THEN lower(name) ELSE array_to_string(list_concat([lower(name)], list_filter(parts, lambda x: x <> lower(name))), ' ') END AS tokens FROM u
"""
)
def tokenize_identifiers(spark, sf):
    names = table(spark, sf, "chunks").select("name").where("name <> ''").distinct()
    return names.select("name", F.array_join(X.words_of(F.col("name")), " ").alias("tokens"))


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Search tokens of distinct words (table dw of words w).
_TOKENS = r"""wp AS (SELECT w, regexp_extract(w, '^([^\p{L}\p{Nd}_]*)', 1) AS head, regexp_replace(regexp_replace(w, '^[^\p{L}\p{Nd}_]+', ''), '[^\p{L}\p{Nd}_]+$', '') AS nm FROM dw),
wsn AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(nm, '([^\p{Lu}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '_'), lambda x: x <> '') AS snake FROM wp),
wpa AS (SELECT *, flatten(list_transform(snake, lambda x: list_concat([lower(replace(x, ' ', ''))], list_filter(list_transform(string_split(x, ' '), lambda y: lower(y)), lambda y: y <> '')))) AS parts FROM wsn),
wu AS (SELECT *, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS uniq FROM wpa),
wt AS (SELECT w, CASE WHEN NOT regexp_matches(w, '\p{L}') THEN [w] ELSE list_concat(CASE WHEN head <> '' THEN [head] ELSE [] END, CASE WHEN len(uniq) <= 1 THEN [lower(nm)] ELSE list_concat([lower(nm)], list_filter(uniq, lambda x: x <> lower(nm))) END) END AS toks FROM wu)"""


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), ww AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_BLANK}')) AS w, generate_subscripts(regexp_split_to_array(text, '{_BLANK}'), 1) AS i FROM d),
dw AS (SELECT DISTINCT w FROM ww WHERE w <> ''), {_TOKENS} SELECT d.doc_id, array_to_string(coalesce(any_value(t.tokens), []), ' ') AS tokens FROM d LEFT JOIN (SELECT doc_id, flatten(list(toks ORDER BY i)) AS tokens FROM ww JOIN wt USING (w) GROUP BY doc_id) t USING (doc_id) GROUP BY d.doc_id"""
)
def tokenize_text(spark, sf):
    """The search tokens of every text, with blanks between."""
    return _tokens(spark, sf).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _tokens(spark, sf) -> DataFrame:
    def run(batches):
        for batch in batches:
            tokens = [terms.search_tokens(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "tokens"])

    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<string>")


def _bm25_sql(words: list[str], where: str = "true") -> str:
    """SQL of the table bm (id, score) for one-word phrases, by the definition of the score."""
    each = range(len(words))
    return f"""tx AS (SELECT id, content AS t FROM c UNION ALL SELECT id, name FROM c UNION ALL SELECT id, parent FROM c), ww AS (SELECT id, unnest(regexp_split_to_array(t, '{_BLANK}')) AS w FROM tx WHERE t IS NOT NULL),
dw AS (SELECT DISTINCT w FROM ww WHERE w <> ''), {_TOKENS}, wm AS (SELECT w, flatten(list_transform(toks, lambda x: list_filter(regexp_split_to_array(strip_accents(lower(x)), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> ''))) AS ts FROM wt),
ct AS (SELECT ww.id, sum(len(ts)) AS dl, {', '.join(f"sum(len(list_filter(ts, lambda x: x = '{w}'))) AS f{j}" for j, w in enumerate(words))} FROM ww JOIN wm USING (w) GROUP BY ww.id),
al AS (SELECT c.*, coalesce(dl, 0) AS dl, {', '.join(f"coalesce(f{j}, 0)::DOUBLE AS f{j}" for j in each)} FROM c LEFT JOIN ct USING (id)),
st AS (SELECT count(*) AS n, avg(dl) AS av, {', '.join(f"count(*) FILTER (WHERE f{j} > 0) AS n{j}" for j in each)} FROM al),
bm AS (SELECT id, {' '.join(f"- (CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) > 0 THEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) ELSE 1e-6 END) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * dl / av))" for j in each)} AS score FROM al, st WHERE {' AND '.join(f"f{j} > 0" for j in each)} AND {where})"""


@query(f"WITH {_ONE}, {_bm25_sql(['return', 'total'])} SELECT id, round(score, 9) AS score FROM bm")
def bm25_search(spark, sf):
    hits = S.bm25(chunks(spark, sf), "return total")
    return hits.select("id", F.round("score", 9).alias("score"))


_SOME = "language IN ('go', 'python') AND node_kind = 'function_declaration'"


@query(f"WITH {_ONE}, {_bm25_sql(['return', 'total'], _SOME)} SELECT id, round(score, 9) AS score FROM bm")
def bm25_filtered(spark, sf):
    hits = S.bm25(chunks(spark, sf), "return total", F.col("language").isin("go", "python") & (F.col("node_kind") == "function_declaration"))
    return hits.select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_ONE}, {_bm25_sql(['return', 'total'])} SELECT id, round(score, 9) AS score FROM bm")
def bm25_indexed(spark, sf):
    """The same over all postings, as an index stores them."""
    c = chunks(spark, sf)
    return S.bm25(c, "return total", index=checkpointed(postings(c))).select("id", F.round("score", 9).alias("score"))


def _vector(spark, sf) -> tuple[float, ...]:
    """The vector of the least chunk id that has one."""
    row = table(spark, sf, "chunks").where(F.size("embedding") == 64).where(F.forall("embedding", lambda x: ~F.isnan(x))).agg(F.min_by("embedding", "id").alias("e")).first()
    return tuple(row["e"] or [0.0] * 64)


_KNN = """qv AS (SELECT arg_min(embedding, id) AS q FROM chunks WHERE len(embedding) = 64 AND NOT list_contains(embedding, 'nan'::FLOAT) AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
kd AS (SELECT id, list_sum(list_transform(list_zip(q, embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM c, qv WHERE len(embedding) = 64 AND NOT list_contains(embedding, 'nan'::FLOAT)),
kr AS (SELECT id, row_number() OVER (ORDER BY round(d, 12), id) AS rn FROM kd WHERE d IS NOT NULL), br AS (SELECT id, row_number() OVER (ORDER BY round(score, 12), id) AS rn FROM bm)"""


def _rrf(fetch: str) -> str:
    return f"SELECT id, sum(1.0::DOUBLE / (60 + rn))::FLOAT AS score FROM (SELECT * FROM kr WHERE rn <= {fetch} UNION ALL SELECT * FROM br WHERE rn <= {fetch}) t GROUP BY id"


@query(f"WITH {_ONE}, {_bm25_sql(['emittrace', 'emit', 'trace'])}, {_KNN} SELECT id, round(score::DOUBLE, 9) AS score FROM ({_rrf('30')})")
def rrf_hybrid(spark, sf):
    return S.fused(chunks(spark, sf), S.Query("emitTrace", _vector(spark, sf)), 30).select("id", F.round(F.col("score").cast("double"), 9).alias("score"))


@query(f"WITH {_ONE}, {_bm25_sql(['return', 'total'])}, {_KNN} SELECT rn - 10 AS rn, id, file_path FROM (SELECT h.id, c.file_path, row_number() OVER (ORDER BY h.score DESC, h.id) AS rn FROM ({_rrf('60')}) h JOIN c USING (id)) t WHERE rn BETWEEN 11 AND 20")
def hybrid_paged(spark, sf):
    return S.search(chunks(spark, sf), S.Query("return total", _vector(spark, sf), limit=10, offset=10)).select("rn", "id", "file_path")


_WANTED = "language IN ('go', 'c') AND node_kind IN ('function_declaration', 'function_definition')"


@query(
    f"WITH {_ONE}, {_bm25_sql(['total'], _WANTED)}, {_KNN}, hs AS ({' UNION ALL '.join(f'SELECT {n} AS reach, * FROM ({_rrf(str(n))})' for n in (60, 180, 540))}),"
    f" kp AS (SELECT reach, h.id, c.language, row_number() OVER (PARTITION BY reach ORDER BY h.score DESC, h.id) AS rn FROM hs h JOIN c USING (id) WHERE {_WANTED} AND c.file_path LIKE 'fernhollow/%'),"
    " ch AS (SELECT coalesce(min(reach), 540) AS reach FROM (SELECT reach FROM kp GROUP BY reach HAVING count(*) >= 20)) SELECT rn, id, language FROM kp JOIN ch USING (reach) WHERE rn <= 20"
)
def hybrid_deepening(spark, sf):
    q = S.Query("total", _vector(spark, sf), limit=20, languages=("go", "c"), node_kinds=("function_declaration", "function_definition"), paths=("fernhollow/**",))
    return S.search(chunks(spark, sf), q).select("rn", "id", "language")


@query(
    f"WITH {_ONE}, {_bm25_sql(['return', 'total'], 'true')}, {_KNN}, pg AS (SELECT h.id, c.content, row_number() OVER (ORDER BY h.score DESC, h.id) AS rn FROM ({_rrf('90')}) h JOIN c USING (id) WHERE c.file_path LIKE 'fernhollow/%' OR regexp_matches(c.file_path, '^[^/]*/core/[^/]*$'))"
    " SELECT rn, id FROM (SELECT *, sum(octet_length(encode(content)) // 4) OVER (ORDER BY rn) AS spent FROM pg WHERE rn <= 30) t WHERE rn = 1 OR spent <= 500"
)
def hybrid_package(spark, sf):
    """A page of what is in a package or matches a pattern, without deepening beyond the first fetch that fills it, under 500 tokens."""
    q = S.Query("return total", _vector(spark, sf), limit=30, paths=("*/core/*",), package="fernhollow", max_tokens=500)
    return S.search(chunks(spark, sf), q).select("rn", "id")


@query("SELECT path FROM (SELECT DISTINCT path FROM files) f WHERE regexp_matches(path, '^[^/]*/core/[^/]*\\.go$|^fernhollow/.*$|^[^/]*/src/model/[a-m][^/]*\\.py$')")
def path_glob_filter(spark, sf):
    return table(spark, sf, "files").select("path").distinct().where(matches_any(F.col("path"), GLOBS))


@query(
    f"""
WITH {_ONE}, r AS (SELECT id, content, split_part(file_path, '/', 1) AS repo, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY file_path, start_line, id) AS rn FROM c)
SELECT repo, rn, id FROM (SELECT *, sum(octet_length(encode(content)) // 4) OVER (PARTITION BY repo ORDER BY rn) AS spent FROM r) t WHERE rn = 1 OR spent <= 4000
"""
)
def token_budget(spark, sf):
    """The leading chunks of each repository that fit 4000 tokens."""
    repo = F.split("file_path", "/")[0]
    order = W.partitionBy("repo").orderBy("file_path", "start_line", "id")
    ranked = plain(spark, sf, "content").withColumn("repo", repo).withColumn("rn", F.row_number().over(order))
    return S.within_budget(ranked, 4000, "repo").select("repo", "rn", "id")


@query("SELECT content_hash, min(id) AS id FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND content_hash IS NOT NULL GROUP BY content_hash")
def content_hash_reuse(spark, sf):
    return I.reusable(table(spark, sf, "chunks"), 64).select("content_hash", "id")


@query("SELECT DISTINCT id, sha256(file_path || chr(0) || content) = id AS same_id, sha256(content) = content_hash AS same_hash FROM chunks")
def record_ids(spark, sf):
    rows = table(spark, sf, "chunks")
    return rows.select("id", (X.record_id(F.col("file_path"), F.col("content")) == F.col("id")).alias("same_id"), (X.content_hash(F.col("content")) == F.col("content_hash")).alias("same_hash")).distinct()


@query(
    f"""
WITH {_ONE} SELECT 'chunks' AS what, '' AS language, count(*) AS n FROM c UNION ALL SELECT 'files', '', count(DISTINCT path) FROM files
UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'chunks', coalesce(language, '?'), count(*) FROM c GROUP BY coalesce(language, '?')
"""
)
def index_stats(spark, sf):
    c = plain(spark, sf)
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("language"), "n")
    by = c.groupBy(F.coalesce("language", F.lit("?")).alias("language")).count().select(F.lit("chunks").alias("what"), "language", F.col("count").alias("n"))
    return one(c, "chunks").union(one(table(spark, sf, "files").select("path").distinct(), "files")).union(one(table(spark, sf, "edges"), "edges")).union(by)


@query(f"WITH {_ONE} SELECT id, name, file_path, node_kind, start_line, end_line FROM c WHERE name IS NOT NULL")
def list_symbols(spark, sf):
    return G.symbols(plain(spark, sf)).select("id", "name", "file_path", "node_kind", "start_line", "end_line")


_PKG = r"CASE WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) END"
_LABELS = "CASE WHEN node_kind IN ('function_declaration', 'function_definition', 'method_declaration', 'method_definition') THEN 'func' WHEN node_kind IN ('type_declaration', 'type_spec') THEN 'type' WHEN node_kind IN ('class_declaration', 'class_definition') THEN 'class' WHEN node_kind IN ('interface_declaration', 'interface_type') THEN 'interface' WHEN node_kind = 'struct_type' THEN 'struct' WHEN node_kind = 'export_statement' THEN 'export' ELSE node_kind END"
_MAP = f"""{_ONE}, s AS (SELECT * FROM c WHERE name IS NOT NULL),
f AS (SELECT file_path, arg_min(coalesce(language, ''), (start_line, id)) AS first FROM s GROUP BY file_path),
m AS (SELECT s.*, f.first, {_PKG.replace('file_path', 's.file_path')} AS package, {_LABELS.replace('node_kind', 's.node_kind')} AS label FROM s JOIN f USING (file_path) WHERE f.first NOT IN ('markdown', 'json', 'yaml'))"""


@query(f"WITH {_MAP} SELECT package, symbols, files, row_number() OVER (ORDER BY symbols DESC, package) AS rn FROM (SELECT package, count(*) AS symbols, count(DISTINCT file_path) AS files FROM m GROUP BY package) t")
def package_rank(spark, sf):
    return M.package_ranks(M.mapped_symbols(plain(spark, sf)))


_KINDS = "k AS (SELECT file_path, label, count(*) AS n FROM m GROUP BY ALL), ks AS (SELECT file_path, sum(n)::BIGINT AS symbols, '(' || string_agg(n || ' ' || label, ', ' ORDER BY label) || ')' AS summary FROM k GROUP BY file_path HAVING sum(n) >= 5)"


@query(f"WITH {_MAP}, {_KINDS} SELECT file_path, symbols, summary FROM ks")
def kind_summary(spark, sf):
    return M.kind_summary(M.mapped_symbols(plain(spark, sf)))


_MARK = "CASE WHEN {l} = 'go' THEN CASE WHEN regexp_matches({n}, '^\\p{{Lu}}') THEN '+ ' ELSE '- ' END WHEN {l} IN ('python', 'ruby') THEN CASE WHEN starts_with({n}, '_') THEN '- ' ELSE '+ ' END WHEN {l} IN ('javascript', 'typescript', 'tsx') THEN CASE WHEN {k} = 'export_statement' THEN '+ ' ELSE '- ' END ELSE '' END"
_BLOCKS = f"""{_MAP}, {_KINDS}, sl AS (SELECT *, {_MARK.format(l='first', n='name', k='node_kind')} || label || ' ' || name || CASE WHEN start_line = end_line THEN ':' || start_line ELSE ':' || start_line || '-' || end_line END AS line FROM m),
tp AS (SELECT file_path, name, start_line, id FROM sl WHERE parent IS NULL),
ln AS (SELECT package, file_path, id, 0 AS part, start_line AS a1, id AS a2, 0 AS level, start_line, '  ' || line || chr(10) AS t FROM sl WHERE parent IS NULL UNION ALL
  SELECT sl.package, sl.file_path, sl.id, CASE WHEN tp.id IS NULL THEN 1 ELSE 0 END, coalesce(tp.start_line, sl.start_line), coalesce(tp.id, sl.id), CASE WHEN tp.id IS NULL THEN 0 ELSE 1 END, sl.start_line, CASE WHEN tp.id IS NULL THEN '  ' ELSE '    ' END || sl.line || chr(10)
  FROM sl LEFT JOIN tp ON tp.file_path = sl.file_path AND tp.name = sl.parent WHERE sl.parent IS NOT NULL),
fb AS (SELECT ln.package, ln.file_path, count(DISTINCT ln.id) AS symbols, ln.file_path || coalesce(' ' || any_value(ks.summary), '') || chr(10) || string_agg(t, '' ORDER BY part, a1, a2, level, ln.start_line, ln.id) || chr(10) AS text FROM ln LEFT JOIN ks ON ks.file_path = ln.file_path GROUP BY ln.package, ln.file_path),
pr AS (SELECT package, count(*) AS n, count(DISTINCT file_path) AS files FROM m GROUP BY package),
bl AS (SELECT package, n, -1 AS less, NULL AS file_path, n AS symbols, '# package: ' || package || ' (' || files || ' files, ' || n || ' symbols)' || chr(10) || chr(10) AS text FROM pr UNION ALL
  SELECT fb.package, pr.n, 0, fb.file_path, fb.symbols, fb.text FROM fb JOIN pr USING (package)),
od AS (SELECT *, row_number() OVER w AS rn, sum(octet_length(encode(text))) OVER w AS spent FROM bl WINDOW w AS (ORDER BY n DESC, package, less, symbols DESC, file_path NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_BLOCKS} SELECT rn, package, file_path, symbols, text FROM od WHERE rn <= 2 OR spent <= 8000")
def repo_map_budget(spark, sf):
    """The map of the whole corpus under 2000 tokens."""
    return M.budgeted(M.mapped_symbols(plain(spark, sf)), 2000)


@query(f"WITH {_BLOCKS} SELECT rn, package, file_path, symbols, text FROM od")
def repo_map(spark, sf):
    """The whole map, without a bound."""
    return M.budgeted(M.mapped_symbols(plain(spark, sf)), 0)


@query(
    r"""
WITH f AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, string_split(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END, '/') AS p FROM files WHERE path IS NOT NULL),
n AS (SELECT repo, i, count(DISTINCT p[:i]) AS kinds, count(*) FILTER (WHERE len(p) >= i) AS deep, count(*) AS al, min(p[:i]) AS head FROM f, (SELECT unnest(range(1, 64)) AS i) GROUP BY repo, i)
SELECT repo, coalesce(array_to_string(max_by(head, i) FILTER (WHERE kinds = 1 AND deep = al), '/'), '') AS root FROM n GROUP BY repo
"""
)
def common_root(spark, sf):
    """The common folder of each repository's files."""
    files = table(spark, sf, "files").where(F.col("path").isNotNull())
    return M.common_root(files.withColumn("repo", F.split("path", "/")[0]), by="repo")


@query(
    f"WITH {_ONE} SELECT id, CASE WHEN language = 'go' THEN CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN '+' ELSE '-' END WHEN language IN ('python', 'ruby') THEN CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN '-' ELSE '+' END WHEN language IN ('javascript', 'typescript', 'tsx') THEN CASE WHEN node_kind = 'export_statement' THEN '+' ELSE '-' END ELSE '' END AS mark, CASE WHEN start_line = end_line THEN ':' || start_line ELSE ':' || start_line || '-' || end_line END AS lines FROM c WHERE name IS NOT NULL"
)
def visibility_labels(spark, sf):
    c = plain(spark, sf).where(F.col("name").isNotNull())
    return c.select("id", X.visibility(F.col("language"), F.col("name"), F.col("node_kind")).alias("mark"), X.line_range(F.col("start_line"), F.col("end_line")).alias("lines"))


@query(f"WITH {_ONE}, p AS (SELECT DISTINCT file_path, name AS parent FROM c WHERE name IS NOT NULL AND parent IS NULL) SELECT c.id, CASE WHEN p.parent IS NULL THEN 0 ELSE 1 END AS level FROM c LEFT JOIN p ON c.file_path = p.file_path AND c.parent = p.parent WHERE c.name IS NOT NULL")
def parent_nesting(spark, sf):
    return M.nested(plain(spark, sf).where(F.col("name").isNotNull()))


@query(
    f"WITH {_ONE}, l AS (SELECT DISTINCT file_path, line FROM edges WHERE line IS NOT NULL), h AS (SELECT l.file_path, l.line, c.id, row_number() OVER (PARTITION BY l.file_path, l.line ORDER BY c.start_line DESC, c.id DESC) AS rn FROM l JOIN c ON c.file_path = l.file_path AND l.line BETWEEN c.start_line AND c.end_line)"
    " SELECT e.file_path, e.line, e.dst_name, h.id AS chunk_id FROM edges e LEFT JOIN (SELECT * FROM h WHERE rn = 1) h ON e.file_path = h.file_path AND e.line = h.line"
)
def edge_attribution(spark, sf):
    return G.attribute(table(spark, sf, "edges"), plain(spark, sf)).select("file_path", "line", "dst_name", "chunk_id")


_GRAPH = rf"""{_ONE}, s AS (SELECT * FROM c WHERE name IS NOT NULL),
here AS (SELECT name, file_path, min((file_path, start_line, id)) AS p FROM s GROUP BY name, file_path),
fst AS (SELECT name, min((file_path, start_line, id)) AS p FROM s GROUP BY name),
qm AS (SELECT file_path, q, regexp_replace(regexp_replace(arg_min(module, (way, line, module)), '/+$', ''), '^[./]+|[./]+$', '', 'g') AS m FROM (
  SELECT file_path, alias AS q, module, line, 0 AS way FROM imports WHERE coalesce(alias, '') <> '' AND module IS NOT NULL UNION ALL
  SELECT file_path, regexp_extract(regexp_replace(module, '/+$', ''), '([^/]*)$', 1), module, line, 1 FROM imports WHERE module IS NOT NULL) t WHERE q <> '' GROUP BY file_path, q),
pk AS (SELECT *, {_PKG} AS pkg FROM s)"""
_RES = """
e AS (SELECT DISTINCT file_path, dst_name, coalesce(dst_qualifier, '') AS q FROM edges),
im AS (SELECT e.file_path, e.dst_name, e.q, min((pk.file_path, pk.start_line, pk.id)) AS p FROM e JOIN qm ON qm.file_path = e.file_path AND qm.q = e.q AND e.q <> ''
  JOIN pk ON pk.name = e.dst_name AND (pk.pkg = qm.m OR (qm.m <> '' AND ends_with(pk.pkg, '/' || qm.m))) GROUP BY ALL),
res AS (SELECT e.file_path, e.dst_name, e.q, coalesce(here.p, im.p, fst.p) AS p FROM e LEFT JOIN here ON here.name = e.dst_name AND here.file_path = e.file_path
  LEFT JOIN im ON im.file_path = e.file_path AND im.dst_name = e.dst_name AND im.q = e.q LEFT JOIN fst ON fst.name = e.dst_name)"""


@query(f"WITH {_GRAPH}, {_RES} SELECT file_path, dst_name, q AS dst_qualifier, p[3] AS target FROM res")
def resolve_ranked(spark, sf):
    refs = table(spark, sf, "edges").select("file_path", "dst_name", F.coalesce("dst_qualifier", F.lit("")).alias("dst_qualifier")).distinct()
    return G.resolve(refs, G.symbols(plain(spark, sf)), table(spark, sf, "imports")).select("file_path", "dst_name", "dst_qualifier", F.col("target.id").alias("target"))


_CALLEES = """d AS (SELECT DISTINCT src_id, dst_name, coalesce(dst_qualifier, '') AS q, kind, file_path, line FROM edges WHERE coalesce(src_id, '') <> ''),
ce AS (SELECT d.src_id, d.dst_name AS name, d.q AS qualifier, d.kind, res.p IS NOT NULL AS resolved, coalesce(res.p[1], '') AS file_path, coalesce(t.node_kind, '') AS node_kind, coalesce(t.parent, '') AS parent, coalesce(res.p[2], 0) AS start_line, coalesce(t.end_line, 0) AS end_line, d.line, d.file_path AS ref_file
  FROM d JOIN res ON res.file_path = d.file_path AND res.dst_name = d.dst_name AND res.q = d.q LEFT JOIN c t ON t.id = res.p[3] WHERE res.p IS NOT NULL OR d.kind <> 'reference')"""


@query(f"WITH {_GRAPH}, {_RES}, {_CALLEES} SELECT * FROM ce")
def callees(spark, sf):
    return G.callees(table(spark, sf, "edges"), plain(spark, sf), table(spark, sf, "imports"))


_CALLS = """cl AS (SELECT e.dst_name AS target, coalesce(nullif(e.src_name, ''), c.name) AS name, e.file_path AS ref_file, e.line, coalesce(e.dst_qualifier, '') AS qualifier, e.kind, c.id AS cid, c.file_path AS cf, c.start_line AS cs, c.end_line AS ce, c.node_kind AS ck, c.parent AS cp FROM edges e LEFT JOIN c ON c.id = e.src_id WHERE e.dst_name IS NOT NULL),
dd AS (SELECT cl.*, coalesce(here.p, fst.p) AS p FROM cl LEFT JOIN here ON here.name = cl.name AND here.file_path = cl.ref_file LEFT JOIN fst ON fst.name = cl.name WHERE coalesce(cl.name, '') <> ''),
rf AS (SELECT dd.target, dd.name, CASE WHEN p IS NOT NULL THEN p[1] WHEN cid IS NOT NULL THEN cf ELSE ref_file END AS file_path, ref_file, dd.line, CASE WHEN p IS NOT NULL THEN p[2] WHEN cid IS NOT NULL THEN cs ELSE dd.line END AS start_line, dd.qualifier, dd.kind,
  coalesce(CASE WHEN p IS NOT NULL THEN t.node_kind WHEN cid IS NOT NULL THEN ck END, '') AS node_kind, coalesce(CASE WHEN p IS NOT NULL THEN t.parent WHEN cid IS NOT NULL THEN cp END, '') AS parent, CASE WHEN p IS NOT NULL THEN t.end_line WHEN cid IS NOT NULL THEN ce ELSE 0 END AS end_line FROM dd LEFT JOIN c t ON t.id = p[3])"""
_CALLER = "ref_file, line, start_line, qualifier, kind, node_kind, parent, end_line"


@query(f"WITH {_GRAPH}, {_CALLS} SELECT target, name, file_path, {_CALLER} FROM (SELECT *, row_number() OVER (PARTITION BY target, name, file_path ORDER BY {_CALLER}) AS rn FROM rf) t WHERE rn = 1")
def callers(spark, sf):
    return G.callers(table(spark, sf, "edges"), plain(spark, sf))


def _level(n: int) -> str:
    """SQL of the names found at level n of the breadth-first search, with their place in its order."""
    seen = " UNION ALL ".join(f"SELECT name FROM l{i}" for i in range(n))
    return f"""l{n} AS (SELECT *, row_number() OVER (ORDER BY o, ref_file, line, name) AS ord FROM (SELECT f.ord AS o, k.*, row_number() OVER (PARTITION BY k.name ORDER BY f.ord, k.ref_file, k.line, k.file_path, k.start_line, k.qualifier, k.kind, k.node_kind, k.parent, k.end_line) AS rn
FROM lk k JOIN l{n - 1} f ON f.name = k.target WHERE k.name NOT IN ({seen})) t WHERE rn = 1)"""


@query(
    f"WITH {_GRAPH}, {_CALLS}, lk AS (SELECT target, name, file_path, {_CALLER} FROM (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY ref_file, line, file_path, start_line, qualifier, kind, node_kind, parent, end_line) AS rn FROM rf) t WHERE rn = 1),"
    f" l0 AS (SELECT dst_name AS name, 1 AS ord FROM edges WHERE dst_name IS NOT NULL GROUP BY dst_name ORDER BY count(*) DESC, dst_name LIMIT 1), {_level(1)}, {_level(2)}, {_level(3)}"
    + " UNION ALL ".join(f" SELECT name, {i} AS depth, file_path, {_CALLER} FROM l{i}" for i in (1, 2, 3))
)
def impact_depth(spark, sf):
    """Definitions within three levels of the name most referred to, each by its first discovery."""
    edges = table(spark, sf, "edges")
    top = edges.where(F.col("dst_name").isNotNull()).groupBy("dst_name").count().orderBy(F.desc("count"), "dst_name").first()
    return G.impact(edges, plain(spark, sf), top["dst_name"] if top else "", 3)


@query("SELECT count(*) = 0 AS not_built FROM edges")
def graph_not_built(spark, sf):
    return table(spark, sf, "edges").agg((F.count("*") == 0).alias("not_built"))


@query(
    f"WITH {_GRAPH}, {_RES}, {_CALLEES} SELECT src_id, '  ' || CASE WHEN resolved THEN file_path || ':' || start_line || ' ' || CASE WHEN parent <> '' THEN parent || '.' ELSE '' END || name ELSE ref_file || ':' || line || ' ' || CASE WHEN qualifier <> '' THEN qualifier || '.' ELSE '' END || name || ' (external)' END || CASE WHEN kind IN ('', 'call') THEN '' ELSE ' (' || kind || ')' END AS line_text FROM ce"
)
def ref_format(spark, sf):
    return G.formatted(G.callees(table(spark, sf, "edges"), plain(spark, sf), table(spark, sf, "imports"))).select("src_id", "line_text")


_CUR = "cur AS (SELECT path, r[1] AS indexed_at, r[2] AS content_hash, r[3] AS mtime, r[4] AS size FROM (SELECT path, max((indexed_at, content_hash, mtime, size)) AS r FROM files WHERE path IS NOT NULL GROUP BY path) t)"
#: What is known of each path: its newest observation that is a removal or could be read.
_SEEN = "sn AS (SELECT path, op, lower(content_hash) AS content_hash, mtime, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, scan_id DESC) AS rn FROM file_scans WHERE path IS NOT NULL AND seen_at IS NOT NULL AND (op = 'remove' OR (op IS NOT NULL AND content_hash IS NOT NULL AND mtime IS NOT NULL AND size IS NOT NULL))) t WHERE rn = 1)"
_DISK = f"{_SEEN}, disk AS (SELECT path, content_hash, mtime, size FROM sn WHERE op <> 'remove')"


def seen(spark, sf) -> DataFrame:
    """Of each path the newest observation that is a removal or could be read."""
    rows = table(spark, sf, "file_scans").where("path IS NOT NULL AND seen_at IS NOT NULL AND (op = 'remove' OR (op IS NOT NULL AND content_hash IS NOT NULL AND mtime IS NOT NULL AND size IS NOT NULL))")
    got = rows.groupBy("path").agg(F.max_by(F.struct("op", "content_hash", "mtime", "size"), F.struct("seen_at", "scan_id")).alias("r"))
    return got.select("path", "r.op", F.lower("r.content_hash").alias("content_hash"), "r.mtime", "r.size")


def disk(spark, sf) -> DataFrame:
    """The files that are there: path, content_hash, mtime, size of those not seen removed last."""
    return seen(spark, sf).where("op <> 'remove'").drop("op")


@query(f"WITH {_CUR}, {_DISK} SELECT path, CASE WHEN cur.path IS NULL THEN 'create' WHEN disk.path IS NULL THEN 'remove' ELSE 'write' END AS op FROM cur FULL JOIN disk USING (path) WHERE cur.path IS NULL OR disk.path IS NULL OR disk.mtime > cur.mtime")
def snapshot_diff(spark, sf):
    return I.snapshot_diff(I.current_files(table(spark, sf, "files")), disk(spark, sf))


@query(f"WITH {_CUR}, {_DISK} SELECT cur.path, CASE WHEN disk.path IS NULL THEN true WHEN disk.mtime = cur.mtime AND disk.size = cur.size THEN false WHEN disk.size > 1048576 THEN false ELSE disk.content_hash IS DISTINCT FROM cur.content_hash END AS stale FROM cur LEFT JOIN disk USING (path)")
def stale_files(spark, sf):
    cur = I.current_files(table(spark, sf, "files"))
    return I.stale(cur, cur, disk(spark, sf))


@query(f"WITH {_CUR}, {_SEEN} SELECT path FROM cur WHERE path IN (SELECT path FROM sn WHERE op = 'remove') OR path NOT IN (SELECT path FROM sn)")
def deleted_files(spark, sf):
    return I.deleted(I.current_files(table(spark, sf, "files")), disk(spark, sf)).select("path")


@query(f"WITH {_CUR}, {_DISK} SELECT disk.path, disk.content_hash FROM disk LEFT JOIN cur USING (path) WHERE disk.content_hash IS DISTINCT FROM cur.content_hash")
def changed_files(spark, sf):
    return I.changed(I.current_files(table(spark, sf, "files")), disk(spark, sf)).select("path", "content_hash")


_BAD = "bad AS (SELECT file_path FROM chunks WHERE embedding IS NULL OR len(embedding) <> 64)"


@query(f"WITH {_BAD} SELECT id, file_path, true AS kept, 0 AS failures FROM chunks WHERE file_path NOT IN (SELECT file_path FROM bad) UNION ALL SELECT '', file_path, false, count(*) FROM bad GROUP BY file_path")
def failure_isolation(spark, sf):
    """The chunks that go on, and the files that are kept out with their number of failures."""
    rows = table(spark, sf, "chunks").select("id", "file_path", (F.col("embedding").isNull() | (F.size("embedding") != 64)).alias("failed"))
    good, bad = I.isolate_failures(rows, "failed")
    return good.select("id", "file_path", F.lit(True).alias("kept"), F.lit(0).alias("failures")).unionByName(bad.select(F.lit("").alias("id"), "file_path", F.lit(False).alias("kept"), "failures"))


@query(
    f"""WITH {_CUR}, {_SEEN}, t AS (SELECT 'files' AS what, path AS file_path, content_hash AS value FROM cur UNION ALL SELECT 'chunks', file_path, id FROM chunks UNION ALL SELECT 'edges', file_path, dst_name FROM edges UNION ALL SELECT 'imports', file_path, module FROM imports)
SELECT what, file_path, value, count(*) AS n FROM (SELECT * FROM t WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM sn) UNION ALL SELECT 'files', path, content_hash FROM sn WHERE op <> 'remove'
UNION ALL SELECT what, file_path, value FROM t WHERE what <> 'files' AND file_path IN (SELECT path FROM sn WHERE op <> 'remove') AND file_path NOT IN (SELECT sn.path FROM sn LEFT JOIN cur USING (path) WHERE sn.content_hash IS DISTINCT FROM cur.content_hash)) u GROUP BY ALL"""
)
def replace_by_files(spark, sf):
    """All tables after the files seen took the place of the stored ones: what is removed is gone,
    what changed has no chunks, edges and imports any more, what is unchanged keeps its own."""
    cur, now = I.current_files(table(spark, sf, "files")), seen(spark, sf)
    stored = {"files": cur.select("path", "content_hash"), "chunks": table(spark, sf, "chunks").select("file_path", "id"), "edges": table(spark, sf, "edges").select("file_path", "dst_name"), "imports": table(spark, sf, "imports").select("file_path", "module")}
    there = now.where("op <> 'remove'").select("path", "content_hash")
    same = there.join(I.changed(cur, there).select("path"), "path", "left_anti").select(F.col("path").alias("file_path"))
    new = {"files": there} | {n: stored[n].join(same, "file_path", "left_semi") for n in ("chunks", "edges", "imports")}
    out = I.replace_by_files(stored, new, gone=now.select("path"))
    parts = [df.select(F.lit(n).alias("what"), F.col(df.columns[0]).alias("file_path"), F.col(df.columns[1]).alias("value")) for n, df in out.items()]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("what", "file_path", "value").agg(F.count("*").alias("n"))


_SESSION = """WITH e AS (SELECT user_id AS path, event_type AS op, ts FROM events WHERE ts IS NOT NULL), b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM b)"""


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), "ts")


@query(f"{_SESSION} SELECT path, min(ts) AS start, count(*) AS events, max((ts, op))[2] AS last_op FROM s GROUP BY path, n")
def debounce_sessions(spark, sf):
    return E.coalesced(_events(spark, sf), "6 hours").select("path", "start", "events", "last_op")


@query(f"{_SESSION} SELECT path, min(ts) AS start, bool_or(op = 'error') AS reindex FROM s GROUP BY path, n")
def overflow_reindex(spark, sf):
    rows = _events(spark, sf).withColumn("op", F.when(F.col("op") == "error", "reindex").otherwise(F.col("op")))
    return E.coalesced(rows, "6 hours").select("path", "start", "reindex")


@query(
    """WITH b AS (SELECT doc_id, least(512, 8 * pow(2, greatest(0, ceil(log2((1 + octet_length(encode(text)) // 4) / 8.0)))))::INT AS bucket, doc_id % 64 AS part FROM documents WHERE text IS NOT NULL)
SELECT doc_id, bucket, part || '-' || (row_number() OVER (PARTITION BY bucket, part ORDER BY doc_id) - 1) // 32 AS batch FROM b"""
)
def bucketize(spark, sf):
    """Every document in a batch of at most 32 of its padded length."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", (X.token_estimate(F.col("text")) + 1).alias("tokens"))
    return I.bucketize(rows, "tokens", "doc_id", spread=F.pmod("doc_id", F.lit(64)))


#: Rules of the root and of folders, and the same as (folder, number, pattern, negated, folders only) for SQL.
_LAYERS = {"fernhollow": ["!*.min.js", "src/", "*_test.go"], "fernhollow/src": ["!model"], "quarrystone/lib": ["*", "!query/", "!*.py"]}
_RULES = r"""(VALUES ('.', 0, '^(.*/)?[^/]*\.min\.js$', false, false), ('.', 1, '^(.*/)?vendor$', false, true), ('.', 2, '^larkspur-ui/api$', false, false), ('.', 3, '^(.*/)?build_[^/]*$', false, false), ('.', 4, '^(.*/)?build_info$', true, false),
('.', 5, '^(.*/)?node_modules$', false, true), ('.', 6, '^gen/.*$', false, false), ('.', 8, '^report/[^a-k][^/]*\.json$', false, false),
('fernhollow', 0, '^(.*/)?[^/]*\.min\.js$', true, false), ('fernhollow', 1, '^(.*/)?src$', false, true), ('fernhollow', 2, '^(.*/)?[^/]*_test\.go$', false, false), ('fernhollow/src', 0, '^(.*/)?model$', true, false),
('quarrystone/lib', 0, '^(.*/)?[^/]*$', false, false), ('quarrystone/lib', 1, '^(.*/)?query$', true, true), ('quarrystone/lib', 2, '^(.*/)?[^/]*\.py$', true, false)) AS r(dir, no, rx, neg, fo)"""


@query(
    rf"""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS x FROM files), s AS (SELECT path, array_to_string(x[:i], '/') AS pre, i < len(x) AS folder FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM p)),
st AS (SELECT s.path, pre, folder, arg_max(neg, (CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END, no)) AS neg FROM s JOIN {_RULES} ON (dir = '.' OR starts_with(pre, dir || '/')) AND (folder OR NOT fo) AND regexp_matches(CASE WHEN dir = '.' THEN pre ELSE substr(pre, len(dir) + 2) END, rx) GROUP BY ALL)
SELECT path FROM p WHERE path NOT IN (SELECT path FROM st WHERE NOT neg) AND NOT regexp_matches(path, '\.yaml$') AND regexp_matches(lower(path), '\.(py|go|js|ts|c|json)$')"""
)
def ignore_rules(spark, sf):
    """Paths that the ignore files of their folders and of the root, globs and extensions let through."""
    paths = table(spark, sf, "files").select("path").distinct()
    files = spark.createDataFrame([(f"{d}/.gitignore", "\n".join(lines)) for d, lines in _LAYERS.items()] + [(".gitignore", "\n".join(IGNORES))], "path string, content string")
    return I.candidates(paths, [], exclude=["*.yaml"], extensions=[".py", ".go", ".js", ".ts", ".c", ".json"], below=I.ignore_rules(files))


@query("SELECT DISTINCT e.file_path FROM edges e WHERE e.dst_name IS NOT NULL")
def edge_files(spark, sf):
    return table(spark, sf, "edges").where("dst_name IS NOT NULL").select("file_path").distinct()


@query("SELECT id FROM (SELECT DISTINCT id FROM chunks) c WHERE id NOT IN (SELECT src_id FROM edges WHERE src_id IS NOT NULL)")
def delete_by_ids(spark, sf):
    ids = table(spark, sf, "edges").select(F.col("src_id").alias("id")).where("id IS NOT NULL").distinct()
    return I.delete(table(spark, sf, "chunks").select("id").distinct(), ids)


@query(f"WITH {_CUR}, n AS (SELECT path, max((scan_id, content_hash))[2] AS content_hash FROM file_scans WHERE content_hash IS NOT NULL AND path IS NOT NULL GROUP BY path) SELECT path, content_hash FROM n UNION ALL SELECT path, content_hash FROM cur WHERE path NOT IN (SELECT path FROM n)")
def upsert_files(spark, sf):
    new = table(spark, sf, "file_scans").where("content_hash IS NOT NULL AND path IS NOT NULL").select("path", "content_hash", "scan_id")
    cur = I.current_files(table(spark, sf, "files")).select("path", "content_hash")
    return I.upsert(cur, new, "path", "scan_id").select("path", "content_hash")


# ---------------------------------------------------------------- scalars, look-ups and filters


@query("SELECT DISTINCT path, '…' || right(path, 23) AS tail, sha1(trim(path, '/')) AS project, regexp_extract(lower(path), '(\\.[^./]*)$', 1) AS ext FROM files WHERE path IS NOT NULL AND length(path) > 24 UNION SELECT DISTINCT path, path, sha1(trim(path, '/')), regexp_extract(lower(path), '(\\.[^./]*)$', 1) FROM files WHERE length(path) <= 24")
def path_labels(spark, sf):
    """Paths as they are shown in 24 signs, their hash as a project's folder, and their extension."""
    p = F.col("path")
    return table(spark, sf, "files").where(p.isNotNull()).select("path", X.path_tail(p, 24).alias("tail"), X.project_hash(p).alias("project"), X.extension(p).alias("ext")).distinct()


@query("SELECT DISTINCT doc_id, n_chars, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824.0) ELSE printf('%.1f TiB', b / 1099511627776.0) END AS size FROM (SELECT doc_id, n_chars, n_chars::BIGINT * n_chars * 7 AS b FROM documents WHERE n_chars IS NOT NULL) t")
def byte_labels(spark, sf):
    """Numbers of bytes as they are shown; the square of a text's length, so that all units occur."""
    rows = table(spark, sf, "documents").where("n_chars IS NOT NULL")
    return rows.select("doc_id", "n_chars", X.human_bytes(F.col("n_chars") * F.col("n_chars") * 7).alias("size")).distinct()


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), ww AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_BLANK}')) AS w, generate_subscripts(regexp_split_to_array(text, '{_BLANK}'), 1) AS i FROM d),
dw AS (SELECT DISTINCT w FROM ww WHERE w <> ''), {_TOKENS} SELECT d.doc_id, array_to_string(coalesce(any_value(t.tokens), [])[:32], ' ') AS tokens FROM d LEFT JOIN (SELECT doc_id, flatten(list(toks ORDER BY i)) AS tokens FROM ww JOIN wt USING (w) GROUP BY doc_id) t USING (doc_id) GROUP BY d.doc_id"""
)
def truncated_tokens(spark, sf):
    """What an embedder that takes 32 tokens gets of every text."""
    return _tokens(spark, sf).select("doc_id", F.array_join(X.truncated(F.col("tokens"), 32), " ").alias("tokens"))


@query(
    f"WITH dw AS (SELECT DISTINCT name AS w FROM chunks WHERE name <> '' AND NOT regexp_matches(name, '\\s')), {_TOKENS} SELECT w AS name, array_to_string(list_filter(list_transform(toks, lambda t: array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> ''), ' ')), lambda z: z <> ''), '|') AS phrases FROM wt"
)
def query_phrases(spark, sf):
    """The phrases a search for each name asks for."""

    def run(batches):
        for batch in batches:
            got = ["|".join(" ".join(p) for p in phrases_of(n)) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["name", "phrases"])

    return table(spark, sf, "chunks").select("name").where("name <> ''").where(~F.col("name").rlike("\\s")).distinct().mapInArrow(run, "name string, phrases string")


@query(f"WITH {_ONE} SELECT id, file_path, language, name, node_kind, start_line, end_line FROM c WHERE language IN ('go', 'python') AND node_kind IN ('function_declaration', 'function_definition') AND (regexp_matches(file_path, '^[^/]*/core/[^/]*$') OR file_path LIKE 'fernhollow/%')")
def search_filters(spark, sf):
    """What the filters of a query let through: attributes, and paths or package; without contents."""
    q = S.Query("x", languages=("go", "python"), node_kinds=("function_declaration", "function_definition"), paths=("*/core/*",), package="fernhollow/").checked()
    rows = plain(spark, sf).where(q.attributes() & matches_any(F.col("file_path"), q.globs()))
    return rows.select("id", "file_path", "language", "name", "node_kind", "start_line", "end_line")


@query(f"WITH {_ONE}, top AS (SELECT name FROM c WHERE name IS NOT NULL AND id IN (SELECT src_id FROM edges) GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), e AS (SELECT * FROM edges WHERE src_id IN (SELECT id FROM c WHERE name = (SELECT name FROM top))) SELECT 'edge' AS what, file_path, dst_name AS value, line FROM e UNION ALL SELECT 'import', file_path, module, line FROM imports WHERE file_path IN (SELECT file_path FROM e)")
def graph_lookups(spark, sf):
    """The edges of the most frequent name that has some, and the imports of their files."""
    c, edges = plain(spark, sf), table(spark, sf, "edges")
    top = c.where("name IS NOT NULL").join(edges.select(F.col("src_id").alias("id")).distinct(), "id", "left_semi").groupBy("name").count().orderBy(F.desc("count"), "name").first()
    mine = G.edges_of(edges, c, top["name"] if top else "")
    imports = G.imports_of(table(spark, sf, "imports"), mine)
    return mine.select(F.lit("edge").alias("what"), "file_path", F.col("dst_name").alias("value"), "line").unionByName(imports.select(F.lit("import").alias("what"), "file_path", F.col("module").alias("value"), "line"))


@query(
    f"WITH {_CUR}, {_SEEN}, gone AS (SELECT path FROM sn WHERE op = 'remove') SELECT what, file_path, count(*) AS n FROM (SELECT 'files' AS what, path AS file_path FROM cur UNION ALL SELECT 'chunks', file_path FROM chunks UNION ALL SELECT 'edges', file_path FROM edges UNION ALL SELECT 'imports', file_path FROM imports) t WHERE file_path NOT IN (SELECT path FROM gone) GROUP BY ALL"
)
def delete_by_file(spark, sf):
    """Rows of each table and file after the removed files are gone."""
    tables = {"files": I.current_files(table(spark, sf, "files")).select("path")} | {n: table(spark, sf, n).select("file_path") for n in ("chunks", "edges", "imports")}
    left = I.delete_by_file(tables, seen(spark, sf).where("op = 'remove'"))
    parts = [df.select(F.lit(n).alias("what"), F.col(df.columns[0]).alias("file_path")) for n, df in left.items()]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("what", "file_path").agg(F.count("*").alias("n"))


@query("SELECT path, CASE WHEN bool_or(op = 'remove') THEN 'remove' WHEN bool_or(op = 'create') THEN 'create' ELSE 'write' END AS op FROM file_scans WHERE path IS NOT NULL AND op IN ('create', 'write', 'remove') GROUP BY path")
def classified_events(spark, sf):
    """One event of all that was seen of a path."""
    bits = table(spark, sf, "file_scans").where("path IS NOT NULL").groupBy("path").agg(F.collect_set("op").alias("bits"))
    return E.classify(bits).select("path", "op")
