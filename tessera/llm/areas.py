"""Subject areas of documents (problem 10).

One interpolated n-gram model per subject is trained on labelled documents, and one background
model on all documents. The cross-entropy of each word under every subject's model is compared with
that under the background's, and what the best subject saves counts for it; subjects with a calibrated share of all
a document's savings, which must be enough for its length, are accepted, so a document can have
several or none.

Labels are partly wrong: models are fitted on each half of the labelled documents, decide the
other half, and are fitted again on what they decided. The bounds of acceptance are chosen on
the half a model has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.subject_models import Models, counts, words
from tessera.sources.tables import table

#: At most so many labelled documents are fitted on, those of the least hash; some 15 MB of text.
LABELLED = 20_000


def _sample(documents: DataFrame, labels: DataFrame, limit: int) -> list[tuple[list[str], set[str]]]:
    named = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    order = F.xxhash64("doc_id")
    chosen = named.orderBy(order, "doc_id").limit(limit)
    rows = chosen.join(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id").orderBy(order, "doc_id", "text").collect()
    return [(words(r["text"]), set(r["subjects"])) for r in rows]


def _background(documents: DataFrame, vocabulary: set) -> tuple[Counter, int]:
    """Counts over all documents of the words and pairs in the vocabulary, and of all words."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.__contains__
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                doc = words(text or "")
                total += len(doc)
                seen.update(filter(known, doc))
                seen.update(filter(known, zip(doc, doc[1:])))
        keys = ["", *(k if isinstance(k, str) else " ".join(k) for k in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([total, *seen.values()], pa.int64())], ["k", "n"])

    rows = documents.select("text").mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out: Counter = Counter()
    for r in rows:
        a, _, b = r["k"].partition(" ")
        out[(a, b) if b else a] = r["n"]
    return out, out.pop("", 0)


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = LABELLED) -> Models | None:
    """Models of all subjects in the table, or None without labelled documents.

    The model is bounded by the labelled sample, whatever the number of documents: only words
    and pairs seen twice in it are kept.
    """
    described = sorted((r["subject"], r["description"] or "") for r in subjects.select("subject", "description").distinct().collect() if r["subject"])
    names = [s for s, _ in described]
    sample = [(d, t & set(names)) for d, t in _sample(documents, labels, limit)]
    sample = [x for x in sample if x[0] and x[1]]
    if not names or not sample:
        return None
    docs, truth = [d for d, _ in sample], [t for _, t in sample]
    seen = counts(docs)
    background, total = _background(documents, {k for k, n in seen.items() if n >= 2})

    def fit(which: list[int], said: list[set[str]]) -> Models:
        per = [counts([docs[i] for i in which if s in said[i]] + ([words(described[k][1])] * 2)) for k, s in enumerate(names)]
        return Models.fit(names, per, background, total)

    halves = [list(range(0, len(docs), 2)), list(range(1, len(docs), 2))]
    decided = list(truth)
    for mine, other in (halves, halves[::-1]):
        model = fit(mine, truth)
        model.calibrate([docs[i] for i in other], [truth[i] for i in other])
        for i in other:
            decided[i] = set(model.accept(model.gains(docs[i]), len(docs[i]))) or truth[i]
    half = fit(halves[0], decided)
    half.calibrate([docs[i] for i in halves[1]], [truth[i] for i in halves[1]])
    final = fit(list(range(len(docs))), decided)
    final.share, final.density = half.share, half.density
    return final


def areas(documents: DataFrame, models: Models | None) -> DataFrame:
    """Rows (doc_id, subject), distinct: the subjects accepted for each document.

    Null, empty and blank texts have none, and neither has any document where there is no model.
    Texts are read whole; nothing is shuffled but the result.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string"
    spark = documents.sparkSession
    if models is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at, got = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    doc = words(text)
                    for s in m.accept(m.gains(doc), len(doc)):
                        at.append(i)
                        got.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(got, pa.string())], ["doc_id", "subject"])

    return documents.select("doc_id", "text").mapInArrow(run, schema).distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document."""
    documents = table(spark, sf_dir, "documents")
    return areas(documents, train(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects")))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of the corpus by subject area."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("chars"))
    return p10_found(spark, sf_dir).join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
SQL: dict[str, str] = {}
