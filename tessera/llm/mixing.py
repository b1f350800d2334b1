"""Sources mixed to target weights (problem 9), by iterative proportional fitting.

Tokens are summed by cell (source, language, topic), where the topic of a document is the set of
all its areas; holding each set's share holds that of every area too. Raking scales the cells in turn to the
marginals by topic, language and source until they settle; the source step comes last and keeps
every cell below its cap of repeats, handing what is cut off to the source's other cells. A
cell's weight over its tokens is the number of times each of its documents is drawn: the whole
part for certain, the rest by systematic sampling in random order.

The corpus is read and tokenized once; areas and sizes are written to the shared folder, and cells,
draw and report go by that table.
"""

from __future__ import annotations

import math

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.areas import train
from tessera.llm.bpe import encoder_of, vocabulary
from tessera.llm.subject_models import Models, words
from tessera.session import checkpointed
from tessera.sources.tables import table

SEED, ROUNDS, STRATUM = 17, 60, 50_000

#: Other ways to write a language.
LANGUAGES = {"eng": "en", "english": "en", "ger": "de", "deu": "de", "german": "de", "spa": "es", "spanish": "es", "": "und", "unknown": "und"}


def source_name(c: Column) -> Column:
    """Sources without regard to case and blanks around."""
    return F.lower(F.trim(c))


def language_name(c: Column) -> Column:
    """A code of two letters, or ``und`` for what is neither one nor a known name of one."""
    plain = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^([a-z]*)", 1)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[plain], F.when(F.length(plain) == 2, plain), F.lit("und"))


@dataclass(frozen=True)
class Raked:
    """Copies of each document by cell, the shares aimed at by axis and value, rounds gone, and by what share
    of the mix the last round still moved a cell."""

    rate: dict[tuple, float]
    shares: list[dict]
    rounds: int
    moved: float


def rake(cells: dict[tuple, float], targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = ROUNDS) -> Raked:
    """Copies of each document by cell (source, then any number of further marginals).

    ``cells`` holds tokens, ``targets`` share and greatest repeats by source. Shares are scaled
    over the sources that have tokens. The further marginals are held at the eligible corpus's
    own shares as far as sources and caps allow. ``total`` is the size of the mix; by default,
    and at most, the greatest of which every source can fill its share.
    """
    cells = {c: n for c, n in cells.items() if n > 0 and c[0] in targets and targets[c[0]][0] > 0 and targets[c[0]][1] > 0}
    if not cells:
        return Raked({}, [], 0, 0.0)
    have: dict[str, float] = {}
    for c, n in cells.items():
        have[c[0]] = have.get(c[0], 0) + n
    whole = sum(targets[s][0] for s in have)
    want = {s: targets[s][0] / whole for s in have}
    most = min(targets[s][1] * have[s] / want[s] for s in have)
    total = most if total is None else min(total, most)
    corpus = sum(cells.values())
    marginals = []
    for axis in range(1, len(next(iter(cells)))):
        sums: dict = {}
        for c, n in cells.items():
            sums[c[axis]] = sums.get(c[axis], 0) + n
        marginals.append((axis, {k: n / corpus * total for k, n in sums.items()}))
    weight = {c: n * total / corpus for c, n in cells.items()}
    for turn in range(1, rounds + 1):  # noqa: B007
        before = dict(weight)
        for axis, target in reversed(marginals):
            sums = {}
            for c, n in weight.items():
                sums[c[axis]] = sums.get(c[axis], 0) + n
            weight = {c: n * target[c[axis]] / sums[c[axis]] if sums[c[axis]] else 0.0 for c, n in weight.items()}
        for s in have:
            own = [c for c in cells if c[0] == s]
            cap = {c: targets[s][1] * cells[c] for c in own}
            left, open_, goal = dict.fromkeys(own, 0.0), set(own), want[s] * total
            while open_ and goal > 0:  # what a capped cell cannot take goes to the others
                base = sum(weight[c] for c in open_)
                scale = goal / base if base > 0 else math.inf
                full = {c for c in open_ if weight[c] * scale >= cap[c] or base <= 0}
                if not full:
                    left.update({c: weight[c] * scale for c in open_})
                    break
                left.update({c: cap[c] for c in full})
                goal -= sum(cap[c] for c in full)
                open_ -= full
            weight.update(left)
        moved = max(abs(weight[c] - before[c]) for c in weight) / total
        if moved <= 1e-9:
            break
    shares = [want, *({k: n / total for k, n in target.items()} for _, target in marginals)]
    return Raked({c: weight[c] / cells[c] for c in cells}, shares, turn, moved)


def measured(documents: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, source, lang, tokens, topic (all areas, joined by ``+``, or ``none``) of documents with tokens
    and a source, in one pass over the texts, whole."""
    sc = documents.sparkSession.sparkContext
    shared, known = sc.broadcast(encoder_of(vocabulary(documents.sparkSession))), sc.broadcast(models)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, m = shared.value, known.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            sizes = [len(ids) for ids in encoder.encode(texts)]
            docs = [words(t) if t and m is not None else [] for t in texts]
            topics = ["+".join(sorted(m.accept(m.gains(d), len(d)))) or "none" if d else "none" for d in docs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(topics)], ["doc_id", "source", "lang", "tokens", "topic"])

    rows = documents.where(F.col("source").isNotNull() & (F.col("text") != "")).select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens int, topic string").where(F.col("tokens") > 0)


@dataclass(frozen=True)
class Mix:
    """``drawn``: doc_id, source, lang, topic, tokens, copies (1 or more, at most the source's cap)."""

    drawn: DataFrame
    raked: Raked
    targets: dict[str, tuple[float, int]]


def mix(documents: DataFrame, targets: DataFrame, models: Models | None = None, topics: DataFrame | None = None, total: float | None = None, seed: int = SEED) -> Mix:
    """Draw documents so that sources hold their target shares of tokens.

    Documents without tokens (null or empty text), without a source, or of a source without a
    target are not drawn; of a target given more than once the least cap and share hold. The
    same seed gives the same draw. Topics are those the models give or, without models, those of
    a table (doc_id, subject). Only sums by cell reach the driver: of the sources with a target, 677
    languages and the sets of subjects that occur (of ten subjects at most 1024, of which few do).

    Sampling runs within strata of about ``STRATUM`` documents by hash, so no source, however
    large, is one task's.
    """
    docs = measured(documents, models)
    if topics is not None:
        sets = topics.where(F.col("subject").isNotNull()).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), "+").alias("topic"))
        docs = docs.drop("topic").join(sets, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))
    docs = checkpointed(docs)
    goal = {
        r["source"]: (r["share"], r["repeats"])
        for r in targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.min("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()
        if r["source"] is not None and r["share"] is not None and r["repeats"] is not None
    }
    eligible = docs.where(F.col("source").isin(*goal)) if goal else docs.limit(0)
    rows = eligible.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()
    raked = rake({(r["source"], r["lang"], r["topic"]): float(r["n"]) for r in rows}, goal, total)
    spark = documents.sparkSession
    rates = spark.createDataFrame([(*c, float(w), goal[c[0]][1]) for c, w in raked.rate.items()], "source string, lang string, topic string, rate double, cap int")
    strata = max(1, round(sum(r["docs"] for r in rows) / STRATUM))
    chance = F.xxhash64("doc_id", F.lit(seed))
    cell = ["source", "lang", "topic", "stratum"]
    order = W.partitionBy(*cell).orderBy("chance", "doc_id")
    drawn = (
        eligible.join(F.broadcast(rates), ["source", "lang", "topic"])
        .withColumn("chance", chance)
        .withColumn("stratum", F.pmod(F.shiftright("chance", 20), F.lit(strata)).cast("int"))
        .withColumn("place", F.row_number().over(order))
    )
    # systematic: the whole numbers that rate * place + offset steps over
    offset = F.pmod(F.xxhash64(*cell, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    upto = lambda place: F.floor(F.col("rate") * place + offset + 1e-9)
    copies = F.least(upto(F.col("place")) - upto(F.col("place") - 1), F.col("cap")).cast("int")
    drawn = drawn.select("doc_id", "source", "lang", "topic", "tokens", copies.alias("copies")).where(F.col("copies") > 0)
    return Mix(drawn, raked, goal)


REPORT = "axis string, value string, target_share double, aimed_share double, reached_share double, tokens long, documents long, copies long, rounds int, moved double"


def report(mixed: Mix) -> DataFrame:
    """Shares of the mix by source, language and topic: axis, value, target_share (as asked for, of sources alone),
    aimed_share (with targets that have no documents left out; for languages and topics the
    corpus's own), reached_share, tokens, documents, copies, and of the raking rounds and moved (see ``Raked``).

    Sources with a target of which nothing was drawn have zeros. The draw is run once; what reaches the
    driver is one row for each cell, as for the raking.
    """
    n = F.sum(F.col("tokens").cast("bigint") * F.col("copies"))
    cells = mixed.drawn.groupBy("source", "lang", "topic").agg(n.alias("n"), F.count("*").alias("docs"), F.sum("copies").alias("copies")).collect()
    total = sum(r["n"] for r in cells) or 1
    rows = []
    for at, axis in enumerate(("source", "lang", "topic")):
        aimed = mixed.raked.shares[at] if mixed.raked.shares else {}
        sums: dict = {v: [0, 0, 0] for v in ([*mixed.targets] if axis == "source" else aimed)}
        for r in cells:
            for i, x in enumerate((r["n"], r["docs"], r["copies"])):
                sums[r[axis]][i] += x
        for value, (tokens, docs, copies) in sorted(sums.items()):
            asked = mixed.targets[value][0] if axis == "source" else None
            rows.append((axis, value, asked, float(aimed.get(value, 0.0)), tokens / total, tokens, docs, copies, mixed.raked.rounds, float(mixed.raked.moved)))
    return mixed.drawn.sparkSession.createDataFrame(rows, REPORT)


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    documents = table(spark, sf_dir, "documents")
    models = train(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))
    return mix(documents, table(spark, sf_dir, "mix_targets"), models)


def p9_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is in it."""
    return _mix(spark, sf_dir).drawn.select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, aimed and reached shares of the mix by source, language and topic."""
    return report(_mix(spark, sf_dir))


QUERIES = {"p9_draw": p9_draw, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
