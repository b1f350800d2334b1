"""Queries of change capture (problem 5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes as C
from tessera.session import shared_dir
from tessera.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths the next run must process, with the hash seen last.

    The log is consumed in two batches of a new consumer: what had arrived before the last
    successful run of ``index_runs`` began, and the rest, late rows included. Each batch is
    planned, written to the sink in the shared folder and committed; the result is the sink. Runs
    that failed or still run commit nothing and so don't move the bound; what they wrote is in ``files``.
    """
    log, files, cols = table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "files"), C.LogColumns()
    capture = C.ChangeCapture(spark, f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}", cols)
    begun = table(spark, sf_dir, "index_runs").where(F.lower("status") == "ok").agg(F.max("started_at").alias("t")).first()["t"]
    if begun is not None:
        late = log.where(F.col("arrived_at").isNull() | (F.col("arrived_at") > F.lit(begun)))
        first = late.agg(F.min(cols.offset).alias("o")).first()["o"]
        capture.run(log if first is None else log.where(F.col(cols.offset) < first), files)
    capture.run(log, files)
    return capture.sink().select(F.col("key").alias("path"), F.col("value").alias("content_hash"))


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
WITH seen AS (
  SELECT path, op, lower(content_hash) AS content_hash,
         row_number() OVER (PARTITION BY path ORDER BY seen_at DESC NULLS LAST, scan_id DESC) AS rn
  FROM file_scans
  WHERE path IS NOT NULL AND scan_id IS NOT NULL AND (op = 'remove' OR coalesce(content_hash, '') <> '')
), cur AS (
  SELECT path, lower(content_hash) AS stored,
         row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) AS rn
  FROM files WHERE path IS NOT NULL
)
SELECT s.path, s.content_hash
FROM seen s LEFT JOIN (SELECT * FROM cur WHERE rn = 1) c ON s.path = c.path
WHERE s.rn = 1 AND coalesce(s.op, '') <> 'remove' AND (c.path IS NULL OR s.content_hash IS DISTINCT FROM c.stored)
""",
}
