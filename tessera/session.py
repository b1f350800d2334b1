"""Session set-up shared by every query."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a checkout.

    The path is handed to the workers with each Python function; where the package is
    installed, or shipped with ``--py-files``, the extra entry does no harm.
    """
    sc = spark.sparkContext
    have = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, for checkpoints and working tables.

    It is ``spark.checkpoint.dir`` where the cluster names one. Only where that is unset, in a
    local session such as a test, a temporary folder of this machine serves.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_tessera_tmp", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc._tessera_tmp = where
    return where


def checkpointed(df):
    """``df.checkpoint()`` into the shared folder; survives the loss of an executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
