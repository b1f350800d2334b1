"""Change capture from an append-only log, exactly once over failures.

The log is a table with a key, an increasing offset and the columns of an observation. It is
read as ``partitions`` logical partitions by key hash, each with its own offset. A batch goes
through three steps:

1. its *plan* - from which offset to which, per partition - is written ahead and never changed,
2. the slice of the log between those offsets is compacted to the newest observation of each
   key, earlier batches included, and compared with the stored state; the verdict on each key of
   the slice is kept, and what differs is written to the sink,
3. a *commit* marks the plan as done.

A run that finds a plan without commit replays exactly that plan, so no row is skipped; its
folders are replaced and the sink is read by the last verdict on each key, so none is repeated.
Over an unchanged state the sink is the same however the log was cut into batches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = 64


@dataclass(frozen=True)
class LogColumns:
    key: str = "path"
    offset: str = "scan_id"
    time: str = "seen_at"
    value: str = "content_hash"
    op: str = "op"
    removed: str = "remove"


def log_partition(key: str, partitions: int = PARTITIONS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")


def end_offsets(log: DataFrame, cols: LogColumns, partitions: int = PARTITIONS) -> dict[int, int]:
    """Greatest offset of each log partition; at most ``partitions`` rows reach the driver."""
    rows = (
        log.where(F.col(cols.key).isNotNull() & F.col(cols.offset).isNotNull())
        .groupBy(log_partition(cols.key, partitions).alias("p"))
        .agg(F.max(cols.offset).alias("o"))
        .collect()
    )
    return {r["p"]: r["o"] for r in rows}


def log_slice(log: DataFrame, cols: LogColumns, start: dict[int, int], end: dict[int, int], partitions: int = PARTITIONS) -> DataFrame:
    """Rows with an offset in (start, end] of their partition.

    The bounds are a literal map of at most ``partitions`` entries, so no join is needed and the
    least and greatest offset of all partitions reach the scan as a plain range.
    """
    if not end:
        return log.limit(0)
    part = log_partition(cols.key, partitions)

    def bound(of: dict[int, int], default: int) -> Column:
        flat = [F.lit(x).cast("bigint") for p in range(partitions) for x in (p, of.get(p, default))]
        return F.create_map(*flat)[part.cast("bigint")]

    low = min([start.get(p, -(2**63)) for p in end])
    return log.where(
        F.col(cols.key).isNotNull()
        & (F.col(cols.offset) <= F.lit(max(end.values())))
        & (F.col(cols.offset) >= F.lit(low))
        & ((F.col(cols.offset) > bound(start, -(2**63))) | (F.lit(not start)))
        & (F.col(cols.offset) <= bound(end, -(2**63)))
    )


def newest(log: DataFrame, cols: LogColumns) -> DataFrame:
    """The newest observation of each key: columns key, value (lower case), op, offset, time.

    Rows without a value say nothing unless they are removals and are left out. Equal times go
    to the greater offset; a missing time is older than any; rows without a key are left out. The aggregate combines on the map
    side, so a key holding a third of the log costs each task one row.
    """
    value = F.lower(F.col(cols.value))
    kept = log.where(F.col(cols.key).isNotNull()).where(F.coalesce(F.col(cols.op) == cols.removed, F.lit(False)) | (F.coalesce(value, F.lit("")) != ""))
    return latest(kept.select(F.col(cols.key).alias("key"), value.alias("value"), F.col(cols.op).alias("op"), F.col(cols.offset).alias("offset"), F.col(cols.time).alias("time")))


def latest(seen: DataFrame) -> DataFrame:
    """Of observations (key, value, op, offset, time) the newest of each key."""
    order = F.struct(F.col("time").isNotNull(), F.col("time"), F.col("offset"))
    return seen.groupBy("key").agg(F.max_by(F.struct("value", "op", "offset", "time"), order).alias("o")).select("key", "o.*")


def current_state(state: DataFrame, key: str = "path", value: str = "content_hash", version: str = "indexed_at") -> DataFrame:
    """The current row of each key: that of the greatest version; columns key, stored."""
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.lower(F.col(value)))
    return (
        state.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max_by(F.struct(F.lower(F.col(value)).alias("v")), order).alias("s"))
        .select("key", F.col("s.v").alias("stored"), F.lit(True).alias("known"))
    )


def judged(seen: DataFrame, state: DataFrame, cols: LogColumns) -> DataFrame:
    """Observations with a column open: whether they differ from the stored state.

    Removals are not pending work here. A key that was never stored, or stored without a value,
    differs from any observation.
    """
    removed = F.coalesce(F.col("op") == cols.removed, F.lit(False))
    differs = F.col("known").isNull() | ~F.col("value").eqNullSafe(F.col("stored"))
    return seen.join(current_state(state), "key", "left").select(*seen.columns, (~removed & differs).alias("open"))


def pending(log: DataFrame, state: DataFrame, cols: LogColumns = LogColumns()) -> DataFrame:
    """Keys whose newest observation differs from the stored state (see ``judged``): key, value, offset."""
    return judged(newest(log, cols), state, cols).where("open").select("key", "value", "offset")


class ChangeCapture:
    """Batches over a log with plans, commits and a sink in one shared folder.

    ``process(df)`` gets the pending rows (key, value, offset) and returns what the sink holds;
    its result must keep the columns key and offset. Empty logs give no batch. The folder
    ``seen`` has the verdict of each batch on each key of its slice; removals and keys that agree
    with the state again are there too, so they take earlier rows out of the sink.
    """

    def __init__(self, spark: SparkSession, root: str, cols: LogColumns = LogColumns(), partitions: int = PARTITIONS):
        self.spark, self.root, self.cols, self.partitions = spark, root.rstrip("/"), cols, partitions
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, what: dict) -> None:
        """Write under another name, then rename: a plan is there wholly or not at all."""
        at, tmp = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.tmp")
        self._fs.mkdirs(at.getParent())
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(what).encode()))
        finally:
            stream.close()
        if not self._fs.rename(tmp, at):
            raise OSError(f"cannot write {at}")

    def _last(self, folder: str) -> int:
        at = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(at):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([int(n) for n in names if n.isdigit()], default=-1)

    def plan(self, log: DataFrame) -> dict | None:
        """The plan to run now: the one that was not committed, else a new one, written ahead."""
        last, done = self._last("plans"), self._last("commits")
        if last > done:
            return self._load(last)
        end = end_offsets(log, self.cols, self.partitions)
        start = self._load(done)["end"] if done >= 0 else {}
        end = {p: max(o, start.get(p, o)) for p, o in end.items()}
        if all(start.get(p) == o for p, o in end.items()):
            return None
        self._write(f"plans/{last + 1}", {"batch": last + 1, "start": start, "end": {**start, **end}, "partitions": self.partitions})
        return self._load(last + 1)

    def _load(self, batch: int) -> dict:
        plan = self._read(f"plans/{batch}")
        return plan | {k: {int(p): o for p, o in plan[k].items()} for k in ("start", "end")}

    def run(self, log: DataFrame, state: DataFrame, process=lambda df: df) -> int | None:
        """One batch; gives its number, or None if nothing is new."""
        plan = self.plan(log)
        if plan is None:
            return None
        part = log_slice(log, self.cols, plan["start"], plan["end"], plan["partitions"])
        seen = newest(part, self.cols)
        if plan["batch"] > 0:
            before = self._rows("seen").where(F.col("batch") < plan["batch"]).select(seen.columns)
            seen = latest(seen.unionByName(before.join(seen.select("key"), "key", "left_semi")))
        verdicts = f"{self.root}/seen/batch={plan['batch']}"
        judged(seen, state, self.cols).write.mode("overwrite").parquet(verdicts)
        todo = self.spark.read.parquet(verdicts).where("open").select("key", "value", "offset")
        process(todo).write.mode("overwrite").parquet(f"{self.root}/sink/batch={plan['batch']}")
        self._write(f"commits/{plan['batch']}", {"batch": plan["batch"]})
        return plan["batch"]

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{folder}")

    def sink(self) -> DataFrame:
        """What the committed batches wrote, one row per key: that of the last verdict, if open.

        The last verdict is that on the newest observation (time, then offset), and of several on
        the same one that of the latest batch. Before the first commit there are none.
        """
        if self._last("commits") < 0:
            return self.spark.createDataFrame([], "key string, value string, offset bigint")
        done = F.col("batch") <= self._last("commits")
        order = F.struct(F.col("time").isNotNull(), F.col("time"), F.col("offset"), F.col("batch"))
        last = self._rows("seen").where(done).groupBy("key").agg(F.max_by(F.struct("batch", "open"), order).alias("s"))
        last = last.where("s.open").select("key", F.col("s.batch").alias("batch"))
        rows = self._rows("sink").where(done)
        rest = [c for c in rows.columns if c not in ("key", "batch")]
        return (
            rows.join(last, ["key", "batch"])
            .groupBy("key")
            .agg(F.max_by(F.struct(*rest), F.col("offset")).alias("r"))
            .select("key", "r.*")
        )
