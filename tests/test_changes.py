import datetime as dt

from tessera.operators import changes as C

LOG = "scan_id long, path string, content_hash string, op string, seen_at timestamp, clash int"
STATE = "path string, content_hash string, indexed_at long, clash string"


def at(h):
    return dt.datetime(2025, 1, 1, h)


def frames(spark, log, state):
    return spark.createDataFrame(log, LOG), spark.createDataFrame(state, STATE)


def found(df):
    return {(r["key"], r["value"]) for r in df.collect()}


def test_pending_cases(spark):
    log, state = frames(
        spark,
        [
            (1, "new", "AB", "create", at(1), 0),
            (2, "same", "CC", "write", at(1), 0),
            (3, "changed", "DD", "write", at(2), 0),
            (4, "changed", "EE", "write", at(1), 0),  # late: seen before
            (5, "gone", "FF", "write", at(1), 0),
            (6, "gone", None, "remove", at(2), 0),
            (7, "unread", "aa", "write", at(1), 0),
            (8, "unread", None, "write", at(2), 0),
            (9, None, "aa", "write", at(2), 0),
            (10, "tie", "11", "write", at(2), 0),
            (11, "tie", "22", "write", at(2), 0),
            (12, "notime", "33", "write", None, 0),
            (13, "noop", "44", None, at(1), 0),
            (13, "noop", "44", None, at(1), 0),
        ],
        [("same", "cc", 1, "x"), ("changed", "ee", 5, "x"), ("changed", "dd", 4, "x"), ("gone", "ff", 1, "x"), ("nullhash", None, 1, "x"), (None, "a", 1, "x")],
    )
    assert found(C.pending(log, state)) == {("new", "ab"), ("changed", "dd"), ("unread", "aa"), ("tie", "22"), ("notime", "33"), ("noop", "44")}


def test_empty_tables(spark):
    log, state = frames(spark, [], [])
    assert C.end_offsets(log, C.LogColumns()) == {}
    assert C.log_slice(log, C.LogColumns(), {}, {}).count() == 0
    assert found(C.pending(log, state)) == set()


def test_batches_survive_failure(spark, tmp_path):
    rows = [(i, f"p{i % 7}", f"h{i}", "write", at(i % 24), 0) for i in range(1, 40)]
    log, state = frames(spark, rows, [])
    run = C.ChangeCapture(spark, f"file://{tmp_path}/cdc", partitions=4)

    def fails(df):
        raise RuntimeError("lost")

    try:
        run.run(log, state, fails)
    except RuntimeError:
        pass
    planned = run.plan(log)
    more = log.union(spark.createDataFrame([(99, "p0", "zz", "write", at(23), 0)], LOG))
    assert run.plan(more) == planned  # the plan written ahead is replayed as it was
    assert run.run(more, state) == 0
    assert run.run(more, state) == 1  # what came in meanwhile
    assert run.run(more, state) is None
    got = {r["key"]: r["value"] for r in run.sink().collect()}
    assert got["p0"] == "zz" and len(got) == 7


def test_slice_bounds(spark):
    log, _ = frames(spark, [(i, f"k{i % 5}", "h", "write", at(1), 0) for i in range(20)], [])
    cols = C.LogColumns()
    end = C.end_offsets(log, cols, 8)
    part = C.log_slice(log, cols, {p: o - 5 for p, o in end.items()}, end, 8)
    assert {r["scan_id"] for r in part.collect()} == {15, 16, 17, 18, 19}


def test_batches_agree_with_one_slice(spark, tmp_path):
    rows = [
        (1, "late", "new", "write", at(5), 0), (2, "late", "old", "write", at(1), 0),
        (3, "gone", "h", "write", at(1), 0), (4, "gone", None, "remove", at(2), 0),
        (5, "back", "h", "write", at(1), 0), (6, "back", "stored", "write", at(2), 0),
        (7, "late removal", "h", "write", at(3), 0), (8, "late removal", None, "remove", at(1), 0),
        (9, "unread", "h", "write", at(1), 0), (10, "unread", None, "write", at(2), 0),
        (11, "no time", "h", "write", at(1), 0), (12, "no time", "x", "write", None, 0),
        (13, "gone late", None, "remove", at(4), 0), (14, "gone late", "h", "write", at(2), 0),
    ]
    log, state = frames(spark, rows, [("back", "stored", 1, "x")])
    run = C.ChangeCapture(spark, f"file://{tmp_path}/cdc", partitions=2)
    for end in (1, 3, 6, 9, 11, 13, 14):
        part = log.where(log.scan_id <= end)
        run.run(part, state)
        assert found(run.sink()) == found(C.pending(part, state))
    assert found(run.sink()) == {("late", "new"), ("late removal", "h"), ("unread", "h"), ("no time", "h")}


def test_file_scans_in_ten_batches(spark, tmp_path):
    log, state = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("file_scans", "files"))
    run = C.ChangeCapture(spark, f"file://{tmp_path}/cdc", partitions=4)
    ends = log.selectExpr("percentile(scan_id, array(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0))").first()[0]
    for end in ends:
        run.run(log.where(log.scan_id <= end), state)
    assert found(run.sink()) == found(C.pending(log, state))


def test_query_goes_through_plan_batch_and_sink(spark, tmp_path):
    """Late rows, removals and failed runs: the query gives what one pass over all rows gives."""
    from tessera.plans.changes import p5_found

    rows = [
        (1, "kept", "aa", "create", at(1), at(1)),
        (2, "late", "bb", "write", at(5), at(6)),
        (3, "gone", "cc", "create", at(2), at(2)),
        (4, "late", "b0", "write", at(3), at(20)),  # older, and in the second batch
        (5, "gone", None, "remove", at(9), at(20)),
        (6, "new", "DD", "create", at(10), at(21)),
        (7, "kept", "ab", "write", at(11), at(21)),
        (8, "unread", None, "write", at(11), None),
    ]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "scan_id long, path string, content_hash string, op string, seen_at timestamp, arrived_at timestamp").write.parquet(f"{folder}/file_scans.parquet")
    spark.createDataFrame([("kept", "AA", 1), ("gone", "cc", 1)], "path string, content_hash string, indexed_at long").write.parquet(f"{folder}/files.parquet")
    runs = [(1, at(4), at(5), "ok"), (2, at(7), at(8), "ok"), (3, at(15), at(16), "failed"), (4, at(22), None, "running")]
    spark.createDataFrame(runs, "run_id long, started_at timestamp, finished_at timestamp, status string").write.parquet(f"{folder}/index_runs.parquet")
    assert {tuple(r) for r in p5_found(spark, folder).collect()} == {("late", "bb"), ("new", "dd"), ("kept", "ab")}
    spark.createDataFrame(runs, "run_id long, started_at timestamp, finished_at timestamp, status string").limit(0).write.mode("overwrite").parquet(f"{folder}/index_runs.parquet")
    assert p5_found(spark, folder).count() == 3
    empty = f"file://{tmp_path}/none"
    for name in ("file_scans", "files", "index_runs"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p5_found(spark, empty).count() == 0
