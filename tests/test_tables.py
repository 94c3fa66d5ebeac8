"""Operators on small tables: edge values, invariants, publication, streaming, sources."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyport.functions import canonical as canon
from tallyport.operators import changelog, compare, merge, metrics, repair
from tallyport.operators.mapping import TableMapping
from tallyport.sources import adhoc, scan
from tallyport.streaming import replay


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_canonical_time(spark):
    cases = {
        "2024-01-01 00:00:00": "2024-01-01 00:00:00", "2024-01-01T00:00:00": "2024-01-01 00:00:00", "2024-01-01 00:00:00.120": "2024-01-01 00:00:00.12", "2024-01-01T08:00:00+08:00": "2024-01-01 08:00:00",
        " 2024-01-01 00:00:00 ": "2024-01-01 00:00:00", "2024-01-01T00:00:00.1234567Z": "2024-01-01 00:00:00.123456", "2024": "2024", "12:00": "12:00", "2024-01-01": "2024-01-01", "2024-01-01 10:00": "2024-01-01 10:00",
        "2024-13-01 00:00:00": "2024-13-01 00:00:00", "": "", "2024-01-01 00:00:00.000": "2024-01-01 00:00:00", "2024-01-01 00:00:00.100200": "2024-01-01 00:00:00.1002",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", canon.canonical_time(F.col("t"))).collect()} == cases


def test_canonical_values(spark):
    df = spark.sql("SELECT true AS b, 1 AS i, 1.0D AS d, 1e20D AS big, 0.1F AS f, cast('NaN' AS double) AS nan, 1.00BD AS n, cast(null AS string) AS z, 1.5e-7D AS small, -0.25D AS neg, 100.0D AS hundred")
    got = df.select(*[canon.canonical(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first().asDict()
    assert got == {"b": "1", "i": "1", "d": "1", "big": "100000000000000000000", "f": "0.1", "nan": "NaN", "n": "1", "z": None, "small": "0.00000015", "neg": "-0.25", "hundred": "100"}
    assert df.select(canon.canonical(F.col("n"), df.schema["n"].dataType, True)).first()[0] == "1.00"
    same = lambda a, b: df.select(canon.same(F.col(a), df.schema[a].dataType, F.col(b), df.schema[b].dataType)).first()[0]
    assert same("b", "i") and same("i", "d") and same("z", "z") and not same("z", "i")


def test_mismatch_message(spark):
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(names[:2],), (names,)], "n array<string>")
    assert [r[0] for r in df.select(canon.mismatch_message(F.col("n"))).collect()] == ["c0, c1", "c0, c1, c2, c3, c4, c5, c6, c7 ... (10 columns)"]


def test_upsert_keeps_and_overwrites(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    changes = spark.createDataFrame([(2, None), (3, "c")], "id int, x string")
    assert rows(merge.upsert(target, changes, ["id"]), "id") == [(1, "a", 1), (2, None, 2), (3, "c", None)]


def test_log_is_idempotent_and_compare_is_empty(spark):
    log = spark.createDataFrame([(1, "insert", 1, "a"), (2, "insert", 2, "b"), (3, "delete", 1, None), (4, "insert", 1, "c"), (5, "update", 2, None)], "pos int, op string, id int, x string")
    empty = merge.create_like(spark, log.select("id", "x"))
    once = merge.apply_log(empty, log, ["id"], ["pos"])
    assert rows(once, "id") == [(1, "c"), (2, None)]
    again = merge.apply_log(once, log.where("pos >= 1"), ["id"], ["pos"])
    mapping = TableMapping("a", "b", "id")
    assert compare.compare(once, again, mapping).count() == 0
    assert rows(merge.apply_log(empty, log, ["id"], ["pos"], upserts_first=True), "id") == [(2, None)]


def test_repair_leaves_extras(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string")
    target = spark.createDataFrame([(2, "b"), (3, "c"), (9, "z")], "id int, x string")
    mapping = TableMapping("a", "b", "id")
    diffs = compare.compare(source, target, mapping)
    assert rows(diffs.select("source_pk", "target_pk", "diff_type", "message"), "diff_type") == [(2, 2, "mismatch", "x"), (None, 9, "missing_source", ""), (1, None, "missing_target", "")]
    fixed, status = repair.repair(diffs, source, target, mapping)
    assert [r.diff_type for r in compare.compare(source, fixed, mapping).collect()] == ["missing_source"]
    assert rows(status.select("diff_type", "status"), "diff_type") == [("mismatch", "repaired"), ("missing_source", "skipped"), ("missing_target", "repaired")]


def test_swapped_columns(spark):
    source = spark.createDataFrame([(1, 10, 20)], "id int, a int, b int")
    swapped = TableMapping("s", "t", "id", {"a": "b", "b": "a"})
    assert swapped.select(source).first().asDict() == {"id": 1, "a": 20, "b": 10}


def test_prepared_falls_back_to_newest_suffix(spark):
    prepared = spark.createDataFrame([(1, "1:61:", 10), (2, "2:61:", 20), (3, "1:62:", 30)], "txn int, xid string, pos int")
    outcomes = spark.createDataFrame([("7:61:", "commit", 25), ("1:62:", "rollback", 40)], "xid string, action string, pos int")
    assert rows(changelog.resolve_prepared(prepared, outcomes), "txn") == [(1, "1:61:", None, "pending"), (2, "2:61:", 25, "commit"), (3, "1:62:", None, "rollback")]
    assert changelog.orphans(prepared, spark.createDataFrame([("1:99:", "commit", 5)], "xid string, action string, pos int")).count() == 1


def test_metrics_ignore_broken_detail(spark):
    log = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 5), 1, "cdc_metrics", 0, "{broken"), (2, datetime(2024, 1, 1, 0, 0, 9), 1, "cdc_metrics", 0, '{"delay_seconds": 7, "rows_per_second": 1.5, "total_rows": 3}')], "id long, created_at timestamp_ntz, task_id long, event_type string, rows_affected long, detail string")
    got = metrics.history(log, "minute").first().asDict()
    assert (got["delay_seconds"], got["rows_per_second"], got["total_rows"]) == (7, 1.5, 3)
    assert metrics.history(log.limit(0), "hour").count() == 0


def test_progress_of_nothing(spark):
    tables = spark.createDataFrame([(0, 0, "active")], "processed long, total long, sync_state string")
    assert metrics.progress(tables).first()["percent"] == 100.0
    assert metrics.progress(tables.withColumn("sync_state", F.lit("failed"))).first()["percent"] == 0.0


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shard_bounds_cover(spark, sf_dir, shards):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = scan.shard_bounds(orders, "o_orderkey", shards).orderBy("shard").collect()
    assert len(got) == shards and sum(r.n for r in got) == orders.count()
    assert got[0].low is None and got[-1].high is None and max(r.n for r in got) - min(r.n for r in got) <= 2
    for r in got:
        assert scan.key_range(orders, "o_orderkey", r.low, r.high).count() == r.n


def test_shard_bounds_of_texts(spark):
    rows = spark.range(500).selectExpr("concat('k', lpad(cast(id * 7919 % 500 as string), 4, '0')) AS k")
    got = scan.shard_bounds(rows, "k", 4).orderBy("shard").collect()
    assert [r.high for r in got] == ["k0125", "k0250", "k0375", None] and [r.n for r in got] == [126, 125, 125, 124]
    assert sum(r.n or 0 for r in scan.shard_bounds(rows.limit(0), "k", 4).collect()) == 0


def test_filters_reach_the_scan(spark, sf_dir):
    df = scan.key_range(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 10, 20).select("o_orderkey", "o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,10)" in plan and "o_comment" not in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_jdbc_ranges(spark):
    url = "jdbc:derby:memory:tallyport;create=true"
    spark.range(1, 21).selectExpr("id AS ID", "id * 2 AS V").write.jdbc(url, "numbers", mode="overwrite")
    df = scan.jdbc_table(spark, url, "numbers", "ID", [5, 12])
    assert df.rdd.getNumPartitions() == 3 and sorted(r.ID for r in df.collect()) == list(range(1, 21))


def test_versions(spark, tmp_path):
    t = merge.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0
    assert t.publish(spark.range(3)) == 1 and t.publish(t.read().where("id > 0")) == 2
    assert rows(t.read(), "id") == [(1,), (2,)] and t.read(1).count() == 3


def test_adhoc(spark):
    spark.range(25).createOrReplaceTempView("numbers25")
    got = adhoc.paged(spark, "SELECT id FROM numbers25 WHERE id >= ? ORDER BY id", [5], 0, 0)
    assert got["total"] == 20 and got["page"] == 1 and [d["id"] for d in got["data"]] == list(range(5, 15))
    assert "numbers25" in adhoc.list_tables(spark) and adhoc.quoted("a`b") == "`a``b`"
    c = adhoc.Connections()
    c.add("main", spark.table, lambda: adhoc.list_tables(spark))
    assert c.names() == ["main"] and "numbers25" in c.tables("main") and c.healthy() == {"main": True} and c.get("main")("numbers25").count() == 25
    with pytest.raises(ValueError):
        c.add("main", spark.table)
    c.remove("main")
    with pytest.raises(KeyError):
        c.get("main")


def test_time_like(spark):
    assert scan.time_like_columns(spark.createDataFrame([], "id int, created_at timestamp, update_mark int, x string")) == ["created_at", "update_mark"]


OPS = "pos long, commit_pos long, prepared boolean, op string, k long, v double"


def test_stream_equals_fold(spark, tmp_path):
    ops = [(i, i, False, ["insert", "update", "delete"][i * 7 % 3], i * 13 % 6, float(i)) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(ops[part * 10 : part * 10 + 10], OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        job = replay.Replay(spark, str(tmp_path / "target"), ["k"], "k long, v double")
        job.start(replay.read_log(spark, str(tmp_path / "log"), OPS, 1), str(tmp_path / "checkpoint")).awaitTermination()
    want = changelog.latest_state(spark.createDataFrame(ops, OPS), ["k"], changelog.ORDER).select("k", "v")
    assert rows(job.state(), "k") == rows(want, "k")
    version = job.table.version()
    job.batch(spark.createDataFrame(ops[:25], OPS), 99)  # read again after a failure
    assert job.table.version() == version + 1 and rows(job.state(), "k") == rows(want, "k")


RAW = "pos long, event string, txn long, xid string, op string, k long, v double"


def raw_log():
    """Interleaved transactions: txn 1 plain, 2 prepared and committed late, 3 rolled back, 4 left open, 5 plain, 6 pending."""
    out, pos = [], 0
    for txn in [1, 2, 1, 3, 2, 4, 5, 2, 5, 6, 4, 6]:
        pos += 1
        out.append((pos, "op", txn, None, "delete" if pos % 5 == 0 else "update", pos % 4, float(pos)))
        for at, row in {3: ("commit", 1, None), 8: ("prepare", 2, "1:61:"), 4: ("prepare", 3, "1:62:"), 9: ("commit", 5, None), 12: ("prepare", 6, "1:63:")}.items():
            if pos == at:
                out.append((pos * 10 + 1000, *row, None, None, None))
    out = [(i, *r[1:]) for i, r in enumerate(out)]
    n = len(out)
    return out + [(n, "xa_rollback", None, "1:62:", None, None, None), (n + 1, "xa_commit", None, "1:61:", None, None, None)]


@pytest.mark.parametrize("size", [3, 7, 100])
def test_transactional_stream(spark, tmp_path, size):
    log = raw_log()
    job = replay.TransactionalReplay(spark, str(tmp_path / "t"), ["k"], "k long, v double")
    for at in range(0, len(log), size):
        part = spark.createDataFrame(log[at : at + size], RAW)
        job.batch(part, at)
        job.batch(part, at)  # once more, as after a failure
    ends = {r[2]: r[0] for r in log if r[1] == "commit"} | {2: log[-1][0]}
    ops = sorted(((ends[r[2]], r[2] == 2, r[0]), r) for r in log if r[1] == "op" and r[2] in ends)
    state = {}
    for _, r in ops:
        state.pop(r[5], None)
        if r[4] != "delete":
            state[r[5]] = r[6]
    assert rows(job.state(), "k") == sorted(state.items())
    assert {r.txn for r in job.open.read().collect()} == {4, 6}


def test_orphan_commit(spark, tmp_path):
    part = spark.createDataFrame([(1, "xa_commit", None, "1:99:", None, None, None)], RAW)
    with pytest.raises(ValueError):
        replay.TransactionalReplay(spark, str(tmp_path / "a"), ["k"], "k long, v double").batch(part, 0)
    kept = replay.TransactionalReplay(spark, str(tmp_path / "b"), ["k"], "k long, v double", on_orphan="keep")
    kept.batch(part, 0)
    assert kept.aside.read().count() == 1


def test_windowed_history_stream(spark, tmp_path):
    schema = "id long, created_at timestamp, task_id long, event_type string, detail string"
    spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i // 2), 1, "cdc_metrics", json.dumps({"delay_seconds": i, "total_rows": 1})) for i in range(6)], schema).write.parquet(str(tmp_path / "log"))
    q = metrics.history_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("history").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.delay_seconds, r.total_rows) for r in spark.table("history").orderBy("bucket").collect()] == [(1, 2), (3, 2), (5, 2)]


def test_position_log(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "binlog.000001.log").write_text("".join(json.dumps({"txn": i, "op": "insert", "k": i, "v": 1.0}) + "\n" for i in range(5)))
    spark.dataSource.register(replay.PositionLog)

    def drain():
        q = spark.readStream.format("position_log").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")).select("file", "pos"), "file", "pos")

    assert len(drain()) == 5
    (folder / "binlog.000002.log").write_text(json.dumps({"txn": 9, "op": "delete", "k": 1, "v": None}) + "\n")
    assert drain()[-1] == ("binlog.000002.log", 0)


def test_supervisor():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    s = replay.Supervisor()
    s.start("a", Query)
    with pytest.raises(RuntimeError):
        s.start("a", Query)
    assert s.running() == ["a"]
    s.pause("a")
    s.start("a", Query)


def test_jobs_run_once_and_cancel(spark):
    import threading
    import time

    from tallyport.operators.jobs import CANCELED, FAILED, SUCCESS, Jobs

    jobs, go = Jobs(spark), threading.Event()
    held = jobs.start(1, "compare", lambda: go.wait(20))
    with pytest.raises(RuntimeError):
        jobs.start(1, "repair", lambda: None)
    go.set()
    held.thread.join()
    done = jobs.start(1, "compare", lambda: spark.range(10).count())
    done.thread.join()
    assert (done.status, done.result) == (SUCCESS, 10)
    bad = jobs.start(2, "compare", lambda: 1 / 0)
    bad.thread.join()
    assert bad.status == FAILED and "division" in bad.message
    slow = jobs.start(3, "compare", lambda: spark.range(0, 10**13, 1, 4).selectExpr("sum(hash(id) % 7)").collect())
    time.sleep(3)
    jobs.cancel(slow)
    slow.thread.join(60)
    assert slow.status == CANCELED and jobs.newest(1, 1) == [done]


def test_resume_position():
    oldest, newest = ("log.000002", 4), ("log.000009", 70)
    assert replay.resume_position(None, oldest, newest) == newest
    assert replay.resume_position(("log.000003", 1), oldest, newest) == ("log.000003", 1)
    with pytest.raises(ValueError):
        replay.resume_position(("log.000001", 9), oldest, newest)
    assert replay.resume_position(("log.000001", 9), oldest, newest, reset=True) == newest


def test_shown_text(spark):
    from tallyport.functions.text import compact_number, duration_text

    df = spark.createDataFrame([(None,), (-5,), (0,), (59,), (60,), (3661,), (90000,)], "s long")
    assert [r[0] for r in df.select(duration_text(F.col("s"))).collect()] == ["0 s", "0 s", "0 s", "59 s", "1 min 0 s", "1 h 1 min", "1 d 1 h"]
    assert [r[0] for r in spark.createDataFrame([(999,), (1000,), (2500000,)], "n long").select(compact_number(F.col("n"))).collect()] == ["999", "1.0k", "2.5m"]


def test_streams_over_files_with_their_own_positions(spark, tmp_path):
    """Two files whose positions both start at 0, and a stream that starts anew on another checkpoint: nothing is taken for a repeat."""
    schema = "file string, " + RAW
    one = [("a", 0, "op", 1, None, "insert", 1, 1.0), ("a", 1, "op", 2, None, "insert", 2, 2.0), ("a", 2, "commit", 2, None, None, None, None)]
    two = [("b", 0, "op", 3, None, "insert", 3, 3.0), ("b", 1, "commit", 3, None, None, None, None), ("b", 2, "commit", 1, None, None, None, None)]
    schema_rows = lambda part: spark.createDataFrame(part, schema)
    job = replay.TransactionalReplay(spark, str(tmp_path / "t"), ["k"], "k long, v double")
    job.stream = "first"
    job.batch(schema_rows(one), 0)
    job.stream = "second"
    job.batch(schema_rows(two), 0)
    assert rows(job.state(), "k") == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_reused_transaction_ids(spark):
    prepared = spark.createDataFrame([(i, "1:61:", 10 * i) for i in range(1, 6)], "txn long, xid string, pos long")
    outcomes = spark.createDataFrame([("1:61:" if i % 2 else "2:61:", "commit", 10 * i + 5) for i in range(1, 5)], "xid string, action string, pos long")
    assert rows(changelog.resolve_prepared(prepared, outcomes).select("txn", "commit_pos", "outcome"), "txn") == [(i, 10 * i + 5, "commit") for i in range(1, 5)] + [(5, None, "pending")]


def test_literals():
    from datetime import date
    from decimal import Decimal

    shown = [scan.sql_literal(x) for x in (5, 1.5, Decimal("2.50"), "a'b", date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), True)]
    assert shown == ["5", "1.5", "2.50", "'a''b'", "DATE '2024-01-02'", "TIMESTAMP '2024-01-02 03:04:05.000000'", "TRUE"]
    with pytest.raises(TypeError):
        scan.sql_literal(b"x")
