"""Functions without data: mappings, transaction ids, schedules, alerts, checks."""

import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import types as T

from tallyport.functions.xid import Xid, parse_prepare_event, parse_statement, parse_xid
from tallyport.operators import control, precheck, tasks
from tallyport.operators.mapping import TableMapping, normalized_fields, normalized_names, normalized_pairs, validated
from tallyport.operators.metrics import unit_for
from tallyport.sources.scan import shard_count


@pytest.mark.parametrize(
    ("args", "spec"),
    [(("interval", 5), "@every 5m"), (("cron", 0, "0 * * * *"), "0 * * * *"), (("manual",), ""), (("interval", 0), None), (("cron", 0, " "), None), (("never",), None)],
)
def test_schedule(args, spec):
    if spec is None:
        with pytest.raises(ValueError):
            control.schedule_spec(*args)
    else:
        assert control.schedule_spec(*args) == spec


def test_next_runs():
    at = datetime(2024, 2, 28, 23, 30)
    assert control.next_runs("0 * * * *", at, 2) == [datetime(2024, 2, 29), datetime(2024, 2, 29, 1)]
    assert control.next_runs("*/15 8-9 * * 1", at, 1) == [datetime(2024, 3, 4, 8)]
    assert control.next_runs("0 0 29 2 *", datetime(2024, 3, 1), 1) == [datetime(2028, 2, 29)]
    assert control.next_runs("0 0 13 * 5", datetime(2024, 9, 1), 2) == [datetime(2024, 9, 6), datetime(2024, 9, 13)]
    for bad in ("* * * *", "60 * * * *", "* * 0 * *"):
        with pytest.raises(ValueError):
            control.next_runs(bad, at)


@pytest.mark.parametrize(
    ("kind", "status", "delay", "expected"),
    [("full_cdc", "cdc_running", 42, 42), ("full_cdc", "catching_up", 35, 35), ("full_cdc", "paused", 9, 0), ("full_cdc", "stopped", 9, 0), ("full_cdc", "initializing", 9, 0), ("full_cdc", "failed", 9, 0), ("full", "cdc_running", 9, 0)],
)
def test_current_delay(kind, status, delay, expected):
    assert control.current_delay(kind, status, delay) == expected


def test_robot_key():
    assert control.robot_key(" abc-1 ") == "abc-1"
    assert control.robot_key("https://example.com/send?key=abc-1") == "abc-1"
    for bad in ("https://example.com/send?other=1", "abc&other=1", ""):
        with pytest.raises(ValueError):
            control.robot_key(bad)


def test_alerts_repeat_then_fall_silent():
    state, said, now = control.AlertState(), [], datetime(2024, 1, 1)
    for minute in range(0, 12 * 60, 30):
        state, event = control.alert_step(state, now + timedelta(minutes=minute), 100, 60)
        if event:
            said.append((minute // 60, event))
    assert said == [(0, "alert"), (1, "alert"), (3, "alert"), (6, "alert")]
    assert control.alert_step(state, now, 5, 60) == (control.AlertState(), "recovered")
    assert control.alert_step(control.AlertState(), now, 5, 60)[1] is None


def test_run_lock():
    with control.run_lock(1), control.run_lock(2), pytest.raises(RuntimeError), control.run_lock(1):
        pass
    with control.run_lock(1):
        pass


def test_sizes():
    assert control.memory_bytes("512m") == 512 << 20 and control.memory_bytes("4GiB") == 4 << 30 and control.memory_bytes("1000") == 1000
    assert shard_count(100, 4, 100) == 1 and shard_count(1000, 4, 100) == 4
    assert unit_for(datetime(2024, 1, 1), datetime(2024, 1, 3)) == "minute" and unit_for(datetime(2024, 1, 1), datetime(2024, 1, 3, 1)) == "hour"


def test_fields():
    assert normalized_fields({" a ": " b ", "": "", "c": "c"}) == {"a": "b"}
    assert normalized_fields({"a": "b", "b": "a"}) == {"a": "b", "b": "a"}
    for bad in ({"a": ""}, {"a": "x", "b": "x"}, {"1a": "b"}):
        with pytest.raises(ValueError):
            normalized_fields(bad)
    assert normalized_names([" a", "b", "a", ""]) == ["a", "b"]
    assert normalized_pairs(["a -> b", "a->b", " "]) == ["a->b"]
    with pytest.raises(ValueError):
        normalized_pairs(["ab"])


def test_mappings():
    m = TableMapping("s", "t", "id", {"id": "key", "x": "y"}, ["z"])
    assert m.pairs(["id", "x", "z"]) == [("id", "key"), ("x", "y")] and m.target_key == "key"
    with pytest.raises(ValueError):
        m.pairs(["id", "x"], ["key"])
    with pytest.raises(ValueError):
        TableMapping("s", "t", "id", {}, ["id"]).pairs(["id", "x"])
    with pytest.raises(ValueError):
        TableMapping("s", "t", "id", {"x": "id"}).pairs(["id", "x"])
    for bad in ([], [m, m], [m, TableMapping("s2", "t", "id")]):
        with pytest.raises(ValueError):
            validated(bad)


@pytest.mark.parametrize(
    ("text", "xid"),
    [
        ("'a','b',1", Xid(b"a", b"b", 1)), ("X'6162'", Xid(b"ab")), ("0x6162", Xid(b"ab")), ("'a''b'", Xid(b"a'b")), ("trx_005", Xid(b"trx_005")), ("X'61',X'',7", Xid(b"a", b"", 7)),
    ],
)
def test_xid(text, xid):
    assert parse_xid(text) == xid


def test_xid_key_and_statements():
    assert parse_xid("'trx_005'").key == "1:7472785f303035:"
    assert parse_statement("XA COMMIT 'a','b',1 ONE PHASE") == ("commit", Xid(b"a", b"b", 1), True)
    assert parse_statement("xa prepare X'6162'") == ("prepare", Xid(b"ab"), False)
    assert parse_statement("COMMIT") is None
    for bad in ("'a','b',1,2", "", "'a"):
        with pytest.raises(ValueError):
            parse_xid(bad)


def test_prepare_event():
    short = b"\0" + struct.pack("<II", 0xFFFFFFFF, 1) + b"\1ab"
    assert len(short) == 12 and parse_prepare_event(short) == (Xid(b"a", b"b", 0xFFFFFFFF), False)
    for n in range(10):
        with pytest.raises(ValueError):
            parse_prepare_event(short[:n])
    assert parse_prepare_event(b"\0" + struct.pack("<iII", 1, 3, 2) + b"abcde") == (Xid(b"abc", b"de", 1), False)


def test_schema_items(spark):
    source = T.StructType.fromDDL("id long, a string, b int")
    code = lambda *args, **more: [(i[0], i[3]) for i in precheck.schema_items(source, *args, **more)]
    assert code(source, "t", "id", {}, []) == [("success", "ok")]
    assert ("error", "key_ignored") in code(source, "t", "id", {}, ["id"])
    assert ("error", "missing_source_field") in code(source, "t", "id", {"q": "r"}, [])
    assert ("error", "ignored_and_mapped") in code(source, "t", "id", {"a": "z"}, ["a"])
    assert ("error", "double_target") in code(source, "t", "id", {"a": "b"}, [])
    assert ("warning", "missing_target") in code(None, "t", "id", {}, [])
    assert ("error", "missing_target_renamed") in code(None, "t", "id", {"a": "z"}, [])
    wide = T.StructType.fromDDL("id long, a string, b long")
    assert ("error", "type_mismatch") in code(wide, "t", "id", {}, [])
    assert code(wide, "t", "id", {}, [], confirmed=["b->b"]) == [("warning", "type_mismatch"), ("success", "ok")]
    assert ("warning", "target_trigger") in code(source, "t", "id", {}, [], triggers=["trg"])
    assert precheck.base(T.DecimalType(10, 2)) == "decimal"
    assert not precheck.limit_items(0, 0) and not precheck.limit_items(20_000, 32)
    assert [i[3] for i in precheck.limit_items(50, 33)] == ["batch_size", "workers"]


def test_given_times():
    utc = timezone.utc
    at = datetime(2024, 5, 6, 7, 8, tzinfo=utc)
    for text in ("2024-05-06T07:08:00Z", "2024-05-06T09:08:00+02:00", " 2024-05-06T07:08 ", "2024-05-06T07:08:00", "2024-05-06 07:08:00"):
        assert control.metric_time(text, utc) == at
    assert control.metric_time("  ") is None
    for text in ("2024-05-06T07:08:00.000Z", "2024-05-06 07:08", "2024-05-06 07:08:00"):
        assert control.repair_time(text, utc) == at
    assert control.repair_time("2024-05-06 07:08").tzinfo is not None
    for parse, bad in ((control.metric_time, "2024-05-06 07:08"), (control.metric_time, "today"), (control.repair_time, ""), (control.repair_time, "2024-05-06T07:08")):
        with pytest.raises(ValueError):
            parse(bad)


def test_precheck_enables_and_stores_keys():
    task = tasks.Task(901, runtime_status="paused")
    assert not tasks.conclude_precheck(task, [("error", "t", "", "x", "")], {"t": ("id", "id")})
    assert (task.enabled, task.validation, task.keys) == (False, "failed", {})
    assert tasks.conclude_precheck(task, [("warning", "t", "", "x", "")], {"t": ("id", "key")})
    assert (task.enabled, task.validation, task.keys, task.runtime_status) == (True, "passed", {"t": ("id", "key")}, "paused")
    tasks.conclude_precheck(task, [("error", "t", "", "x", "")], {})
    assert (task.enabled, task.validation, task.keys) == (False, "failed", {"t": ("id", "key")})


def test_execution_states():
    clock = iter(datetime(2024, 1, 1) + timedelta(seconds=2 * i) for i in range(100))
    said, resolved = [], []
    run = lambda task, work, **more: tasks.execute(task, work, record=lambda *a: said.append(a[:2]), resolve=lambda *a: resolved.append(a), now=lambda: next(clock), **more)
    task = tasks.Task(902, enabled=True, validation="passed", checkpoints={"t": 5})
    assert run(task, lambda t: 40 if t.runtime_status == "initializing" and not t.checkpoints else -1) == 40
    assert (task.last_run_status, task.runtime_status, task.rows_processed, task.rows_per_second) == ("success", "completed", 40, 20.0)
    assert said == [("snapshot_started", "running"), ("snapshot_run", "success"), ("snapshot_completed", "success")]
    assert resolved == [(902, "error"), (902, "delay")]

    def pause(t):
        raise tasks.Paused

    def fail(t):
        raise OSError("gone")

    assert run(task, pause) is None and (task.runtime_status, task.last_run_status) == ("paused", "paused")
    with pytest.raises(OSError):
        run(task, fail)
    assert (task.runtime_status, task.message, said[-1]) == ("failed", "gone", ("snapshot_run", "failed"))
    inside = []
    with pytest.raises(RuntimeError, match="is running"):
        run(task, lambda t: inside.append(1) or run(t, lambda u: 0))
    before = len(said)
    for other in (tasks.Task(903, validation="passed"), tasks.Task(903, enabled=True), tasks.Task(903, enabled=True, validation="failed")):
        with pytest.raises(RuntimeError):
            run(other, lambda t: 0)
    with pytest.raises(OSError):
        run(tasks.Task(903, enabled=True, validation="passed"), lambda t: 0, reachable=fail)
    assert len(said) == before
    assert run(tasks.Task(904, kind="full_cdc"), lambda t: 0, stream=lambda t: "started") == "started"
