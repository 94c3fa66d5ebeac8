"""Streaming replay of a change log into a versioned table, and a log source with (file, pos) offsets."""

from __future__ import annotations

import hashlib
import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.changelog import ORDER, latest_state, orphans, resolve_prepared, visible
from ..operators.merge import VersionedTable, delete, upsert


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, files_a_batch: int | None = None) -> DataFrame:
    """A folder of Parquet log files as a stream; files_a_batch bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def apply_batch(target: DataFrame, ops: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Target with `_at`, the place of each row's last operation, after operations in any batch order.

    An operation takes effect only if its place is behind the row's, so batches that are replayed change nothing. Deleted
    keys stay as rows with `_gone`, for the same reason.
    """
    last = latest_state(ops, key, order, F.lit(False)).withColumns({"_at": F.struct(*order), "_gone": F.col("op") == "delete"})
    known = target.select(*key, F.col("_at").alias("_was"))
    fresh = last.join(known, key, "left").where(F.col("_was").isNull() | (F.col("_at") > F.col("_was")))
    return upsert(target, fresh.select(*[c for c in fresh.columns if c in target.columns]), key)


class Replay:
    """Applies a stream of operations to a versioned table; each micro-batch publishes one version, marked with its number.

    The stream's checkpoint says what was read; a batch that was published but not checkpointed is applied again without
    effect. Operations carry commit_pos and prepared (see operators.changelog); uncommitted ones are held back upstream.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: str, order: list[str] = ORDER):
        self.table, self.key, self.order = VersionedTable(spark, path), key, order
        self.spark, self.columns, self.stream = spark, columns, ""

    def _empty(self, ops: DataFrame) -> DataFrame:
        at = T.StructType([ops.schema[o] for o in self.order])
        schema = T.StructType([*T.StructType.fromDDL(self.columns).fields, T.StructField("_at", at), T.StructField("_gone", T.BooleanType())])
        return self.spark.createDataFrame([], schema)

    def batch(self, ops: DataFrame, number: int) -> None:
        target = self.table.read() if self.table.version() else self._empty(ops)
        self.table.publish(apply_batch(target, ops, self.key, self.order))

    def start(self, ops: DataFrame, checkpoint: str, **trigger):
        self.stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        return ops.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def state(self) -> DataFrame:
        """Live rows."""
        return self.table.read().where(~F.coalesce(F.col("_gone"), F.lit(False))).drop("_at", "_gone")


#: Events of a raw log: an operation, the end of its transaction, a prepared transaction and its outcome.
EVENTS = ("op", "commit", "prepare", "xa_commit", "xa_rollback")


class TransactionalReplay(Replay):
    """Replay of a raw log: rows have (pos, event, txn, xid, op) besides the values; see EVENTS. Where positions start anew in each file, rows
    have (file, pos) and are ordered by both.

    A micro-batch is joined with what earlier ones left open. Transactions that have ended take effect at the place of
    their commit; open and prepared ones are carried in a table of their own, published after the target and tagged with the
    stream's checkpoint and the batch's number, as a new checkpoint counts from 0 again. A batch that is run again is either known by that tag or finds the open rows that it found before, and
    the target takes nothing twice. A commit of a prepared transaction
    that nobody has prepared is an error, or is set aside with on_orphan="keep".
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: str, on_orphan: str = "fail"):
        super().__init__(spark, f"{path}/rows", key, columns)
        self.open, self.aside, self.on_orphan = VersionedTable(spark, f"{path}/open"), VersionedTable(spark, f"{path}/aside"), on_orphan

    def batch(self, log: DataFrame, number: int) -> None:
        tag = f"{self.stream}-{number}"
        if self.open.tag() == tag:
            return
        if "file" in log.columns:
            log = log.withColumn("pos", F.struct("file", "pos")).drop("file")
        rows = self.open.read().unionByName(log).dropDuplicates(["pos", "event"]) if self.open.version() else log
        rows = rows.persist()
        try:
            ends, prepared = rows.where("event = 'commit'"), rows.where("event = 'prepare'").select("txn", "xid", "pos")
            outcomes = rows.where("event in ('xa_commit', 'xa_rollback')").select("xid", F.replace("event", F.lit("xa_"), F.lit("")).alias("action"), "pos")
            lost = orphans(prepared, outcomes)
            if lost.head(1):
                if self.on_orphan == "fail":
                    raise ValueError(f"commit of a transaction that was not prepared: {lost.head(1)[0].asDict()}")
                self.aside.publish(self.aside.read().unionByName(lost).distinct() if self.aside.version() else lost)
            found = resolve_prepared(prepared, outcomes)
            ended = ends.select("txn", F.col("pos").alias("commit_pos"), F.lit(False).alias("prepared")).unionByName(found.select("txn", "commit_pos", F.lit(True).alias("prepared")))
            ops = visible(rows.where("event = 'op'").drop("event", "xid"), ended)
            super().batch(ops, number)
            done = ends.select("txn").union(found.where("outcome <> 'pending'").select("txn"))
            left = rows.where("event in ('op', 'prepare')").join(done, "txn", "left_anti")
            self.open.publish(left.select(*log.columns), tag)
        finally:
            rows.unpersist()


def hand_over(snapshot: DataFrame, ops: DataFrame, key: list[str], order: list[str], start) -> DataFrame:
    """Snapshot, then all operations behind the position that was taken before it. Operations that the snapshot has already
    seen are written again with the same result."""
    behind = ops.where(F.col(order[0]) > start)
    last = latest_state(behind, key, order, F.lit(False))
    live = last.where(F.col("op") != "delete").select(*[c for c in snapshot.columns if c in last.columns])
    return upsert(delete(snapshot, last.where(F.col("op") == "delete"), key), live, key)


def onboard(snapshot: DataFrame, ops: DataFrame, key: list[str], order: list[str], start, target) -> DataFrame:
    """A new table brought to the main stream's position: its snapshot and the operations in (start, target]. From target on the
    main stream carries it with the others."""
    return hand_over(snapshot, ops.where(F.col(order[0]) <= target), key, order, start)


def resume_position(stored: tuple | None, oldest: tuple, newest: tuple, reset: bool = False) -> tuple:
    """Where a stream goes on: its stored position, the newest for a first start. A stored position that the log has lost is an
    error; with reset the stream starts anew at the newest and the gap is lost."""
    if stored is None:
        return newest
    if oldest <= stored <= newest:
        return stored
    if not reset:
        raise ValueError(f"position {stored} is not in the log, which holds {oldest} to {newest}")
    return newest


class _Piece(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class PositionReader(DataSourceStreamReader):
    """Offsets are {file: lines read}; each micro-batch reads every file from its last line to its present end.

    Files are lines of JSON in a folder that driver and executors share.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder = schema, options["path"]

    def _now(self) -> dict:
        import glob
        import os

        found = {}
        for path in sorted(glob.glob(os.path.join(self.folder, "*.log"))):
            with open(path, "rb") as f:
                found[os.path.basename(path)] = sum(line.endswith(b"\n") for line in f)
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Piece(f, start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)]

    def read(self, partition: _Piece):
        import os
        from itertools import islice

        with open(os.path.join(self.folder, partition.file), encoding="utf-8") as f:
            for k, line in enumerate(islice(f, partition.low, partition.high), partition.low):
                row = json.loads(line)
                yield tuple(partition.file if c == "file" else k if c == "pos" else row.get(c) for c in self.schema.names)

    def commit(self, end: dict) -> None:
        pass


class PositionLog(DataSource):
    """spark.dataSource.register(PositionLog); spark.readStream.format("position_log").schema(...).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "position_log"

    def schema(self) -> str:
        return "file string, pos long, txn long, op string, k long, v double"

    def streamReader(self, schema: T.StructType) -> PositionReader:
        return PositionReader(schema, self.options)


class Supervisor:
    """One running query a task: start, pause, resume."""

    def __init__(self):
        self._queries: dict[str, object] = {}
        self._lock = threading.Lock()

    def start(self, task: str, begin) -> None:
        with self._lock:
            old = self._queries.get(task)
            if old is not None and old.isActive:
                raise RuntimeError(f"{task} is running")
            self._queries[task] = begin()

    def pause(self, task: str) -> None:
        with self._lock:
            query = self._queries.pop(task, None)
        if query is not None:
            query.stop()

    def running(self) -> list[str]:
        return sorted(t for t, q in self._queries.items() if q.isActive)
