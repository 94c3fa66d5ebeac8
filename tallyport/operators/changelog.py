"""Change logs: which operations are visible, in which order, and what they leave.

A log has rows (pos, txn, op, key and values). Transactions end by commit, by rollback or not at all; prepared ones are
replayed where their commit stands, not where they were prepared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.xid import key_suffix
from .merge import last_per_key

#: Replay order of visible operations: at a commit place, plain transactions come before prepared ones.
ORDER = ["commit_pos", "prepared", "pos"]


def assemble(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Operations of transactions that have a commit marker (txn, commit_pos); the uncommitted rest is left out."""
    return log.join(commits.select("txn", "commit_pos"), "txn").withColumn("prepared", F.lit(False))


def resolve_prepared(prepared: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The outcome of each prepared transaction: (txn, xid, commit_pos), null commit_pos while it is pending or rolled back.

    prepared: (txn, xid, pos). outcomes: (xid, action, pos). An outcome matches its own key first; else the newest earlier
    prepared transaction whose key is equal but for the format. Each outcome counts once.
    """
    none = F.lit(None)
    begun = prepared.select("xid", "pos", F.struct("txn", "xid").alias("m"), none.cast("string").alias("action"))
    every = begun.unionByName(outcomes.select("xid", "pos", "action"), allowMissingColumns=True).withColumn("suffix", key_suffix(F.col("xid")))
    # the newest prepared one up to each place, by a sort for each key: ids that are used again and again make no pairs
    newest = lambda by: F.last("m", ignorenulls=True).over(Window.partitionBy(by).orderBy("pos", F.col("m").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    best = every.withColumn("m", F.coalesce(newest("xid"), newest("suffix"))).where(F.col("action").isNotNull() & F.col("m").isNotNull()).withColumnRenamed("pos", "out_pos")
    ended = best.select("m.txn", F.when(F.col("action") == "commit", F.col("out_pos")).alias("commit_pos"), "action", "out_pos")
    ended = ended.groupBy("txn").agg(F.min_by(F.struct("commit_pos", "action"), "out_pos").alias("e")).select("txn", "e.commit_pos", "e.action")
    return prepared.join(ended, "txn", "left").select("txn", "xid", "commit_pos", F.coalesce("action", F.lit("pending")).alias("outcome"))


def orphans(prepared: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Commits without any prepared transaction that they could end: to be refused or set aside."""
    keys = prepared.select(key_suffix(F.col("xid")).alias("suffix")).distinct()
    return outcomes.where(F.col("action") == "commit").withColumn("suffix", key_suffix(F.col("xid"))).join(keys, "suffix", "left_anti").drop("suffix")


def of_tables(log: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations of the active mappings with their target_table, operations of tables that no mapping knows).

    log: rows with table_id. mappings: (table_id, target_table, active), one row a table; the planner broadcasts them if they are few.
    Operations of inactive mappings are in neither.
    """
    known = mappings.select("table_id", "target_table", "active")
    return log.join(known.where("active").drop("active"), "table_id"), log.join(known, "table_id", "left_anti")


def visible(log: DataFrame, transactions: DataFrame) -> DataFrame:
    """Operations that take effect, with commit_pos and prepared. transactions: (txn, commit_pos, prepared), null commit_pos: none."""
    return log.join(transactions.where(F.col("commit_pos").isNotNull()).select("txn", "commit_pos", "prepared"), "txn")


def between(ops: DataFrame, start=None, stop=None, column: str = "commit_pos") -> DataFrame:
    """Operations committed after start and up to stop."""
    if start is not None:
        ops = ops.where(F.col(column) > start)
    return ops if stop is None else ops.where(F.col(column) <= stop)


def latest_state(ops: DataFrame, key: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key in replay order, without keys whose last operation deletes them."""
    gone = deleted if deleted is not None else F.col("op") == "delete"
    return last_per_key(ops, key, order).where(~gone)


def latest_upserts_first(ops: DataFrame, key: list[str], order: list[str], unit: str = "txn") -> DataFrame:
    """As latest_state, but inside each unit all deletes come after all upserts: a key deleted and inserted again ends deleted."""
    staged = ops.withColumn("_late", (F.col("op") == "delete").cast("int"))
    unit_place = F.max(F.struct(*order)).over(Window.partitionBy(unit))
    staged = staged.withColumn("_unit", unit_place)
    return latest_state(staged, key, ["_unit", "_late", *order]).drop("_late", "_unit")


def split_key_changes(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Updates that move a row to another key, as the delete of the old key and the upsert of the new.

    changes: (pos, op, before, after), structs of `columns`.
    """
    moved = (F.col("op") == "update") & (F.col("before")[key] != F.col("after")[key])
    row = lambda side, op, step: F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), F.lit(step).alias("step"), *[F.col(side)[c].alias(c) for c in columns])
    own = F.when(F.col("op") == "delete", row("before", "delete", 0)).otherwise(row("after", F.col("op"), 1))
    rows = F.when(moved, F.array(row("before", "delete", 0), own)).otherwise(F.array(own))
    return changes.select("pos", F.explode(rows).alias("r")).select("pos", "r.*")


def counters(log: DataFrame) -> DataFrame:
    """inserts, updates, deletes."""
    return log.agg(*[F.count_if(F.col("op") == op).alias(f"{op}s") for op in ("insert", "update", "delete")])


def high_water(log: DataFrame) -> DataFrame:
    """The furthest position (file, pos)."""
    return log.agg(F.max(F.struct("file", "pos")).alias("p")).select("p.file", "p.pos")
