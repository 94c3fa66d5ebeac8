"""Inputs of the registered queries, derived from the test tables: two versions of a table, a change log, an operation log.

Each comes twice: as DataFrames and as the text of common table expressions for the SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xid import xid_key
from ..operators.mapping import TableMapping
from ..session import table

MAPPING = TableMapping("orders", "orders_copy", "o_orderkey", {"o_orderkey": "order_id", "o_custkey": "customer_id"})

_SOURCE = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}"""
_TARGET = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus,
       CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 101 = 0"""

VERSIONS_SQL = f"src AS ({_SOURCE}),\ntgt AS ({_TARGET})".format(orders="orders")
#: Joined rows with the names of differing columns, for the comparison queries.
JOINED_SQL = VERSIONS_SQL + """,
pairs AS (SELECT s.o_orderkey AS sk, t.order_id AS tk, s.*, t.* EXCLUDE (o_orderstatus, o_totalprice, o_orderdate, o_orderpriority),
       t.o_orderstatus AS t_status, t.o_totalprice AS t_price, t.o_orderdate AS t_date, t.o_orderpriority AS t_priority
    FROM src s FULL OUTER JOIN tgt t ON s.o_orderkey = t.order_id),
diff AS (SELECT *, sk AS source_pk, tk AS target_pk,
       CASE WHEN tk IS NULL THEN 'missing_target' WHEN sk IS NULL THEN 'missing_source'
            WHEN o_custkey IS DISTINCT FROM customer_id OR o_orderstatus IS DISTINCT FROM t_status OR o_totalprice IS DISTINCT FROM t_price
              OR o_orderdate IS DISTINCT FROM t_date OR o_orderpriority IS DISTINCT FROM t_priority THEN 'mismatch' END AS diff_type FROM pairs)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(_SOURCE, orders=orders), spark.sql(_TARGET, orders=orders)


#: Events as a log of seven operations a transaction; every eleventh transaction is prepared, and then committed 50 places
#: behind its last operation, rolled back or left pending.
LOG_SQL = """lg AS (SELECT event_id AS pos, ts, user_id AS k, value AS v,
       CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, event_id // 7 AS txn FROM events),
tx AS (SELECT txn, max(pos) AS last_pos,
       CASE WHEN txn % 11 <> 0 THEN 'plain' WHEN txn % 22 = 0 THEN 'xa_rollback' WHEN txn % 55 = 0 THEN 'xa_pending' ELSE 'xa_commit' END AS kind
    FROM lg GROUP BY txn),
vis AS (SELECT lg.*, tx.kind, CASE WHEN tx.kind = 'xa_commit' THEN last_pos + 50 ELSE last_pos END AS commit_pos
    FROM lg JOIN tx USING (txn) WHERE tx.kind IN ('plain', 'xa_commit')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_pos DESC, (kind = 'xa_commit') DESC, pos DESC) AS rn FROM vis)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "ts", F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"), F.floor(F.col("event_id") / 7).alias("txn"))


def transactions(ops: DataFrame) -> DataFrame:
    """txn, last_pos, kind."""
    txn = F.col("txn")
    kind = F.when(txn % 11 != 0, "plain").when(txn % 22 == 0, "xa_rollback").when(txn % 55 == 0, "xa_pending").otherwise("xa_commit")
    return ops.groupBy("txn").agg(F.max("pos").alias("last_pos")).withColumn("kind", kind)


def commits(tx: DataFrame) -> DataFrame:
    """Commit markers (txn, commit_pos) of plain transactions."""
    return tx.where("kind = 'plain'").select("txn", F.col("last_pos").alias("commit_pos"))


def prepares(tx: DataFrame) -> DataFrame:
    """Prepared transactions (txn, xid, pos)."""
    name = F.concat(F.lit("trx_"), F.lpad(F.col("txn").cast("string"), 6, "0"))
    return tx.where("kind <> 'plain'").select("txn", xid_key(name).alias("xid"), F.col("last_pos").alias("pos"))


def outcomes(tx: DataFrame) -> DataFrame:
    """Ends of prepared transactions (xid, action, pos); a rollback comes 20 places behind the last operation."""
    name = F.concat(F.lit("trx_"), F.lpad(F.col("txn").cast("string"), 6, "0"))
    ended = tx.where("kind in ('xa_commit', 'xa_rollback')")
    commit = F.col("kind") == "xa_commit"
    return ended.select(xid_key(name).alias("xid"), F.when(commit, "commit").otherwise("rollback").alias("action"), (F.col("last_pos") + F.when(commit, 50).otherwise(20)).alias("pos"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it is written: operations, commits, prepares and outcomes, each at its place."""
    ops = log(spark, sf_dir)
    tx = transactions(ops)
    null = F.lit(None)
    end = F.concat(F.lit("xa_"), F.col("action"))
    parts = [
        ops.select("pos", F.lit("op").alias("event"), "txn", null.cast("string").alias("xid"), "op", "k", "v"),
        commits(tx).select(F.col("commit_pos").alias("pos"), F.lit("commit").alias("event"), "txn"),
        prepares(tx).select("pos", F.lit("prepare").alias("event"), "txn", "xid"),
        outcomes(tx).select("pos", end.alias("event"), "xid"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


METRICS_SQL = """m AS (SELECT event_id AS id, ts AS created_at, user_id % 5 + 1 AS task_id, value AS rps,
       CASE event_type WHEN 'signup' THEN 'snapshot_completed' WHEN 'view' THEN 'table_snapshot_completed' WHEN 'error' THEN 'task_paused' ELSE 'cdc_metrics' END AS event_type,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT *, event_type = 'cdc_metrics' AS cdc, greatest(k - k % 7 - k % 5 - k % 3, 0) AS read_k FROM m WHERE event_type <> 'task_paused')"""


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "snapshot_completed").when(F.col("event_type") == "view", "table_snapshot_completed").when(F.col("event_type") == "error", "task_paused").otherwise("cdc_metrics")
    detail = F.struct(
        F.col("k").alias("delay_seconds"), F.col("value").alias("rows_per_second"), (F.col("k") % 7).alias("insert_rows"), (F.col("k") % 5).alias("update_rows"), (F.col("k") % 3).alias("delete_rows"),
        F.col("k").alias("total_rows"), F.greatest(F.col("k") - F.col("k") % 7 - F.col("k") % 5 - F.col("k") % 3, F.lit(0)).alias("read_rows"),
    )
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("user_id") % 5 + 1).alias("task_id"), kind.alias("event_type"), F.col("k").alias("rows_affected"), F.to_json(detail).alias("detail"))
