"""The registered queries, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as canon
from ..functions.text import compact_number, duration_text
from ..functions.xid import key_suffix, xid_key
from ..operators import changelog, compare, merge, metrics, precheck, repair
from ..operators.control import runtime_label
from ..operators.mapping import TableMapping
from ..session import table, work_folder
from ..sources import adhoc, scan, snapshot
from ..streaming import replay
from . import fixtures as fx

_queries: dict = {}
_sql: dict[str, str] = {}
FROM, TO = datetime(1996, 1, 1), datetime(1996, 12, 31)


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- snapshots, ranges, pages -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 1000 AND o_orderkey > 100")
def snapshot_copy_mapped(spark, sf_dir):
    mapping = TableMapping("orders", "copy", "o_orderkey", {"o_orderkey": "order_id", "o_custkey": "customer_id"}, ["o_orderpriority"], custom_where="o_totalprice > 1000")
    return snapshot.snapshot(table(spark, sf_dir, "orders"), mapping, low=100)


@query("""WITH r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
b AS (SELECT 0 AS i, CAST(NULL AS BIGINT) AS k UNION ALL SELECT i, k FROM r, range(1, 4) t(i) WHERE rn = n * i // 4 + 1 UNION ALL SELECT 4, NULL)
SELECT CAST(a.i AS INTEGER) AS shard, a.k AS low, z.k AS high, (SELECT count(*) FROM r WHERE (a.k IS NULL OR r.k > a.k) AND (z.k IS NULL OR r.k <= z.k)) AS n
FROM b a JOIN b z ON z.i = a.i + 1""")
def shard_bounds(spark, sf_dir):
    return scan.shard_bounds(table(spark, sf_dir, "orders"), "o_orderkey", 4).select("shard", "low", "high", "n")


@query("""SELECT CAST(o_orderkey % 4 AS INTEGER) AS shard, count(*) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS processed,
CAST(least(100, count(*) FILTER (WHERE o_orderstatus = 'F') * 100 // count(*)) AS BIGINT) AS percent FROM orders GROUP BY 1""")
def shard_progress(spark, sf_dir):
    shards = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4).cast("int").alias("shard"))
    sums = shards.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))
    return sums.withColumn("percent", metrics.percent(F.col("processed"), F.col("total")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    return scan.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark, sf_dir):
    return scan.offset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), "o_orderkey"], 3, 25)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey > 1000)")
def incremental_cursor_read(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return scan.since_cursor(rows, "o_orderdate", "o_orderkey", datetime(1997, 1, 1), 1000)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def time_range_read(spark, sf_dir):
    return scan.time_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", FROM, TO)


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderdate <= TIMESTAMP '1996-12-31'")
def lookup_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return scan.by_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", keys, "o_orderdate", TO)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def single_row_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice").limit(1)


@query("""SELECT o_orderkey, o_totalprice, c.n AS n_lines, c.last_line AS last_line FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1) c ON o_orderkey = l_orderkey""")
def nested_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    nested = snapshot.nested_children(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"], "lines")
    size = F.when(F.col("lines").isNotNull(), F.size("lines").cast("long"))
    return nested.select("o_orderkey", "o_totalprice", size.alias("n_lines"), F.element_at("lines", -1)["l_linenumber"].alias("last_line"))


# --- merge --------------------------------------------------------------------------------------------------------------

_UPSERT = f"WITH {fx.VERSIONS_SQL} SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM src UNION ALL SELECT * FROM tgt WHERE order_id NOT IN (SELECT o_orderkey FROM src)"


@query(_UPSERT)
def upsert_merge(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    return merge.upsert(target, fx.MAPPING.select(source), ["order_id"])


@query(f"WITH {fx.VERSIONS_SQL} SELECT * FROM tgt WHERE order_id NOT IN (SELECT o_orderkey FROM src WHERE o_orderkey % 3 = 0)")
def delete_by_key(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    return merge.delete(target, source.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("order_id")), ["order_id"])


@query(f"""WITH {fx.VERSIONS_SQL} SELECT coalesce(o_orderkey, order_id) AS order_id, customer_id, CASE WHEN o_orderkey IS NOT NULL THEN s.o_orderpriority ELSE t.o_orderpriority END AS o_orderpriority
FROM tgt t FULL OUTER JOIN (SELECT * FROM src WHERE o_orderkey % 2 = 0) s ON order_id = o_orderkey""")
def upsert_partial_columns(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    changes = source.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("order_id"), "o_orderpriority")
    return merge.upsert(target.select("order_id", "customer_id", "o_orderpriority"), changes, ["order_id"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_row_wins(spark, sf_dir):
    return merge.last_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 0, 'new', 1.0")
def row_crud(spark, sf_dir):
    rows = merge.update_where(table(spark, sf_dir, "customer"), "c_nationkey = 3", {"c_acctbal": 0.0})
    rows = merge.delete_where(rows, "c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name", "c_acctbal")
    return merge.insert(rows, spark.createDataFrame([(0, "new", 1.0)], "c_custkey long, c_name string, c_acctbal double"))


# --- change log ---------------------------------------------------------------------------------------------------------


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = fx.log(spark, sf_dir)
    tx = fx.transactions(ops)
    prepared = changelog.resolve_prepared(fx.prepares(tx), fx.outcomes(tx)).select("txn", "commit_pos", F.lit(True).alias("prepared"))
    ended = fx.commits(tx).withColumn("prepared", F.lit(False)).unionByName(prepared)
    return changelog.visible(ops, ended)


@query(f"WITH {fx.LOG_SQL} SELECT k, v, pos, commit_pos FROM ranked WHERE rn = 1 AND op <> 'delete'")
def changelog_latest_state(spark, sf_dir):
    return changelog.latest_state(_visible(spark, sf_dir), ["k"], changelog.ORDER).select("k", "v", "pos", "commit_pos")


@query(f"""WITH {fx.LOG_SQL}, u AS (SELECT *, max(commit_pos) OVER (PARTITION BY txn) AS cp FROM vis)
SELECT k, v, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cp DESC, (kind = 'xa_commit') DESC, txn DESC, (op = 'delete') DESC, pos DESC) AS r FROM u) WHERE r = 1 AND op <> 'delete'""")
def changelog_upserts_first(spark, sf_dir):
    return changelog.latest_upserts_first(_visible(spark, sf_dir), ["k"], changelog.ORDER).select("k", "v", "pos")


@query(f"WITH {fx.LOG_SQL} SELECT pos, txn, k, op, commit_pos FROM vis WHERE kind = 'plain'")
def changelog_txn_visible(spark, sf_dir):
    ops = fx.log(spark, sf_dir)
    return changelog.assemble(ops, fx.commits(fx.transactions(ops))).select("pos", "txn", "k", "op", "commit_pos")


@query(f"""WITH {fx.LOG_SQL} SELECT txn, '1:' || lower(hex('trx_' || lpad(CAST(txn AS VARCHAR), 6, '0'))) || ':' AS xid, CASE WHEN kind = 'xa_commit' THEN last_pos + 50 END AS commit_pos,
CASE kind WHEN 'xa_commit' THEN 'commit' WHEN 'xa_rollback' THEN 'rollback' ELSE 'pending' END AS outcome FROM tx WHERE kind <> 'plain'""")
def changelog_xa_resolve(spark, sf_dir):
    tx = fx.transactions(fx.log(spark, sf_dir))
    return changelog.resolve_prepared(fx.prepares(tx), fx.outcomes(tx))


@query(f"WITH {fx.LOG_SQL} SELECT lg.pos, lg.txn, lg.op FROM lg JOIN tx USING (txn) WHERE kind = 'xa_pending'")
def changelog_xa_pending(spark, sf_dir):
    ops = fx.log(spark, sf_dir)
    tx = fx.transactions(ops)
    pending = changelog.resolve_prepared(fx.prepares(tx), fx.outcomes(tx)).where("outcome = 'pending'").select("txn")
    return ops.join(pending, "txn", "left_semi").select("pos", "txn", "op")


@query(f"WITH {fx.LOG_SQL} SELECT '1:' || lower(hex('trx_' || lpad(CAST(txn AS VARCHAR), 6, '0'))) || ':' AS xid, 'commit' AS action, last_pos + 50 AS pos FROM tx WHERE kind = 'xa_commit' AND txn % 33 = 0")
def changelog_xa_orphans(spark, sf_dir):
    tx = fx.transactions(fx.log(spark, sf_dir))
    return changelog.orphans(fx.prepares(tx.where("txn % 33 <> 0")), fx.outcomes(tx)).select("xid", "action", "pos")


@query(f"""WITH {fx.LOG_SQL}, part AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_pos DESC, (kind = 'xa_commit') DESC, pos DESC) AS r FROM vis WHERE commit_pos > 1000 AND commit_pos <= 5000)
SELECT k, v, op, commit_pos FROM part WHERE r = 1""")
def changelog_bounded_replay(spark, sf_dir):
    ops = changelog.between(_visible(spark, sf_dir), 1000, 5000)
    return changelog.latest_state(ops, ["k"], changelog.ORDER, F.lit(False)).select("k", "v", "op", "commit_pos")


@query(f"WITH {fx.LOG_SQL} SELECT k, v FROM ranked WHERE rn = 1 AND op <> 'delete'")
def snapshot_then_replay(spark, sf_dir):
    ops = _visible(spark, sf_dir)
    first = changelog.latest_state(changelog.between(ops, stop=3000), ["k"], changelog.ORDER).select("k", "v")
    return replay.hand_over(first, ops, ["k"], changelog.ORDER, 2000)


@query(f"""WITH {fx.LOG_SQL}, part AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_pos DESC, (kind = 'xa_commit') DESC, pos DESC) AS r FROM vis WHERE commit_pos <= 6000)
SELECT k, v FROM part WHERE r = 1 AND op <> 'delete'""")
def onboard_table(spark, sf_dir):
    ops = _visible(spark, sf_dir)
    first = changelog.latest_state(changelog.between(ops, stop=3000), ["k"], changelog.ORDER).select("k", "v")
    return replay.onboard(first, ops, ["k"], changelog.ORDER, 2500, 6000)


@query(f"WITH {fx.LOG_SQL} SELECT k, v FROM ranked WHERE rn = 1 AND op <> 'delete'")
def changelog_stream_state(spark, sf_dir):
    """The raw log in three micro-batches, the second run twice, with open transactions carried between them."""
    job = replay.TransactionalReplay(spark, work_folder(spark), ["k"], "k long, v double")
    raw = fx.raw_log(spark, sf_dir)
    low, high = F.col("pos") > 3000, F.col("pos") > 7000
    for number, part in ((0, ~low), (1, low & ~high), (1, low & ~high), (2, high)):
        job.batch(raw.where(part), number)
    return job.state()


@query(f"WITH {fx.LOG_SQL} SELECT k, v FROM ranked WHERE rn = 1 AND op <> 'delete'")
def apply_log(spark, sf_dir):
    ops = _visible(spark, sf_dir)
    return merge.apply_log(merge.create_like(spark, ops.select("k", "v")), ops, ["k"], changelog.ORDER)


@query(f"WITH {fx.LOG_SQL} SELECT count(*) FILTER (WHERE op = 'insert') AS inserts, count(*) FILTER (WHERE op = 'update') AS updates, count(*) FILTER (WHERE op = 'delete') AS deletes FROM lg")
def op_counters(spark, sf_dir):
    return changelog.counters(fx.log(spark, sf_dir))


@query(f"""WITH {fx.LOG_SQL} SELECT pos, 'delete' AS op, k FROM lg WHERE op = 'delete' UNION ALL SELECT pos, 'delete', k FROM lg WHERE op = 'update' AND pos % 10 = 0
UNION ALL SELECT pos, op, CASE WHEN op = 'update' AND pos % 10 = 0 THEN k + 1000000 ELSE k END FROM lg WHERE op <> 'delete'""")
def changelog_key_changes(spark, sf_dir):
    moved = F.when((F.col("op") == "update") & (F.col("pos") % 10 == 0), F.col("k") + 1000000).otherwise(F.col("k"))
    changes = fx.log(spark, sf_dir).select("pos", "op", F.struct("k", "v").alias("before"), F.struct(moved.alias("k"), "v").alias("after"))
    return changelog.split_key_changes(changes, "k", ["k", "v"]).select("pos", "op", "k")


@query("SELECT 'binlog.' || lpad(CAST(event_id // 1000 AS VARCHAR), 6, '0') AS file, event_id % 1000 AS pos FROM events ORDER BY event_id DESC LIMIT 1")
def log_high_water(spark, sf_dir):
    number = F.floor(F.col("event_id") / 1000).cast("string")
    return changelog.high_water(table(spark, sf_dir, "events").select(F.concat(F.lit("binlog."), F.lpad(number, 6, "0")).alias("file"), (F.col("event_id") % 1000).alias("pos")))


@query(f"WITH {fx.LOG_SQL} SELECT txn, '1:' || lower(hex('trx_' || lpad(CAST(txn AS VARCHAR), 6, '0'))) || ':' AS key, lower(hex('trx_' || lpad(CAST(txn AS VARCHAR), 6, '0'))) || ':' AS suffix FROM tx")
def xid_parse(spark, sf_dir):
    tx = fx.transactions(fx.log(spark, sf_dir))
    key = xid_key(F.concat(F.lit("trx_"), F.lpad(F.col("txn").cast("string"), 6, "0")))
    return tx.select("txn", key.alias("key"), key_suffix(key).alias("suffix"))


@query(f"""WITH {fx.LOG_SQL}, routed AS (SELECT pos, op, k, 'copy_' || (k % 4) AS target_table FROM lg WHERE k % 4 IN (0, 2))
SELECT target_table, k, max_by(op, pos) AS op, max(pos) AS pos FROM routed GROUP BY ALL""")
def changelog_tables(spark, sf_dir):
    """One log of several tables: operations of active mappings, the last of each key of each target table."""
    log = fx.log(spark, sf_dir).withColumn("table_id", F.col("k") % 4)
    mappings = spark.createDataFrame([(0, "copy_0", True), (1, "copy_1", False), (2, "copy_2", True)], "table_id long, target_table string, active boolean")
    return merge.last_per_key(changelog.of_tables(log, mappings)[0], ["target_table", "k"], ["pos"]).select("target_table", "k", "op", "pos")


@query(f"WITH {fx.LOG_SQL} SELECT k % 4 AS table_id, count(*) AS n FROM lg WHERE k % 4 = 3 GROUP BY ALL")
def changelog_unknown_tables(spark, sf_dir):
    log = fx.log(spark, sf_dir).withColumn("table_id", F.col("k") % 4)
    mappings = spark.createDataFrame([(0, "copy_0", True), (1, "copy_1", False), (2, "copy_2", True)], "table_id long, target_table string, active boolean")
    return changelog.of_tables(log, mappings)[1].groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.METRICS_SQL} SELECT id, created_at, event_type FROM m WHERE task_id = 3 AND created_at >= (SELECT min(created_at) + INTERVAL 1 HOUR FROM m) AND created_at <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM m)")
def task_log_range(spark, sf_dir):
    log = fx.metrics_log(spark, sf_dir)
    low, high = log.agg(F.min("created_at") + F.expr("INTERVAL 1 HOUR"), F.max("created_at") - F.expr("INTERVAL 1 HOUR")).first()
    return metrics.of_task(log, 3, low, high).select("id", "created_at", "event_type")


@query("""WITH j AS (SELECT o_orderpriority AS job, CASE WHEN o_orderpriority LIKE '5%' THEN 0 ELSE count(*) END AS total_rows, count_if(o_orderstatus <> 'O') + CASE WHEN o_orderpriority LIKE '1%' THEN count(*) ELSE 0 END AS done,
count_if(o_orderkey % 7 = 0) AS d, count_if(o_orderkey % 14 = 0) AS r FROM orders GROUP BY 1)
SELECT job, total_rows, 10 + done AS processed_rows, 1 + d AS diff_rows, r AS repaired_rows, CASE WHEN total_rows > 0 THEN least(99.9, (10 + done) * 100.0::DOUBLE / total_rows) ELSE 12.5 END AS progress_percent FROM j""")
def job_progress(spark, sf_dir):
    """Counters of jobs after many increments, percent capped while they run."""
    orders = table(spark, sf_dir, "orders").withColumn("job", F.col("o_orderpriority"))
    total = F.when(F.col("job").startswith("5"), F.lit(0)).otherwise(F.count(F.lit(1)))
    jobs = orders.groupBy("job").agg(total.alias("total_rows")).select("job", "total_rows", F.lit(10).cast("long").alias("processed_rows"), F.lit(1).cast("long").alias("diff_rows"), F.lit(0).cast("long").alias("repaired_rows"), F.lit(12.5).alias("progress_percent"))
    done = (F.col("o_orderstatus") != "O").cast("long") + F.col("job").startswith("1").cast("long")
    more = orders.select("job", done.alias("processed"), (F.col("o_orderkey") % 7 == 0).cast("long").alias("diffs"), (F.col("o_orderkey") % 14 == 0).cast("long").alias("repaired"))
    return metrics.bump(jobs, "job", more)


@query("SELECT count_if(c_acctbal > 0) AS positive, count_if(c_mktsegment = 'BUILDING') AS building FROM customer")
def live_counts(spark, sf_dir):
    return metrics.live_counts(table(spark, sf_dir, "customer"), positive="c_acctbal > 0", building="c_mktsegment = 'BUILDING'")


@query(f"WITH {fx.VERSIONS_SQL} SELECT o_orderkey, o_custkey FROM src WHERE coalesce(o_orderpriority, '') = ''")
def unset_rows(spark, sf_dir):
    return scan.unset(fx.versions(spark, sf_dir)[0], "o_orderpriority").select("o_orderkey", "o_custkey")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || '.25' END AS shown, event_type AS raw FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)""")
def display_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shown = F.date_trunc("second", "ts") + F.when(F.col("event_id") % 3 == 0, F.expr("INTERVAL 0 SECOND")).otherwise(F.expr("INTERVAL 0.25 SECOND"))
    rows = events.select("event_id", shown.alias("t"), F.col("event_type").cast("binary").alias("b"))
    return rows.select("event_id", canon.display(F.col("t"), rows.schema["t"].dataType).alias("shown"), canon.display(F.col("b"), rows.schema["b"].dataType).alias("raw"))


# --- comparison and repair ----------------------------------------------------------------------------------------------


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(*fx.versions(spark, sf_dir), fx.MAPPING)


for _kind in compare.KINDS:

    def _of_kind(spark, sf_dir, kind=_kind):
        return _diffs(spark, sf_dir).where(F.col("diff_type") == kind).select("source_pk", "target_pk", "diff_type")

    _of_kind.__name__ = f"compare_{_kind}"
    query(f"WITH {fx.JOINED_SQL} SELECT source_pk, target_pk, diff_type FROM diff WHERE diff_type = '{_kind}'")(_of_kind)


@query(f"WITH {fx.JOINED_SQL} SELECT diff_type, count(*) AS n FROM diff WHERE diff_type IS NOT NULL GROUP BY 1")
def compare_summary(spark, sf_dir):
    return compare.summary(_diffs(spark, sf_dir))


@query(f"""WITH {fx.JOINED_SQL} SELECT source_pk, target_pk, diff_type FROM diff WHERE diff_type IN ('missing_target', 'mismatch') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
UNION ALL SELECT NULL, order_id, 'missing_source' FROM tgt WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
AND order_id NOT IN (SELECT o_orderkey FROM src WHERE o_orderdate <= TIMESTAMP '1996-12-31')""")
def compare_time_bounded(spark, sf_dir):
    return compare.compare_bounded(*fx.versions(spark, sf_dir), fx.MAPPING, "o_orderdate", FROM, TO).select("source_pk", "target_pk", "diff_type")


@query(f"""WITH {fx.JOINED_SQL}, mis AS (SELECT * FROM diff WHERE diff_type = 'mismatch')
SELECT source_pk AS key, 'order_id' AS "column", true AS equal FROM mis UNION ALL SELECT source_pk, 'customer_id', o_custkey IS NOT DISTINCT FROM customer_id FROM mis
UNION ALL SELECT source_pk, 'o_orderstatus', o_orderstatus IS NOT DISTINCT FROM t_status FROM mis UNION ALL SELECT source_pk, 'o_totalprice', o_totalprice IS NOT DISTINCT FROM t_price FROM mis
UNION ALL SELECT source_pk, 'o_orderdate', o_orderdate IS NOT DISTINCT FROM t_date FROM mis UNION ALL SELECT source_pk, 'o_orderpriority', o_orderpriority IS NOT DISTINCT FROM t_priority FROM mis""")
def compare_fields(spark, sf_dir):
    return compare.field_values(*fx.versions(spark, sf_dir), fx.MAPPING).select("key", "column", "equal")


@query(f"""WITH {fx.JOINED_SQL} SELECT source_pk, concat_ws(', ', CASE WHEN o_custkey IS DISTINCT FROM customer_id THEN 'customer_id' END, CASE WHEN o_orderstatus IS DISTINCT FROM t_status THEN 'o_orderstatus' END,
CASE WHEN o_totalprice IS DISTINCT FROM t_price THEN 'o_totalprice' END, CASE WHEN o_orderdate IS DISTINCT FROM t_date THEN 'o_orderdate' END,
CASE WHEN o_orderpriority IS DISTINCT FROM t_priority THEN 'o_orderpriority' END) AS message FROM diff WHERE diff_type = 'mismatch'""")
def compare_message(spark, sf_dir):
    return _diffs(spark, sf_dir).where("diff_type = 'mismatch'").select("source_pk", "message")


@query(f"WITH {fx.JOINED_SQL} SELECT sk AS key, diff_type IS NULL AS equal FROM diff WHERE sk IS NOT NULL AND tk IS NOT NULL")
def compare_hash(spark, sf_dir):
    return compare.compare_hashes(*fx.versions(spark, sf_dir), fx.MAPPING)


@query(f"WITH {fx.JOINED_SQL} SELECT source_pk, target_pk, diff_type, o_totalprice AS source_price, t_price AS target_price FROM diff WHERE diff_type IS NOT NULL")
def compare_enriched(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    found = compare.enrich(compare.compare(source, target, fx.MAPPING), source, target, fx.MAPPING)
    return found.select("source_pk", "target_pk", "diff_type", F.col("source_row.o_totalprice").alias("source_price"), F.col("target_row.o_totalprice").alias("target_price"))


@query(f"""WITH {fx.JOINED_SQL} SELECT 'orders' AS source_table, diff_type, count(*) AS n FROM diff WHERE diff_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'customer', 'missing_target', count(*) FROM customer WHERE c_custkey % 10 = 0""")
def compare_tables(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    jobs = [(*fx.versions(spark, sf_dir), fx.MAPPING), (customer, customer.where("c_custkey % 10 <> 0"), TableMapping("customer", "customer", "c_custkey")), (customer, customer.limit(0), TableMapping("skipped", "skipped", "c_custkey"))]
    return compare.compare_tables(jobs, {"orders", "customer"}).groupBy("source_table", "diff_type").agg(F.count(F.lit(1)).alias("n"))


@query(_UPSERT)
def repair_apply(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    return repair.repair(compare.compare(source, target, fx.MAPPING), source, target, fx.MAPPING)[0]


@query(f"WITH {fx.JOINED_SQL} SELECT count_if(diff_type = 'missing_target') AS missing_target, count_if(diff_type = 'missing_source') AS missing_source, count_if(diff_type = 'mismatch') AS mismatch, count(*) AS diff_rows FROM diff WHERE diff_type IS NOT NULL")
def compare_recorded(spark, sf_dir):
    """Differences written once, and counted from what is stored."""
    source, target = fx.versions(spark, sf_dir)
    return compare.counted(compare.record(compare.compare(source, target, fx.MAPPING), work_folder(spark), 7))


@query(f"WITH {fx.JOINED_SQL} SELECT source_pk, target_pk, CASE WHEN diff_type = 'missing_source' OR source_pk % 5 = 0 THEN 'skipped' ELSE 'repaired' END AS status FROM diff WHERE diff_type IS NOT NULL")
def repair_skipped(spark, sf_dir):
    """The source has lost every fifth row since the comparison."""
    source, target = fx.versions(spark, sf_dir)
    return repair.repair(compare.compare(source, target, fx.MAPPING), source.where("o_orderkey % 5 <> 0"), target, fx.MAPPING)[1].select("source_pk", "target_pk", "status")


@query(f"WITH {fx.JOINED_SQL} SELECT source_pk, target_pk, diff_type FROM diff WHERE diff_type = 'missing_source'")
def compare_after_repair(spark, sf_dir):
    source, target = fx.versions(spark, sf_dir)
    repaired = repair.repair(compare.compare(source, target, fx.MAPPING), source, target, fx.MAPPING)[0]
    return compare.compare(source, repaired, fx.MAPPING).select("source_pk", "target_pk", "diff_type")


# --- canonical text -----------------------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS zoned, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'), '0') END AS spaced,
strftime(ts, '%Y-%m-%d') AS day_only FROM events""")
def canonical_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "event_id",
        canon.canonical_time(F.concat(F.replace(clock, F.lit(" "), F.lit("T")), F.lit("+08:00"))).alias("zoned"),
        canon.canonical_time(F.concat(F.lit(" "), clock, F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).alias("spaced"),
        canon.canonical_time(F.date_format("ts", "yyyy-MM-dd")).alias("day_only"),
    )


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_double, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_time, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS as_flag, CAST(o_custkey AS VARCHAR) AS as_decimal FROM orders")
def canonical_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("double").alias("d"), "o_orderdate", (F.col("o_orderkey") % 2 == 0).alias("b"), F.col("o_custkey").cast("decimal(20,4)").alias("n"))
    text = lambda c: canon.canonical(F.col(c), rows.schema[c].dataType)
    return rows.select("o_orderkey", text("d").alias("as_double"), text("o_orderdate").alias("as_time"), text("b").alias("as_flag"), text("n").alias("as_decimal"))


@query("SELECT p_partkey, 'varchar' AS base, CASE WHEN p_size > 25 THEN 'int' ELSE 'decimal' END AS number FROM part")
def base_types(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    sized = F.concat(F.lit(" VARCHAR("), F.col("p_size").cast("string"), F.lit(")"))
    number = F.when(F.col("p_size") > 25, F.lit("int(11) unsigned")).otherwise(F.lit("DECIMAL(10,2) UNSIGNED"))
    return rows.select("p_partkey", canon.base_type(sized).alias("base"), canon.base_type(number).alias("number"))


# --- metrics ------------------------------------------------------------------------------------------------------------


def _history_sql(unit: str) -> str:
    return f"""WITH {fx.METRICS_SQL} SELECT task_id, CAST(date_trunc('{unit}', created_at) AS TIMESTAMP) AS bucket, CAST(coalesce(max(k) FILTER (WHERE cdc), 0) AS BIGINT) AS delay_seconds,
coalesce(arg_max(rps, (created_at, id)) FILTER (WHERE cdc), 0.0) AS rows_per_second, CAST(coalesce(sum(k % 7) FILTER (WHERE cdc), 0) AS BIGINT) AS insert_rows, CAST(coalesce(sum(k % 5) FILTER (WHERE cdc), 0) AS BIGINT) AS update_rows,
CAST(coalesce(sum(k % 3) FILTER (WHERE cdc), 0) AS BIGINT) AS delete_rows, CAST(sum(CASE WHEN cdc THEN read_k ELSE k END) AS BIGINT) AS read_rows, CAST(sum(k) AS BIGINT) AS total_rows FROM n GROUP BY 1, 2"""


@query(_history_sql("minute"))
def metric_history_minute(spark, sf_dir):
    return metrics.history(fx.metrics_log(spark, sf_dir), "minute")


@query(_history_sql("hour"))
def metric_history_hour(spark, sf_dir):
    return metrics.history(fx.metrics_log(spark, sf_dir), "hour")


@query(f"""WITH {fx.METRICS_SQL} SELECT id, task_id, greatest(k - coalesce(lag(k) OVER (PARTITION BY task_id ORDER BY created_at, id), 0), 0) AS total_rows_delta,
greatest(k - k % 7 - k % 5 - k % 3, 0) AS read_rows FROM n WHERE cdc""")
def metric_deltas(spark, sf_dir):
    rows = metrics.with_detail(fx.metrics_log(spark, sf_dir).where("event_type = 'cdc_metrics'")).drop("read_rows")
    found = metrics.deltas(rows, ["task_id"], ["created_at", "id"], ["total_rows"])
    return found.select("id", "task_id", "total_rows_delta", metrics.read_rows(F.col("total_rows"), F.col("insert_rows"), F.col("update_rows"), F.col("delete_rows")).alias("read_rows"))


@query("""WITH t AS (SELECT o_custkey % 7 AS id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT CAST(sum(done) AS BIGINT) AS processed, CAST(sum(total) AS BIGINT) AS total, least(100.0, CAST(CAST(sum(done) AS DOUBLE) * 100.0 / sum(total) AS DOUBLE)) AS percent FROM t""")
def progress_overall(spark, sf_dir):
    tables = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))
    return metrics.progress(tables.withColumn("sync_state", F.lit("active"))).select("processed", "total", F.col("percent").cast("double").alias("percent"))


@query("""SELECT event_id, CASE WHEN d > 5 THEN 'catching_up' ELSE 'cdc_running' END AS state, d AS delay, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) / (event_id % 10) END AS rate
FROM (SELECT event_id, greatest(event_id % 20 - 8, 0) AS d FROM events)""")
def delay_and_state(spark, sf_dir):
    now = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 20 - 8).cast("decimal(18,6)"))
    delay = metrics.delay_seconds(now.cast("timestamp"), F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("delay", delay)
    return rows.select("event_id", metrics.runtime_state(F.col("delay")).alias("state"), "delay", metrics.throughput(F.col("event_id"), F.col("event_id") % 10).alias("rate"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'catching up' ELSE 'stopped' END AS label FROM orders")
def runtime_labels(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "catching_up").otherwise("unheard of")
    return table(spark, sf_dir, "orders").select("o_orderkey", runtime_label(status).alias("label"))


@query(f"WITH {fx.METRICS_SQL}, z AS (SELECT max(created_at) AS now FROM m) SELECT id, event_type FROM m, z WHERE NOT (event_type = 'cdc_metrics' AND created_at < now - INTERVAL 7 DAY)")
def metrics_retention(spark, sf_dir):
    log = fx.metrics_log(spark, sf_dir)
    now = log.agg(F.max("created_at").alias("now"))  # one row
    return metrics.retained(log.join(F.broadcast(now)), F.col("now"), 7).select("id", "event_type")


@query(f"WITH {fx.METRICS_SQL} SELECT CAST(greatest(1, max(k)) AS BIGINT) AS total_rows, greatest(1.0, max(rps)) AS rows_per_second FROM n WHERE cdc")
def chart_maxima(spark, sf_dir):
    rows = metrics.with_detail(fx.metrics_log(spark, sf_dir).where("event_type = 'cdc_metrics'"))
    return metrics.chart_maxima(rows, ["total_rows", "rows_per_second"])


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min ' || (s % 60) || ' s' WHEN s < 86400 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' min'
ELSE (s // 86400) || ' d ' || (s % 86400 // 3600) || ' h' END AS duration, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000.0) || 'm' WHEN n >= 1000 THEN printf('%.1f', n / 1000.0) || 'k' ELSE CAST(n AS VARCHAR) END AS number
FROM (SELECT o_orderkey, o_orderkey * 37 AS s, o_orderkey * 1000 + 64 AS n FROM orders)""")
def shown_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", duration_text(F.col("o_orderkey") * 37).alias("duration"), compact_number(F.col("o_orderkey") * 1000 + 64).alias("number"))


# --- checks -------------------------------------------------------------------------------------------------------------


@query("""SELECT 'lineitem' AS name, count(*) AS "rows", (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS distinct_keys, CAST(0 AS BIGINT) AS null_keys,
count(*) = (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS "unique" FROM lineitem UNION ALL
SELECT 'orders', count(*), count(DISTINCT o_orderkey), 0, count(*) = count(DISTINCT o_orderkey) FROM orders""")
def pk_check(spark, sf_dir):
    a = precheck.key_check(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("name"), "*")
    return a.unionByName(precheck.key_check(table(spark, sf_dir, "orders"), ["o_orderkey"]).select(F.lit("orders").alias("name"), "*"))


@query("""SELECT * FROM (VALUES ('error', 'orders.o_orderkey', 'bigint does not fit string', 'type_mismatch', 'o_orderkey->o_orderkey'), ('warning', 'orders.o_custkey', 'bigint does not fit int', 'type_mismatch', 'o_custkey->o_custkey'),
('error', 'orders.o_orderdate', 'the target lacks a column', 'missing_target_field', '')) t(level, object, message, code, confirm_key)""")
def precheck_items(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    target = orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    return precheck.as_table(spark, precheck.schema_items(orders.schema, target.schema, "orders", "o_orderkey", {}, [], ["o_custkey->o_custkey"]))


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'PRI'), ('o_custkey', 'bigint', ''), ('o_orderstatus', 'string', ''), ('o_totalprice', 'double', ''), ('o_orderdate', 'timestamp_ntz', ''), ('o_orderpriority', 'string', '')) t(field, type, key)")
def describe_table(spark, sf_dir):
    return adhoc.describe(table(spark, sf_dir, "orders"), ["o_orderkey"])


# --- SQL pass-through ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_totalprice > 1500 AND o_orderstatus = 'O' GROUP BY 1")
def adhoc_sql(spark, sf_dir):
    sql = "SELECT o_orderpriority, count(*) AS n, sum(o_custkey) AS s FROM adhoc_orders WHERE o_totalprice > ? AND o_orderstatus = ? GROUP BY 1"
    return adhoc.query(spark, sql, [1500.0, "O"], {"adhoc_orders": table(spark, sf_dir, "orders")})


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice > 1500")
def adhoc_count(spark, sf_dir):
    return adhoc.total(adhoc.query(spark, "SELECT * FROM adhoc_orders WHERE o_totalprice > :least", {"least": 1500.0}, {"adhoc_orders": table(spark, sf_dir, "orders")}))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def adhoc_page(spark, sf_dir):
    return adhoc.page(adhoc.query(spark, "SELECT o_orderkey, o_totalprice FROM adhoc_orders ORDER BY o_totalprice DESC, o_orderkey", None, {"adhoc_orders": table(spark, sf_dir, "orders")}), 2, 10)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY c_name LIMIT 8")
def name_search(spark, sf_dir):
    return adhoc.matching(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "12")


PASS_THROUGH = {
    "join": "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "window": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "set_ops": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "anti_join": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
}
for _name, _text in PASS_THROUGH.items():

    def _passed(spark, sf_dir, text=_text):
        names = ("customer", "nation", "orders", "supplier")
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names if f"{{{n}}}" in text})

    _passed.__name__ = f"passthrough_{_name}"
    query(_text.format(customer="customer", nation="nation", orders="orders", supplier="supplier"))(_passed)
