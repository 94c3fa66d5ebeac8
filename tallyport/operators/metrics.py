"""Metrics of runs: time buckets, deltas, progress, throughput, delay."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that carry metrics, and the names of the numbers in their detail text.
METRIC_EVENTS = ("cdc_metrics", "snapshot_completed", "table_snapshot_completed")
NUMBERS = ("delay_seconds", "rows_per_second", "insert_rows", "update_rows", "delete_rows", "read_rows", "total_rows")
DETAIL = "delay_seconds long, rows_per_second double, insert_rows long, update_rows long, delete_rows long, read_rows long, total_rows long"
HOURLY_ABOVE = timedelta(hours=48)
KEPT_DAYS = 30


def unit_for(start: datetime, stop: datetime) -> str:
    """Buckets of hours beyond 48 hours, else of minutes."""
    return "hour" if stop - start > HOURLY_ABOVE else "minute"


def with_detail(log: DataFrame) -> DataFrame:
    """The numbers of a log row's detail text; zeros where it can't be read."""
    read = F.from_json("detail", DETAIL)
    numbers = {n: F.coalesce(F.col("_d")[n], F.lit(0)) for n in NUMBERS}
    return log.withColumn("_d", read).withColumns(numbers).drop("_d")


def history(log: DataFrame, unit: str, start=None, stop=None, task=None, dedupe_snapshot: bool = False) -> DataFrame:
    """One row for each task and bucket that has events: largest delay, last rate, sums of rows. No empty buckets.

    Snapshot rows are reported by table and again by run; both count unless dedupe_snapshot leaves out the run's.
    """
    rows = log.where(F.col("event_type").isin(*[e for e in METRIC_EVENTS if not (dedupe_snapshot and e == "snapshot_completed")]))
    if task is not None:
        rows = rows.where(F.col("task_id") == task)
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start))
    if stop is not None:
        rows = rows.where(F.col("created_at") <= F.lit(stop))
    snapshot = F.col("event_type") != "cdc_metrics"
    rows = with_detail(rows).withColumns(
        {
            "bucket": F.date_trunc(unit, "created_at").cast("timestamp_ntz"),
            "read_rows": F.when(snapshot, F.col("rows_affected").cast("long")).otherwise(F.col("read_rows")),
            "total_rows": F.when(snapshot, F.col("rows_affected").cast("long")).otherwise(F.col("total_rows")),
        }
    )
    cdc = lambda c: F.when(F.col("event_type") == "cdc_metrics", F.col(c))
    sums = [F.coalesce(F.sum(cdc(c)), F.lit(0)).cast("long").alias(c) for c in ("insert_rows", "update_rows", "delete_rows")]
    last = F.max_by("rows_per_second", F.when(F.col("event_type") == "cdc_metrics", F.struct("created_at", "id")))
    return rows.groupBy("task_id", "bucket").agg(
        F.coalesce(F.max(cdc("delay_seconds")), F.lit(0)).cast("long").alias("delay_seconds"),
        F.coalesce(last, F.lit(0.0)).alias("rows_per_second"),
        *sums,
        F.coalesce(F.sum("read_rows"), F.lit(0)).cast("long").alias("read_rows"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).cast("long").alias("total_rows"),
    )


def history_stream(log: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows over a stream of the log, with a watermark."""
    rows = with_detail(log.where(F.col("event_type") == "cdc_metrics")).withWatermark("created_at", late)
    found = rows.groupBy("task_id", F.window("created_at", width)).agg(F.max("delay_seconds").alias("delay_seconds"), F.sum("total_rows").alias("total_rows"))
    return found.select("task_id", F.col("window.start").alias("bucket"), "delay_seconds", "total_rows")


def deltas(counters: DataFrame, partition: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Growth of running counters since the row before, 0 where a counter fell; the first row counts from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return counters.withColumns({f"{c}_delta": F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)) for c in columns})


def read_rows(total: Column, inserted: Column, updated: Column, deleted: Column) -> Column:
    return F.greatest(total - inserted - updated - deleted, F.lit(0))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, at most 100; 100 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(F.lit(100)).cast("long")


def progress(tables: DataFrame) -> DataFrame:
    """Overall progress of (processed, total, sync_state): done share of all rows, else 100 if all tables are active, else 0."""
    sums = tables.agg(F.sum("processed").alias("processed"), F.sum("total").alias("total"), F.bool_and(F.col("sync_state") == "active").alias("active"))
    share = F.least(F.lit(100.0), F.try_divide(F.col("processed") * F.lit(100.0), F.col("total")))
    return sums.select(F.col("processed").cast("long").alias("processed"), F.col("total").cast("long").alias("total"), F.when(F.col("total") > 0, share).when(F.col("active"), F.lit(100.0)).otherwise(F.lit(0.0)).alias("percent"))


def capped_percent(done: Column, total: Column, before: Column) -> Column:
    """Percent of work that still runs: never above 99.9; what it was before where there is no total."""
    return F.when(total > 0, F.least(F.lit(99.9), done * F.lit(100.0) / total)).otherwise(before.cast("double"))


def bump(jobs: DataFrame, key: str, increments: DataFrame) -> DataFrame:
    """Jobs (key, total_rows, processed_rows, diff_rows, repaired_rows, progress_percent) after increments (key, processed, diffs, repaired), of
    which a job may have any number."""
    sums = increments.groupBy(key).agg(*[F.sum(c).alias(f"_{c}") for c in ("processed", "diffs", "repaired")])
    more = lambda c, by: F.col(c) + F.coalesce(F.col(by), F.lit(0))
    found = jobs.join(sums, key, "left").withColumns({"processed_rows": more("processed_rows", "_processed"), "diff_rows": more("diff_rows", "_diffs"), "repaired_rows": more("repaired_rows", "_repaired")})
    percent = F.when(F.col("_processed").isNull(), F.col("progress_percent").cast("double")).otherwise(capped_percent(F.col("processed_rows"), F.col("total_rows"), F.col("progress_percent")))
    return found.withColumn("progress_percent", percent).select(*jobs.columns)


def of_task(log: DataFrame, task_id: int | None = None, low=None, high=None) -> DataFrame:
    """Log rows of a task (of all, without one) from low to high, both included."""
    rows = log if not task_id else log.where(F.col("task_id") == task_id)
    rows = rows if low is None else rows.where(F.col("created_at") >= F.lit(low))
    return rows if high is None else rows.where(F.col("created_at") <= F.lit(high))


def live_counts(rows: DataFrame, **conditions: str) -> DataFrame:
    """One row: how many rows hold each condition."""
    return rows.agg(*[F.count_if(F.expr(test)).alias(name) for name, test in conditions.items()])


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows a second, 0 without time."""
    return F.coalesce(F.try_divide(rows.cast("double"), seconds.cast("double")), F.lit(0.0))


def delay_seconds(now: Column, event: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(event), F.lit(0))


def runtime_state(delay: Column) -> Column:
    return F.when(delay > 5, F.lit("catching_up")).otherwise(F.lit("cdc_running"))


def retained(log: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """The log without metrics older than so many days."""
    old = F.col("event_type").isin("cdc_metrics") & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))
    return log.where(~old)


def chart_maxima(history: DataFrame, columns: list[str]) -> DataFrame:
    """Upper ends of chart axes: the largest value of each column, 1 at least."""
    return history.agg(*[F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1))).alias(c) for c in columns])
