"""Reading parts of a keyed table: key ranges, time ranges, cursors, key lists, pages."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts into which keys are cut before the exact split points are sought.
PARTS = 64


def shard_count(rows: int, workers: int, batch: int) -> int:
    """One shard for a small table, else one a worker."""
    return 1 if rows < 2 * batch else max(1, workers)


def _number(key: Column, kind: T.DataType) -> Column:
    """A number that never falls while the key rises; of texts, their first seven bytes."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return key.cast("timestamp").cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else key


def shard_bounds(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """shard, low, high, n: key ranges (low, high] that hold equal numbers of rows; null is open.

    Split points are exact. Approximate quantiles (a bounded row of numbers) cut the keys into PARTS; parts are counted, and
    only the few that hold a split point are sorted, each in a task of its own.
    """
    kind = rows.schema[key].dataType
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), _number(F.col(key), kind).alias("p"))
    none = F.lit(None).cast(kind)
    if shards < 2:
        return keys.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("shard"), none.alias("low"), none.alias("high"), "n")
    edges = keys.agg(F.percentile_approx("p", [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    part = reduce(add, [(F.col("p") > F.lit(e)).cast("int") for e in sorted(set(edges))], F.lit(0))
    keys = keys.select("k", part.alias("part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over PARTS rows at most
    sizes = keys.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("size").over(ahead), F.lit(0)), "all": F.sum("size").over(Window.partitionBy())})
    cuts = sizes.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))).withColumn("at", F.floor(F.col("all") * F.col("cut") / shards) + 1)
    cuts = cuts.where((F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("size")))
    ranked = keys.join(cuts.select("part").distinct(), "part", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("k")))
    points = ranked.join(cuts, "part").where(F.col("rank") == F.col("at") - F.col("before")).select("cut", "k", "at", "all")
    points = points.agg(F.sort_array(F.collect_list(F.struct("cut", "k", "at", "all"))).alias("p"))
    each = points.select("p", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("shard"))
    low, high = F.get("p", F.col("shard") - 1), F.get("p", F.col("shard"))
    end = F.coalesce(high["at"], F.get("p", F.lit(0))["all"])
    return each.select("shard", low["k"].alias("low"), high["k"].alias("high"), (end - F.coalesce(low["at"], F.lit(0))).cast("long").alias("n"))


def key_range(rows: DataFrame, key: str, low=None, high=None, where: str = "") -> DataFrame:
    """Rows with low < key <= high, and the free condition; both are pushed to the scan."""
    if low is not None:
        rows = rows.where(F.col(key) > low)
    if high is not None:
        rows = rows.where(F.col(key) <= high)
    return rows.where(where) if where else rows


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    return key_range(rows, key, after).orderBy(key).limit(size)


def offset_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page by number; page and size below one mean 1 and 10. The order must be total."""
    page, size = max(page, 1), size if size > 0 else 10
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def since_cursor(rows: DataFrame, cursor: str, key: str, at, at_key) -> DataFrame:
    """Rows behind (at, at_key) in order of cursor and key."""
    return rows.where((F.col(cursor) > F.lit(at)) | ((F.col(cursor) == F.lit(at)) & (F.col(key) > F.lit(at_key))))


def time_range(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with low <= column <= high."""
    if low is not None:
        rows = rows.where(F.col(column) >= F.lit(low))
    return rows if high is None else rows.where(F.col(column) <= F.lit(high))


def by_keys(rows: DataFrame, key: str, keys: DataFrame, column: str | None = None, until=None) -> DataFrame:
    """Rows whose key is among keys, each once, up to a time where one is given. The planner broadcasts keys if they are few."""
    wanted = keys.where(F.col(keys.columns[0]).isNotNull() & (F.col(keys.columns[0]).cast("string") != "")).select(F.col(keys.columns[0]).alias("_k")).distinct()
    found = rows.join(wanted, F.col(key) == F.col("_k"), "left_semi")
    return found if column is None or until is None else found.where(F.col(column) <= F.lit(until))


def unset(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text column is null or empty."""
    return rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "")


def sql_literal(value) -> str:
    """A value as a literal of standard SQL: text is quoted with its quotes doubled, times by their type."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float | Decimal):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal of {type(value).__name__}")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: list | None = None, where: str = "", properties: dict | None = None) -> DataFrame:
    """A table of a database; bounds are the split points of its key, each range one partition with its condition pushed down.

    key and where are SQL of the database and stand in its conditions as they are, so neither may come from outside."""
    properties = properties or {}
    if not (key and bounds):
        found = spark.read.jdbc(url, name, properties=properties)
        return found.where(where) if where else found
    lows, highs = [None, *bounds], [*bounds, None]
    ranges = []
    for low, high in zip(lows, highs, strict=True):
        below = [] if high is None else [f"{key} <= {sql_literal(high)}"]
        tests = [f"{key} > {sql_literal(low)}", *below] if low is not None else [f"({key} IS NULL OR {below[0]})"]
        ranges.append(" AND ".join([*tests, *([f"({where})"] if where else [])]))
    return spark.read.jdbc(url, name, predicates=ranges, properties=properties)


def time_like_columns(rows: DataFrame) -> list[str]:
    """Columns whose type or name speaks of time; the first is the default for cutoffs."""
    return [f.name for f in rows.schema if any(w in f.dataType.simpleString() or w in f.name.lower() for w in ("time", "date"))]
