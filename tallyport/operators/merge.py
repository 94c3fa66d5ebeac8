"""Keyed merge without a MERGE-capable catalog: joins with presence flags, and publication by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in `order`, which must be total. An aggregate, so tasks combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col("_last")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Target with changed rows written over and new rows added. Columns that changes lacks keep the target's value, NULLs that it has
    overwrite. changes has each key once (see last_per_key)."""
    new = changes.withColumn("_new", F.lit(True)).alias("n")
    old = target.alias("o")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    given = set(changes.columns)
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in given:
            out.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def delete(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return target.join(keys.select(*key), key, "left_anti")


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Plain append, columns by name."""
    return target.unionByName(rows, allowMissingColumns=True)


def update_where(target: DataFrame, condition: str, values: dict) -> DataFrame:
    hit = F.coalesce(F.expr(condition), F.lit(False))
    return target.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(target.schema[c].dataType) for c, v in values.items()})


def delete_where(target: DataFrame, condition: str) -> DataFrame:
    return target.where(~F.coalesce(F.expr(condition), F.lit(False)))


def apply_log(target: DataFrame, log: DataFrame, key: list[str], order: list[str], op: str = "op", upserts_first: bool = False) -> DataFrame:
    """Target after a change log whose rows have an op ('insert', 'update', 'delete') and a total order.

    In log order a key ends as its last row says. With upserts_first every delete of the log comes after all upserts.
    """
    columns = [c for c in log.columns if c in target.columns]
    if upserts_first:
        gone = log.where(F.col(op) == "delete").select(*key).distinct()
        kept = last_per_key(log.where(F.col(op) != "delete"), key, order).select(*columns)
        return delete(upsert(target, kept, key), gone, key)
    last = last_per_key(log, key, order)
    return upsert(delete(target, last.where(F.col(op) == "delete"), key), last.where(F.col(op) != "delete").select(*columns), key)


class VersionedTable:
    """Rows in numbered folders below a path; a small table names the current one, so readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self) -> tuple[int, str]:
        fs, p = self._fs(f"{self.path}/done")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max(((int(n.partition("-")[0]), n.partition("-")[2]) for n in names), default=(0, ""))

    def version(self) -> int:
        """Highest version that is complete; 0 before the first."""
        return self._done()[0]

    def tag(self) -> str:
        """What the current version was published with."""
        return self._done()[1]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version()}")

    def publish(self, rows: DataFrame, tag: str = "") -> int:
        """Write the next version, then mark it done, with its tag, in one step. A failed write leaves the current version as it is."""
        k = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{k}")
        fs, p = self._fs(f"{self.path}/done/{k}-{tag}" if tag else f"{self.path}/done/{k}")
        fs.create(p, True).close()
        return k


def create_like(spark: SparkSession, source: DataFrame) -> DataFrame:
    """An empty table of the source's schema."""
    return spark.createDataFrame([], source.schema)
