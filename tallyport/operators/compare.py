"""Comparison of two versions of a keyed table: one full outer join, classified row by row.

Keys are taken to be unique on each side (operators.precheck tells); of repeated keys each pair of rows is compared.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, mismatch_message, row_hash, same
from .mapping import TableMapping

KINDS = ("missing_target", "missing_source", "mismatch")


def _joined(source: DataFrame, target: DataFrame, mapping: TableMapping) -> DataFrame:
    """Rows `s` and `t`, structs of the compared columns under their target names; null where a side has no row."""
    pairs = mapping.pairs(source.columns, target.columns)
    s = source.select(F.col(mapping.key).alias("k"), F.struct(*[F.col(a).alias(b) for a, b in pairs]).alias("s"))
    t = target.select(F.col(mapping.target_key).alias("k"), F.struct(*[F.col(b) for _, b in pairs]).alias("t"))
    return s.join(t, "k", "full_outer")


def _differing(joined: DataFrame, mapping: TableMapping, canonical_text: bool | None) -> Column:
    """Names of the columns that differ, in column order."""
    s, t = joined.schema["s"].dataType, joined.schema["t"].dataType
    names = [n for n in s.names if n != mapping.target_key]
    tests = [F.when(~same(F.col("s")[n], s[n].dataType, F.col("t")[n], t[n].dataType, canonical_text), F.lit(n)) for n in names]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def compare(source: DataFrame, target: DataFrame, mapping: TableMapping, canonical_text: bool | None = None) -> DataFrame:
    """source_pk, target_pk, diff_type, columns, message of each difference. Rows that agree in all columns give none.

    Columns are compared by value and null-safe; by canonical text where their types differ or canonical_text is set.
    """
    joined = _joined(source, target, mapping)
    columns = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), _differing(joined, mapping, canonical_text)).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("t").isNull(), F.lit(KINDS[0])).when(F.col("s").isNull(), F.lit(KINDS[1])).when(F.size("columns") > 0, F.lit(KINDS[2]))
    found = joined.withColumn("columns", columns).withColumn("diff_type", kind).where(F.col("diff_type").isNotNull())
    return found.select(
        F.when(F.col("s").isNotNull(), F.col("k")).alias("source_pk"),
        F.when(F.col("t").isNotNull(), F.col("k")).alias("target_pk"),
        "diff_type",
        "columns",
        F.when(F.size("columns") > 0, mismatch_message(F.col("columns"))).otherwise(F.lit("")).alias("message"),
    )


def compare_bounded(source: DataFrame, target: DataFrame, mapping: TableMapping, cutoff: str, low=None, high=None) -> DataFrame:
    """compare() within a closed time range of the source's cutoff column, mapped for the target.

    Source rows of the range are matched with the whole target. Target rows of the range count as extra only if no source
    row up to the upper bound has their key.
    """
    mapped = mapping.target_of(cutoff)

    def within(rows: DataFrame, column: str, lower: bool) -> DataFrame:
        tests = ([F.col(column) >= F.lit(low)] if lower and low is not None else []) + ([F.col(column) <= F.lit(high)] if high is not None else [])
        return rows.where(reduce(and_, tests)) if tests else rows

    ahead = compare(within(source, cutoff, True), target, mapping).where(F.col("diff_type") != "missing_source")
    known = within(source, cutoff, False).select(F.col(mapping.key).alias(mapping.target_key))
    extra = within(target, mapped, True).join(known, mapping.target_key, "left_anti")
    none = F.array().cast("array<string>")
    extra = extra.select(F.lit(None).cast(ahead.schema["source_pk"].dataType).alias("source_pk"), F.col(mapping.target_key).alias("target_pk"), F.lit("missing_source").alias("diff_type"), none.alias("columns"), F.lit("").alias("message"))
    return ahead.unionByName(extra)


def compare_tables(jobs: list[tuple[DataFrame, DataFrame, TableMapping]], only: set[str] | None = None) -> DataFrame:
    """Differences of several tables, with source_table; keys as text. `only` names the source tables to compare."""
    parts = []
    for source, target, mapping in jobs:
        if only is None or mapping.source_table in only:
            found = compare(source, target, mapping)
            parts.append(found.select(F.lit(mapping.source_table).alias("source_table"), F.col("source_pk").cast("string").alias("source_pk"), F.col("target_pk").cast("string").alias("target_pk"), "diff_type", "message"))
    if not parts:
        raise ValueError("no table to compare")
    return reduce(DataFrame.unionByName, parts)


def record(diffs: DataFrame, path: str, job: int) -> DataFrame:
    """Differences stored below path as those of a job, over what an earlier run of the job has left, and read again: what is repaired or
    counted later is what was found, without another comparison."""
    diffs.write.mode("overwrite").parquet(f"{path.rstrip('/')}/job={job}")
    return diffs.sparkSession.read.schema(diffs.schema).parquet(f"{path.rstrip('/')}/job={job}")


def counted(diffs: DataFrame) -> DataFrame:
    """One row: how many differences of each kind, and all."""
    return diffs.agg(*[F.count_if(F.col("diff_type") == kind).alias(kind) for kind in KINDS], F.count(F.lit(1)).alias("diff_rows"))


def summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("diff_type").agg(F.count(F.lit(1)).alias("n"))


def field_values(source: DataFrame, target: DataFrame, mapping: TableMapping) -> DataFrame:
    """key, column, source_value, target_value, equal for each compared column of rows that both sides have and that differ."""
    joined = _joined(source, target, mapping).where(F.col("s").isNotNull() & F.col("t").isNotNull())
    # typed tests first: text is made of the rows that differ, not of all
    joined = joined.where(F.size(_differing(joined, mapping, None)) > 0)
    s, t = joined.schema["s"].dataType, joined.schema["t"].dataType
    cells = []
    for n in s.names:
        a, b = F.col("s")[n], F.col("t")[n]
        cells.append(F.struct(F.lit(n).alias("column"), canonical(a, s[n].dataType).alias("source_value"), canonical(b, t[n].dataType).alias("target_value"), same(a, s[n].dataType, b, t[n].dataType).alias("equal")))
    cells = F.array(*cells)
    return joined.select(F.col("k").alias("key"), F.explode(cells).alias("c")).select("key", "c.*")


def hashes(rows: DataFrame, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """key, hash of each row; names: column -> name under which it is hashed."""
    names = names or {c: c for c in rows.columns}
    return rows.select(F.col(key).alias("key"), row_hash({n: (F.col(c), rows.schema[c].dataType) for c, n in names.items()}).alias("hash"))


def compare_hashes(source: DataFrame, target: DataFrame, mapping: TableMapping) -> DataFrame:
    """key, equal of the keys that both sides have, by row hash."""
    pairs = mapping.pairs(source.columns, target.columns)
    a = hashes(source.select(*[F.col(s).alias(t) for s, t in pairs]), mapping.target_key)
    b = hashes(target.select(*[t for _, t in pairs]), mapping.target_key)
    return a.join(b.withColumnRenamed("hash", "other"), "key").select("key", (F.col("hash") == F.col("other")).alias("equal"))


def enrich(diffs: DataFrame, source: DataFrame, target: DataFrame, mapping: TableMapping) -> DataFrame:
    """Differences with the rows of both sides as they are now."""
    s = source.select(F.col(mapping.key).alias("source_pk"), F.struct(*source.columns).alias("source_row"))
    t = target.select(F.col(mapping.target_key).alias("target_pk"), F.struct(*target.columns).alias("target_row"))
    key = F.coalesce("source_pk", "target_pk")
    base = diffs.withColumn("_key", key)
    joined = base.join(s.withColumnRenamed("source_pk", "_s"), F.col("_key") == F.col("_s"), "left").join(t.withColumnRenamed("target_pk", "_t"), F.col("_key") == F.col("_t"), "left")
    return joined.drop("_key", "_s", "_t")
