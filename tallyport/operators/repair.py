"""Repair of differences: rows that the source still has are written over the target; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import TableMapping
from .merge import upsert


def repair(diffs: DataFrame, source: DataFrame, target: DataFrame, mapping: TableMapping) -> tuple[DataFrame, DataFrame]:
    """(target after repair, differences with status repaired or skipped).

    missing_target and mismatch are repaired from the source as it is now; where it has lost the row, and for
    missing_source, the difference is skipped.
    """
    wanted = diffs.where(F.col("diff_type").isin("missing_target", "mismatch")).select("source_pk").distinct()
    rows = source.join(wanted, F.col(mapping.key) == F.col("source_pk"), "left_semi")
    repaired = upsert(target, mapping.select(rows, filtered=False), [mapping.target_key])
    have = source.select(F.col(mapping.key).alias("_have"), F.lit(True).alias("_there"))
    state = diffs.join(have, F.col("source_pk") == F.col("_have"), "left")
    done = F.col("diff_type").isin("missing_target", "mismatch") & F.col("_there")
    status = F.when(done, F.lit("repaired")).otherwise(F.lit("skipped"))
    return repaired, state.withColumn("status", status).drop("_have", "_there")
