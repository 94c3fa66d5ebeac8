"""Snapshot copy: mapped projection, optional key ranges, keyed merge into the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import TableMapping
from ..operators.merge import create_like, last_per_key, upsert
from .scan import key_range


def snapshot(source: DataFrame, mapping: TableMapping, target: DataFrame | None = None, low=None, high=None, order: list[str] | None = None) -> DataFrame:
    """The target after a copy of the source's rows in (low, high]. Rows that the source has lost stay.

    order, where keys repeat in the source, says which row is the last and wins.
    """
    rows = key_range(source, mapping.key, low, high, mapping.custom_where)
    if order:
        rows = last_per_key(rows, [mapping.key], order)
    rows = mapping.select(rows, filtered=False)
    if target is None:
        target = create_like(source.sparkSession, rows)
    return upsert(target, rows, [mapping.target_key])


def nested_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, position: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, in order of position."""
    rest = [*position, *[c for c in children.columns if c not in (*position, child_key)]]
    grouped = children.groupBy(child_key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    return parents.join(grouped, parents[key] == grouped[child_key], "left").drop(child_key if child_key != key else "_none")
