"""Presentation of durations and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit and its name, the largest first; a text shows a unit and the one below it.
UNITS = ((86400, "d"), (3600, "h"), (60, "min"), (1, "s"))


def duration_text(seconds: Column) -> Column:
    """Two units at most: 59 s, 5 min 3 s, 2 h 0 min, 3 d 4 h; nothing below zero."""
    s = F.coalesce(seconds.cast("long"), F.lit(0))
    text = F.when(s <= 0, F.lit("0 s"))
    for (size, name), below in zip(UNITS, [*UNITS[1:], None], strict=True):
        shown = F.concat(F.floor(s / size).cast("string"), F.lit(f" {name}"))
        if below:
            shown = F.concat(shown, F.lit(" "), F.floor((s % size) / below[0]).cast("string"), F.lit(f" {below[1]}"))
        text = text.when(s >= size, shown)
    return text


def compact_number(value: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5m; smaller numbers whole."""
    v = F.coalesce(value.cast("long"), F.lit(0))
    tenth = lambda size: F.format_string("%.1f", v / F.lit(float(size)))
    return F.when(v >= 1_000_000, F.concat(tenth(1_000_000), F.lit("m"))).when(v >= 1000, F.concat(tenth(1000), F.lit("k"))).otherwise(v.cast("string"))
