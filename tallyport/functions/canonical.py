"""Canonical text of values, for comparing columns whose types differ, and row hashes.

All are column expressions chosen from the column's type when the plan is made; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The text that stands for NULL, and the most column names that a mismatch message lists.
NULL_TEXT = "<NULL>"
LISTED = 8

_CLOCK = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?$"
_ZONED = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:Z|[+-]\d{2}:\d{2})$"


def clock_text(second: Column, fraction: Column) -> Column:
    """Seconds text and a fraction cut to microseconds, without trailing zeros."""
    short = F.rtrim(F.translate(F.substring(fraction, 1, 6), "0", " "))
    kept = F.substring(fraction, F.lit(1), F.length(short))
    return F.when(F.length(short) > 0, F.concat(second, F.lit("."), kept)).otherwise(second)


def canonical_time(text: Column) -> Column:
    """Time-like text as its own wall-clock `YYYY-MM-DD HH:MM:SS[.ffffff]`; other text as it is.

    A pattern decides before any parsing, so dates, years and times alone stay text. An offset is dropped, not applied.
    """
    trimmed = F.trim(text)

    def read(pattern: str) -> Column:
        part = lambda k: F.regexp_extract(trimmed, pattern, k)
        second = F.concat_ws(" ", part(1), part(2))
        real = F.try_to_timestamp(second, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
        return F.when(trimmed.rlike(pattern) & real, clock_text(second, part(3)))

    return F.coalesce(read(_CLOCK), read(_ZONED), text)


def _plain_number(x: Column) -> Column:
    """A double in plain decimal digits, as short as reads back the same."""
    exact = F.regexp_replace(F.regexp_replace(F.expr("cast(null as string)") if x is None else x.cast("string").try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = x.try_cast("decimal(38,0)").cast("string")
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf")).when(F.abs(x) >= 1e18, F.coalesce(whole, x.cast("string"))).otherwise(F.when(x == 0, F.lit("0")).otherwise(exact))


def canonical(value: Column, kind: T.DataType, strict_decimal: bool = False) -> Column:
    """Canonical text; NULL stays NULL. strict_decimal keeps the scale of decimals (1.0 is not 1.00)."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("1")).when(~value, F.lit("0"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _plain_number(value.cast("double") if isinstance(kind, T.DoubleType) else value.cast("string").cast("double"))
    if isinstance(kind, T.DecimalType):
        text = value.cast("string")
        if strict_decimal or not kind.scale:
            return text
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        stamp = value.cast("timestamp_ntz")
        return clock_text(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.date_format(stamp, "SSSSSS"))
    if isinstance(kind, (T.StringType, T.BinaryType, T.VarcharType, T.CharType)):
        return canonical_time(value.cast("string"))
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    return F.to_json(F.struct(value.alias("v")))


def same(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType, canonical_text: bool | None = None) -> Column:
    """Null-safe equality: of values where both types are the same, of canonical text where they differ or it is asked for."""
    if canonical_text or (canonical_text is None and a_kind != b_kind):
        return canonical(a, a_kind).eqNullSafe(canonical(b, b_kind))
    return a.eqNullSafe(b)


def display(value: Column, kind: T.DataType) -> Column:
    """A value as it is shown: times with as many digits of the second as they have, bytes as text, others as they are."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        digits = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.when(digits.endswith(".000000"), F.substring(digits, 1, 19)).otherwise(F.rtrim(digits, F.lit("0")))
    return value.cast("string") if isinstance(kind, T.BinaryType) else value


def row_hash(columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """SHA-256 over the canonical texts in order of column name, NULL as its text."""
    parts = [F.coalesce(canonical(c, kind), F.lit(NULL_TEXT)).alias(name) for name, (c, kind) in sorted(columns.items())]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def mismatch_message(names: Column) -> Column:
    """Names of differing columns; beyond eight, the first eight and how many there are."""
    shown = F.array_join(F.slice(names, 1, LISTED), ", ")
    return F.when(F.size(names) > LISTED, F.concat(shown, F.lit(" ... ("), F.size(names).cast("string"), F.lit(" columns)"))).otherwise(shown)


def base_type(name: Column) -> Column:
    """Type name without length, precision, scale and sign: int(11) unsigned is int."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\(.*$", ""), r" unsigned.*$", ""))
