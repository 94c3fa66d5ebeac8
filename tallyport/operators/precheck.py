"""Checks before a run: schemas on the driver, keys as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import IDENTIFIER

ITEM = "level string, object string, message string, code string, confirm_key string"
#: What a run may ask for.
BATCH, WORKERS = (100, 20_000), (0, 32)


def base(kind: T.DataType) -> str:
    return kind.simpleString().split("(")[0].strip().lower().removesuffix(" unsigned")


def key_check(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, distinct_keys, null_keys, unique: whether these columns can be a table's key."""
    known = [F.col(k).isNotNull() for k in key]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("whole", whole)
    found = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if("whole").alias("distinct_keys"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("n"))), F.lit(0)).alias("null_keys"))
    return found.withColumn("unique", (F.col("rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0))


def schema_items(source: T.StructType, target: T.StructType | None, table: str, key: str, fields: dict, ignored: list, confirmed: list = (), triggers: list = (), may_create: bool = True) -> list[tuple]:
    """Items (level, object, message, code, confirm_key) of one table's mapping."""
    items: list[tuple] = []
    say = lambda level, thing, text, code, confirm="": items.append((level, f"{table}.{thing}" if thing else table, text, code, confirm))
    for name in [table, key, *fields, *fields.values(), *ignored]:
        if not IDENTIFIER.match(name):
            say("error", name, "not a valid identifier", "invalid_name")
    names = source.names
    if key not in names:
        say("error", key, "the source lacks the key column", "missing_key")
    if key in ignored:
        say("error", key, "the key column is ignored", "key_ignored")
    for s, t in fields.items():
        if s not in names:
            say("error", s, "a mapped source field does not exist", "missing_source_field")
        if s in ignored:
            say("error", s, "an ignored field is mapped", "ignored_and_mapped")
    goes = [(s, fields.get(s) or s) for s in names if s not in ignored]
    for t in sorted({t for _, t in goes if sum(x == t for _, x in goes) > 1}):
        say("error", t, "two source fields go to one target field", "double_target")
    if target is None:
        if fields:
            say("error", "", "the target table is missing and can't be created with renamed fields", "missing_target_renamed")
        elif may_create:
            say("warning", "", "the target table is missing and will be created", "missing_target")
        else:
            say("error", "", "the target table is missing and may not be created", "missing_target")
    else:
        if (k := fields.get(key) or key) not in target.names:
            say("error", k, "the target lacks the key column", "missing_target_key")
        for s, t in goes:
            if t not in target.names:
                say("error", t, "the target lacks a column", "missing_target_field")
            elif base(source[s].dataType) != base(target[t].dataType):
                pair = f"{s}->{t}"
                level = "warning" if pair in confirmed else "error"
                say(level, t, f"{base(source[s].dataType)} does not fit {base(target[t].dataType)}", "type_mismatch", pair)
        for name in triggers:
            say("warning", name, "the target has a trigger", "target_trigger")
    if not any(level == "error" for level, *_ in items):
        say("success", "", "the mapping fits", "ok")
    return items


def limit_items(batch: int, workers: int) -> list[tuple]:
    """Batch size 0 or 100 to 20,000; 0 to 32 workers."""
    items = []
    if batch and not BATCH[0] <= batch <= BATCH[1]:
        items.append(("error", "batch_size", f"{batch} is neither 0 nor {BATCH[0]} to {BATCH[1]}", "batch_size", ""))
    if not WORKERS[0] <= workers <= WORKERS[1]:
        items.append(("error", "workers", f"{workers} is not {WORKERS[0]} to {WORKERS[1]}", "workers", ""))
    return items


def as_table(spark: SparkSession, items: list[tuple]) -> DataFrame:
    return spark.createDataFrame(items, ITEM)


def passed(items: list[tuple]) -> bool:
    return not any(level == "error" for level, *_ in items)
