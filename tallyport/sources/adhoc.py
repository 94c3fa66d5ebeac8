"""Named connections, table discovery, and SQL pass-through with bound parameters, totals and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Connections:
    """Names of loaders: a loader takes a table's name and gives its DataFrame."""

    def __init__(self):
        self._loaders: dict[str, tuple[Callable[[str], DataFrame], Callable[[], list[str]]]] = {}

    def add(self, name: str, load: Callable[[str], DataFrame], tables: Callable[[], list[str]] = list) -> None:
        if name in self._loaders:
            raise ValueError(f"{name} is there already")
        self._loaders[name] = (load, tables)

    def get(self, name: str) -> Callable[[str], DataFrame]:
        if name not in self._loaders:
            raise KeyError(f"no connection {name}")
        return self._loaders[name][0]

    def remove(self, name: str) -> None:
        self._loaders.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def tables(self, name: str) -> list[str]:
        return sorted(self._loaders[name][1]())

    def healthy(self) -> dict[str, bool]:
        found = {}
        for name, (_, tables) in self._loaders.items():
            try:
                tables()
                found[name] = True
            except Exception:
                found[name] = False
        return found


def query(spark: SparkSession, sql: str, params: list | dict | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Any Spark SQL, with positional (?) or named (:name) parameters; tables are views of this call."""
    for name, rows in (tables or {}).items():
        rows.createOrReplaceTempView(name)
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def page(rows: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """A page of a query; the order is the query's own, so it needs an ORDER BY over all that tells rows apart."""
    number, size = max(number, 1), size if size > 0 else 10
    return rows.offset((number - 1) * size).limit(size)


def paged(spark: SparkSession, sql: str, params: list | None = None, number: int = 1, size: int = 10) -> dict:
    """{data, total, page, page_size} of a query, as a service would return it: one page is collected."""
    rows = query(spark, sql, params)
    data = [r.asDict(recursive=True) for r in page(rows, number, size).collect()]
    return {"data": data, "total": total(rows).first()["total"], "page": max(number, 1), "page_size": size if size > 0 else 10}


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe(rows: DataFrame, key: list[str] = ()) -> DataFrame:
    """field, type, key of each column."""
    spark = rows.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), "PRI" if f.name in key else "") for f in rows.schema], "field string, type string, key string")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def matching(rows: DataFrame, column: str, text: str, most: int = 8) -> DataFrame:
    """The first rows whose column holds the text, whatever its case."""
    return rows.where(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column).limit(most)
