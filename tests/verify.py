"""Runs registered queries against their SQL in DuckDB: python tests/verify.py [sf] [name ...]."""

import re
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, f, sql):
    df = f(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, len(ours[1]), "rows only"
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours == theirs:
        return True, len(ours[1]), ""
    return False, len(ours[1]), f"{ours[0]} {theirs[0]} {len(theirs[1])} " + repr([(a, b) for a, b in zip(ours[1], theirs[1], strict=False) if a != b][:2])[:600]


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if (name in sys.argv[2:]) if sys.argv[2:] else not re.match(r"op\d+_|pipeline", name):
            t = time.time()
            try:
                ok, n, said = compare(spark, con, sf_dir, name, f, sql.get(name))
            except Exception as e:
                ok, n, said = False, -1, str(e)[:500]
            print("ok  " if ok else "FAIL", name, n, round(time.time() - t, 1), said, flush=True)


if __name__ == "__main__":
    main()
