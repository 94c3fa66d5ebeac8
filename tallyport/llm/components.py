"""Connected components of an edge table by alternating large-star and small-star steps, on written tables.

Each step joins edges with a table of one row a vertex, both read from the shared folder, so that a vertex with very
many edges is a skewed partition that adaptive execution can split. Nothing goes to the driver but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(v, root): the smallest vertex reachable, for each vertex of `edges` (a, b), both long, that is not its own root.

    Repeated edges, loops and both directions may be there. Converges in about log2 of the longest path steps.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links = ws.save(links, f"{name}-0")
    turn, before = 0, None
    while True:
        # large star: every neighbour above v meets the least of v and its neighbours
        least = links.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        least = ws.save(least, f"{name}-least-{turn}")
        up = links.join(least, links.u == least.x, "left").select("v", F.coalesce("m", "u").alias("u"))
        up = ws.save(up.distinct(), f"{name}-up-{turn}")
        # small star: a vertex and all its neighbours below meet the least of these
        least = ws.save(up.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")), f"{name}-low-{turn}")
        down = up.join(least, up.v == least.x)
        down = down.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").union(least.select(F.col("x").alias("v"), F.col("m").alias("u")))
        new = ws.save(down.distinct(), f"{name}-{turn + 1}")
        # settled when each v has one u and no u is a v: then nothing can change
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")).first()
        ws.drop(f"{name}-least-{turn}", f"{name}-up-{turn}", f"{name}-low-{turn}", f"{name}-{turn}")
        links, turn = new, turn + 1
        if not state["n"] or (state["n"], state["h"]) == before:
            return links.select("v", F.col("u").alias("root"))
        before = (state["n"], state["h"])
