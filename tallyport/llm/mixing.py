"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words. A target
   stops at twice its source's size; the excess goes to the others by weight until none is above.
2. Each source's documents are dealt into shards in seeded order; a shard's words are cut into equal blocks.
3. Highest quotients (votes / 1, 3, 5, ...) give each source, and within it each shard, a whole number of blocks.
4. A shard takes all its blocks as often as its quota allows, and the rest of the quota at equal steps from a seeded start.
   A document's taken words follow from the blocks that it overlaps, by arithmetic; no block is a row.

Defined results: a null or empty text has size 0 and is taken 0 times; null is a source of its own; documents with
equal ids are each counted and share their order by text; reruns agree; other columns are left out, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Workspace, let, spread, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 32


def _capped_targets(sources: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """Water level over the table of sources: in order of most * size / weight, sources are full as long as the level is above.

    One row a source; the windows below run over these rows only.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = ranked.withColumns({"cap": most * F.col("source_size"), "total": share * F.sum("source_size").over(everything)})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    ranked = ranked.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return ranked.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest["level"]).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], tie: list[str], votes: str, seats: Column, cap: str) -> DataFrame:
    """Adds `quota`: seats of the row's group by highest quotients votes / (2k - 1), at most `cap` a row.

    With v = seats / all votes, a row's seats differ from its share votes * v by no more than a part of the number of
    rows, so only the quotients near that share are drawn up: some four a row on average.
    """
    whole = Window.partitionBy(*group)
    share = F.try_divide(F.col(votes) * F.col("_seats"), F.col("_votes"))
    slack = F.try_divide(F.col("_rows"), 2 * F.col("_seats"))
    df = df.withColumns({"_seats": seats, "_votes": F.sum(votes).over(whole), "_rows": F.count(F.lit(1)).over(whole)})
    low = F.least(F.col(cap), F.greatest(F.lit(0), F.coalesce(F.floor(share * (1 - slack)), F.lit(0)) - 1)).cast("long")
    high = F.least(F.col(cap), F.coalesce(F.ceil(share * (1 + slack)), F.lit(0)) + 1).cast("long")
    df = df.withColumns({"_low": low, "_high": high})
    df = df.withColumn("_left", F.col("_seats") - F.sum("_low").over(whole))
    drawn = df.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    order = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *tie, "_k")
    drawn = drawn.withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    won = F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_left"))
    drawn = drawn.withColumn("_won", won.cast("long"))
    keep = [c for c in df.columns if not c.startswith("_")]
    return drawn.groupBy(*keep).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def mixing_plan(docs: DataFrame, seed: int = 42, weights: tuple = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, and how: passes (times the whole document is taken), first_word (of the
    document in its shard's line of words), shard_words, extra (blocks taken once more), block."""
    ws = Workspace(docs.sparkSession)
    narrow = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("whole")), "doc_id")
    sized = narrow.select("doc_id", "source", word_count(F.col("whole")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "whole").alias("draw"))
    sized = ws.save(sized, "sizes")
    sources = ws.save(_capped_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, SHARE, MOST), "sources")
    # as many shards as documents in one, so that neither a shard's line nor a source's shards become large before the other
    n_shards = F.ceil(F.sqrt("n_docs")).cast("long")
    dealt = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), n_shards))
    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = ws.save(dealt.withColumn("first_word", F.coalesce(F.sum("size").over(line), F.lit(0))).drop("n_docs"), "dealt")

    # a shard's votes are its blocks times its source's ratio, so that a full source takes each of its blocks twice
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_words") / BLOCK_WORDS).cast("long"))
    shards = shards.withColumns({"votes": F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) * F.col("n_blocks"), "cap": 2 * F.col("n_blocks")})
    shards = ws.save(shards.select("source", "shard", "shard_words", "n_blocks", "votes", "cap"), "shards")
    by_source = shards.groupBy("source").agg(F.sum("votes").alias("votes"), F.sum("cap").alias("cap"))
    seats = F.round(F.sum("votes").over(Window.partitionBy())).cast("long")
    by_source = sainte_lague(by_source, [], [F.col("source").asc_nulls_last()], "votes", seats, "cap").select("source", F.col("quota").alias("source_quota"))
    quotas = shards.join(by_source, shards.source.eqNullSafe(by_source.source)).drop(by_source.source)
    quotas = ws.save(sainte_lague(quotas, ["source"], [F.col("shard")], "votes", F.col("source_quota"), "cap").select("source", "shard", "shard_words", "n_blocks", "quota"), "quotas")

    mixed = dealt.join(quotas, dealt.source.eqNullSafe(quotas.source) & (dealt.shard == quotas.shard)).drop(quotas.source).drop(quotas.shard)
    mixed = mixed.withColumns({"passes": F.coalesce(F.try_divide(F.col("quota") - F.col("quota") % F.greatest("n_blocks", F.lit(1)), F.col("n_blocks")), F.lit(0)).cast("long")})
    mixed = mixed.withColumn("extra", F.col("quota") - F.col("passes") * F.col("n_blocks"))
    taken = F.col("passes") * F.col("size") + F.aggregate(chosen_blocks(seed), F.lit(0).cast("long"), lambda a, b: a + overlap(b))
    return mixed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, with its columns: each text as often as taken, and the extra blocks' words behind.

    Repeated rows are numbered on both sides of the join, so each meets its own part of the plan.
    """
    plan = mixing_plan(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    plan = plan.select("draw", "shard", "size", "first_word", "n_blocks", "passes", "extra", F.col("source").alias("plan_source"))
    twins = Window.partitionBy("draw")
    plan = plan.withColumn("twin", F.row_number().over(twins.orderBy("first_word")))
    rows = docs.select(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"), F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("twin", F.row_number().over(twins.orderBy(F.lit(0))))
    both = rows.join(plan, ["draw", "twin"]).withColumn("source", F.col("plan_source"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    begin = lambda b: F.greatest(F.col("first_word"), b * BLOCK_WORDS) - F.col("first_word") + 1
    part = let(words, lambda w: F.array_join(F.transform(chosen_blocks(seed), lambda b: F.array_join(F.slice(w, begin(b).cast("int"), overlap(b).cast("int")), "")), ""))
    copies = F.array_repeat(F.col("row")[text_col], F.col("passes").cast("int"))
    text = F.array_join(F.when(F.col("extra") > 0, F.filter(F.concat(copies, F.array(part)), lambda x: x != "")).otherwise(copies), "\n")
    both = both.withColumn("mixed", text)
    known = {text_col: F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return both.select(*[known.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def chosen_blocks(seed: int) -> Column:
    """The document's blocks that are taken once more: of the shard's n blocks, whose documents stand in seeded order, `extra` at equal steps
    from a seeded start, those where (block + start) * extra passes a multiple of n."""
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed + 3), F.col("shard"), F.col("source")), n)
    first = F.floor(F.col("first_word") / BLOCK_WORDS).cast("long")
    last = F.floor((F.col("first_word") + F.greatest("size", F.lit(1)) - 1) / BLOCK_WORDS).cast("long")
    chosen = F.filter(F.sequence(first, last), lambda b: (b + start) * F.col("extra") % n + F.col("extra") >= n)
    return F.when((F.col("extra") > 0) & (F.col("size") > 0), chosen).otherwise(F.array().cast("array<long>"))


def overlap(block: Column) -> Column:
    """Words of the document in this block."""
    return F.least(F.col("first_word") + F.col("size"), (block + 1) * BLOCK_WORDS) - F.greatest(F.col("first_word"), block * BLOCK_WORDS)
