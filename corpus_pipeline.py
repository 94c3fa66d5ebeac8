"""Corpus pipeline: quality, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the columns of documents, the
last the pieces of packed sequences. Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm.kneser_ney import quality_classifier
from tallyport.llm.mixing import mixed_documents
from tallyport.llm.packing import pack
from tallyport.llm.shared import WORD, Workspace, table
from tallyport.llm.simhash_golay import simhash_groups
from tallyport.llm.suffix_levels import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps, row by row: repeated ids and null ids are judged like others; texts without a word go.

    Scores come with the rows, so that no text is joined to them. An empty table gives an empty table; further columns are left out.
    """
    found = quality_classifier(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return found.where("kept").select("carry.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id (null last), among rows of that id that of the smallest hash of all columns.

    Rows equal in every column are one. Null and empty texts form a group of their own. An empty table gives an empty table.
    """
    docs = docs.select(*COLUMNS)
    one, two = F.xxhash64(*COLUMNS), F.xxhash64(F.lit(1), *COLUMNS)
    groups = simhash_groups(docs.withColumns({"one": one, "two": two}), carry=("one", "two"))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "carry.one", "carry.two")).alias("best"))
    rows = docs.withColumns({"one": one, "two": two}).join(best.select("best.one", "best.two"), ["one", "two"], "left_semi")
    return rows.dropDuplicates(["one", "two"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated 200-byte strings cover; bytes of a character cut through go too, and texts that have no word left.

    Null texts are empty and so go; rows that are equal in id and text are copies of each other and lose all their windows; rows with a null
    id take part. An empty table gives an empty table; further columns are left out.
    """
    rest = substring_dedup(docs, carry=("lang", "source"), rest="text")
    rest = rest.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source")
    return rest.where(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the words, by whole blocks; texts taken twice stand twice in their row.

    Null and empty texts have no words and are not taken; null is a source of its own; rows with equal or null ids are each mixed by
    themselves. An empty table gives an empty table; further columns are left out.
    """
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, of each row by itself, whatever its id; a null or empty text is its end id alone. An empty
    table gives an empty table."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.release()
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs


#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py follows each stage by plain Python instead.
ORACLE_SQL = None
