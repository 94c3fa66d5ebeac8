"""The registered queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from . import sql
from .debruijn import word_span_dedup
from .embeddings import embedding_groups
from .kneser_ney import quality_classifier
from .mixing import mixing_plan
from .packing import pack
from .quality_rules import quality_rules
from .shared import table
from .simhash_golay import simhash_groups
from .suffix_levels import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op1_cross_polytope(spark, sf_dir):
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_golay(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op6_kneser_ney(spark, sf_dir):
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_levels(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), rest="none").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_debruijn(spark, sf_dir):
    return word_span_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_mixing(spark, sf_dir):
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries():
    return {f.__name__: f for f in (op1_cross_polytope, op2_toxicity, op3_simhash_golay, op4_packing, op5_quality_rules, op6_kneser_ney, op7_suffix_levels, op8_debruijn, op9_mixing, op10_token_counts)}


def oracle_sql():
    return sql.oracle_sql()
