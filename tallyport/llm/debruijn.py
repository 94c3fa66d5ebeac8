"""Repeated word spans by De Bruijn compaction.

Each window of 35 words is an edge of the De Bruijn graph of the corpus. Edges are dealt out by minimizers, so that a
run of consecutive edges with one minimizer (a super-window, see anchors.py) is one piece of a path. Pieces that occur
again with equal content are joined to longer paths where they do not branch: Y follows X at each of X's occurrences
and both occur equally often. A path's pieces then stand next to each other at its first source coordinates, which
numbers them; joining pieces back to their occurrences gives each occurrence of a path as one span. Edges of pieces
that differ in part are verified word by word from their source coordinates.

Removed is each word covered by a 35-word window whose word sequence also starts anywhere else, judged on the input.

Defined results: a null text has no words; texts shorter than the window keep all; repeated rows are copies of each
other, so all windows of theirs go; rows with a null id take part; other columns are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Words, anchor_rows, merged, repeated_spans
from .shared import Workspace, freed, parts, spread
from .suffix_levels import identified

WINDOW = 35


def compacted_paths(again: DataFrame, contents: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, pieces): pieces (h, sig, n, path_rid, path_first, ahead) of maximal nonbranching repeated paths.

    A path is named by the source coordinates of its first occurrence; ahead is the number of edges before the piece.
    """
    pieces = contents.where("n > 1").select("h", "sig", "n", "one.*")
    occurrences = ws.save(again.join(pieces.select("h", "sig", "n"), ["h", "sig"]), f"{name}-occurrences")
    ws.release()
    along = Window.partitionBy("rid").orderBy("first", "h", "sig")
    follows = F.when(F.lead("first").over(along) == F.col("first") + F.col("windows"), F.lead(F.struct("h", "sig", "n")).over(along))
    ahead = occurrences.withColumn("next", follows).groupBy("h", "sig", "n").agg(F.count("next").alias("c"), F.min("next").alias("next"), F.max("next").alias("other"))
    linked = ahead.where((F.col("c") == F.col("n")) & (F.col("next") == F.col("other")) & (F.col("next.n") == F.col("n")))
    linked = linked.select("next.h", "next.sig", F.lit(True).alias("linked"))
    joined = ws.save(pieces.join(linked, ["h", "sig"], "left"), f"{name}-pieces")
    ws.release()
    stands = Window.partitionBy("rid").orderBy("first")
    behind = F.col("linked") & (F.lag(F.col("first") + F.col("windows")).over(stands) == F.col("first"))
    heads = joined.withColumn("head", F.when(F.coalesce(behind, F.lit(False)), None).otherwise(F.col("first")))
    heads = heads.withColumn("path_first", F.last("head", ignorenulls=True).over(stands.rowsBetween(Window.unboundedPreceding, 0)))
    return occurrences, heads.select("h", "sig", "n", F.col("rid").alias("path_rid"), "path_first", (F.col("first") - F.col("path_first")).alias("ahead"))


def _path_spans(again, contents, kind, ws, name):
    occurrences, pieces = compacted_paths(again, contents, ws, name)
    placed = occurrences.drop("n").join(ws.save(pieces.drop("n"), f"{name}-paths"), ["h", "sig"])
    placed = placed.withColumn("lo", F.col("first") - F.col("ahead")).groupBy("rid", "path_rid", "path_first", "lo").agg(F.max(F.col("first") + F.col("windows")).alias("end"))
    return placed.select("rid", "lo", (F.col("end") + kind.window - 1).alias("hi"))


@freed
def _cut(batches):
    for batch in parts(batches):
        n, removed, digests, kept = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            keep = np.ones(len(words), bool)
            for lo, hi in merged([(s["lo"], s["hi"]) for s in spans or []]):
                keep[lo:hi] = False
            rest = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
            n.append(len(words))
            removed.append(int((~keep).sum()))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def word_span_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining words, one space between them) of each document."""
    ws = Workspace(docs.sparkSession)
    kind = Words(window)
    texts = identified(docs, id_col, text_col)
    narrow = spread(texts.select("rid", F.col("text").cast("string").alias("text")), "rid")
    rows = ws.save(anchor_rows(narrow, kind), "rows").withColumn("is_new", F.lit(True))
    spans = repeated_spans(rows, narrow, kind, ws, "spans", _path_spans)
    ws.drop("rows")
    spans = ws.save(spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "joined")
    ws.release()
    kind_of_id = dict(texts.dtypes)["doc_id"]
    return texts.join(spans, "rid", "left").drop("rid").mapInArrow(_cut, f"doc_id {kind_of_id}, n_words long, n_removed long, kept_sha256 string, kept string")
