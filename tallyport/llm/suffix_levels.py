"""Exact substring dedup by a logarithmic family of sparse suffix arrays.

A batch of documents becomes a level: its suffixes at anchors (see anchors.py), sorted by the hash of the anchor's k-mer.
A new batch is scanned against all levels by joins on that hash; candidate suffixes meet in one task, sorted by the
fingerprint of their first `window` bytes, and neighbours are compared byte by byte. (Only equality over the window counts,
so fingerprint order does what lexicographic order would, at a sixth of the sorting.) Levels of equal rank are merged, so
n batches are held in at most log2(n) + 1 levels and each row is written again log2(n) times.

Removed is each byte covered by a `window`-byte string that also starts anywhere else, in the same document or
another; strings are judged on the input. Matches never cross documents.

Defined results: a null text is empty; texts shorter than the window keep all; repeated rows are copies of each other,
so all windows of theirs go; rows with a null id take part; other columns are left out; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Bytes, anchor_rows, merged, repeated_spans
from .shared import Workspace, freed, parts, spread

WINDOW, BATCHES = 200, 3


def identified(docs: DataFrame, id_col: str, text_col: str, carry: tuple = ()) -> DataFrame:
    """(rid, doc_id, text as bytes, carry: a struct of the columns named): rid is the same for rows of equal id and text only."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*carry).alias("carry")] if carry else []
    return docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("rid"), F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"), *more)


class SuffixLevels:
    """The index family: add() takes a batch of (rid, text) and returns the repeated spans that it shows, in old and new documents."""

    def __init__(self, ws: Workspace, window: int = WINDOW, name: str = "levels"):
        self.ws, self.kind, self.name = ws, Bytes(window), name
        self.levels: list[tuple[int, str, DataFrame]] = []  # rank, table, rows; ranks fall
        self.batches = 0

    def add(self, texts: DataFrame, everything: DataFrame) -> DataFrame:
        """everything: (rid, text) of all batches so far, this one included."""
        k, self.batches = self.batches, self.batches + 1
        own = f"{self.name}-{k}"
        rows = self.ws.save(anchor_rows(texts, self.kind).sortWithinPartitions("h", "sig"), own)
        every = rows.withColumn("is_new", F.lit(True))
        for _, _, level in self.levels:
            every = every.unionByName(level.withColumn("is_new", F.lit(False)))
        spans = repeated_spans(every, everything, self.kind, self.ws, f"{self.name}-spans-{k}")
        self.levels.append((0, own, rows))
        return spans

    def merge(self) -> None:
        """Merge levels of equal rank, the smallest first."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a, old), (_, b, new) = self.levels[-2:]
            name = f"{self.name}-{rank + 1}-{self.batches}"
            rows = self.ws.save(old.unionByName(new).repartitionByRange("h", "sig", "rid").sortWithinPartitions("h", "sig"), name)
            self.ws.drop(a, b)
            self.levels[-2:] = [(rank + 1, name, rows)]


def _cut(rest_as: str):
    def run(batches):
        for batch in parts(batches):
            out, rests = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                cuts = merged([(s["lo"], s["hi"]) for s in spans or []])
                kept, at = [], 0
                for lo, hi in cuts:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest()))
                if rest_as != "none":
                    rests.append(rest if rest_as == "bytes" else "".join(k.decode("utf-8", "ignore") for k in kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            names = ["doc_id", "rid", *(["carry"] if "carry" in batch.schema.names else [])]
            arrays = [*map(batch.column, names), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]]
            names += ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if rest_as != "none":
                arrays.append(pa.array(rests, pa.binary() if rest_as == "bytes" else pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return freed(run)


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (), rest: str = "bytes") -> DataFrame:
    """doc_id, rid, carry, n_bytes, n_removed, n_spans, kept_sha256, kept of each document.

    carry: a struct of further columns of the input, where some are named. rest: kept as "bytes", or as "text", where the bytes of characters
    that are cut through go too, or "none".
    """
    ws = Workspace(docs.sparkSession)
    texts = identified(docs, id_col, text_col, carry)
    narrow = spread(texts.select("rid", "text"), "rid")
    index = SuffixLevels(ws, window)
    spans = None
    for k in range(batches):
        # documents that come later have no rows yet, and no spans
        found = index.add(narrow.where(F.pmod("rid", F.lit(batches)) == k), narrow)
        index.merge()
        spans = found if spans is None else spans.unionByName(found)
    spans = ws.save(spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    ws.release()
    joined = texts.join(spans, "rid", "left")
    kinds = dict(texts.dtypes)
    more = f"carry {kinds['carry']}, " if carry else ""
    return joined.mapInArrow(_cut(rest), f"doc_id {kinds['doc_id']}, rid long, {more}n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {"bytes": ", kept binary", "text": ", kept string", "none": ""}[rest])
