"""Packing documents into sequences of at most 2048 tokens by order-preserving dynamic programming.

Each partition's documents stay in order, each as its ids and an end id, one after another. Cuts may fall at document
ends (free), at sentence ends and, in long stretches without either, on a grid (both at a penalty). The DP

    cost[j] = penalty[j] + min over i, 0 < pos[j] - pos[i] <= window, of cost[i] + window - (pos[j] - pos[i])

has the least sum of padding and penalties; cost[i] + pos[i] is kept in a monotone queue, so each cut place costs
constant time. What remains at a partition's end is cut at powers of two, which need no padding.

A partition is worked off in chunks of some half a million tokens: all sequences but the last few of a chunk are final, the
rest opens the next chunk. Memory is bounded by the chunk, the tokenizer's memo and the longest text. No shuffle, but for a table of
fewer partitions than cores, which is dealt out by ranges of its id.

Defined results: a null or empty text is its end id alone; repeated rows are packed each by itself; rows with a null
id are packed; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import freed, groups, text_column
from .word_bpe import WordIds, default_path, ids_of, word_ids

WINDOW, END_ID = 2048, 1
SENTENCE_PENALTY, GRID_PENALTY, PIECE_PENALTY = 1, 6, 4
#: At most one sentence end in so many tokens is a cut place; without any in GAP tokens, each GRID tokens are one.
CELL, GAP, GRID = 16, 24, 16
#: Tokens of a chunk and bytes of text that are encoded at once.
CHUNK, SLICE = 500_000, 1_000_000


def cut_places(pos: list[int], penalty: list[int], window: int = WINDOW, last: bool = True) -> list[int]:
    """Places of the cuts with the least padding plus penalties, from pos[0] to pos[-1]; consecutive places are at most window apart.

    With last, what is behind the last place but one may be cut at powers of two instead of padded.
    """
    back, best = [0] * len(pos), [0] * len(pos)
    queue, value, head = [0], [0], 0  # of places in reach: cost + position, rising
    for j in range(1, len(pos)):
        low = pos[j] - window
        while pos[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        best[j] = v = value[head] + penalty[j] + window
        while len(value) > head and value[-1] > v:
            value.pop()
            queue.pop()
        queue.append(j)
        value.append(v)
    end, j, path = pos[-1], len(pos) - 1, []
    if last:
        i = min(range(int(np.searchsorted(pos, end - window)), j), key=lambda i: best[i] - pos[i] + tail(end - pos[i], window)[0])
        path, j = [pos[i] + x for x in tail(end - pos[i], window)[1]][::-1], i
    while j:
        path.append(pos[j])
        j = back[j]
    return [pos[0], *path[::-1]]


def tail(n: int, window: int) -> tuple[int, list[int]]:
    """(cost, ends) of the last n tokens: one padded sequence, or pieces whose lengths are powers of two, the largest first."""
    ends, lo = [], 0
    while lo < n:
        lo += min(window, 1 << ((n - lo).bit_length() - 1))
        ends.append(lo)
    pieces = PIECE_PENALTY * (len(ends) - 1)
    return (window - n, [n]) if window - n <= pieces else (pieces, ends)


def places(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(cut places, penalties): 0, document ends, sentence ends thinned to one a cell, and the grid in gaps."""
    last_of_cell = np.append(sentences[1:] // CELL != sentences[:-1] // CELL, True)[: len(sentences)]
    pos = np.unique(np.concatenate([[0, total], ends, sentences[last_of_cell]]))
    gaps = np.flatnonzero(np.diff(pos) > GAP)
    filled = [np.arange(pos[g] + GRID, pos[g + 1], GRID) for g in gaps.tolist()]
    grid = np.concatenate(filled) if filled else np.zeros(0, np.int64)
    penalty = np.where(np.isin(pos, ends, assume_unique=True), 0, SENTENCE_PENALTY)
    both = np.concatenate([pos, grid])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([penalty, np.full(len(grid), GRID_PENALTY)])[order]


class _Stream:
    """A partition's tokens that are not yet in final sequences, and the documents that they are of."""

    def __init__(self, window: int, first_sequence: int, sentence_end: np.ndarray, id_type: pa.DataType):
        self.window, self.sequence, self.sentence_end, self.id_type = window, first_sequence, sentence_end, id_type
        self.ids: list[np.ndarray] = []
        self.docs: list = []  # (doc_id, start within the document, length here, tokens of the document)
        self.size = 0

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents whose ids, with end ids, follow one another."""
        self.ids.append(ids)
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, lengths.tolist(), strict=True)]
        self.size += len(ids)

    def cut(self, last: bool) -> pa.RecordBatch | None:
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        sentences = np.flatnonzero(self.sentence_end[ids]) + 1
        pos, penalty = places(ends, sentences, len(ids))
        cuts = cut_places(pos.tolist(), penalty.tolist(), self.window, last)
        if not last and len(cuts) > 8:
            cuts = cuts[:-4]
        out = self._pieces(ids, ends, np.array(cuts))
        done = cuts[-1]
        k = int(np.searchsorted(ends, done, "right"))
        self.docs = self.docs[k:]
        if self.docs and (inside := done - (int(ends[k - 1]) if k else 0)):
            d, start, n, total = self.docs[0]
            self.docs[0] = (d, start + inside, n - inside, total)
        self.ids, self.size = [ids[done:]], len(ids) - done
        self.sequence += len(cuts) - 1
        return out

    def _pieces(self, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        bounds = np.union1d(cuts, ends[ends < cuts[-1]])
        lo, hi = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, lo, "right")
        seq = np.searchsorted(cuts, lo, "right") - 1
        begins = ends - np.array([d[2] for d in self.docs])
        start = lo - begins[doc] + np.array([d[1] for d in self.docs])[doc]
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        columns = {
            "doc_id": pa.array([self.docs[k][0] for k in doc.tolist()], self.id_type),
            "start": start,
            "length": hi - lo,
            "ids_crc32": crc,
            "doc_tokens": np.array([d[3] for d in self.docs])[doc],
            "sequence_id": seq + self.sequence,
            "offset": lo - cuts[seq],
        }
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))


def with_ends(rows: np.ndarray, at: np.ndarray, memo: WordIds, special: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with its end id behind; ids a text, with it)."""
    total = np.concatenate([[0], np.cumsum(memo.count[rows], dtype=np.int64)])
    n = np.diff(total[at]) + 1
    out = np.full(int(n.sum()), END_ID, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = memo.gather(rows)
    if special:
        parts = np.split(out, np.cumsum(n)[:-1])
        for i, ids in special.items():
            parts[i] = np.append(ids, np.uint32(END_ID))
        out, n = np.concatenate(parts), np.array([len(p) for p in parts])
    return out, n


def _pack(path: str, window: int):
    def run(batches):
        memo = word_ids(path)
        names = memo.library.get_vocab(with_added_tokens=True)
        sentence_end = np.zeros(len(memo.ends_word), bool)
        for name, i in names.items():
            sentence_end[i] = name.removesuffix("</w>")[-1:] in (".", "!", "?")
        stream = None
        for batch in batches:
            stream = stream or _Stream(window, TaskContext.get().partitionId() << 32, sentence_end, batch.column("doc_id").type)
            texts, doc_ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id").to_pylist()
            for lo, hi in groups(texts, SLICE):
                part = texts.slice(lo, hi - lo)
                rows, at, special = ids_of(part, memo)
                ids, n = with_ends(rows, at, memo, {i: memo.whole(part[i].as_py().encode()) for i in special})
                stream.add(doc_ids[lo:hi], n, ids)
                if stream.size > CHUNK:
                    yield stream.cut(False)
        if stream and (rest := stream.cut(True)) is not None:
            yield rest

    return freed(run)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    narrow = text_column(docs, id_col, text_col)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if narrow.rdd.getNumPartitions() < cores:  # a table of few files: in order of id, over all cores
        narrow = narrow.repartitionByRange(cores, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(_pack(path or default_path(), window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
