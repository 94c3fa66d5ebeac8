"""Spelling: interpolated modified Kneser-Ney 4-grams of 64 character classes, the last back-off of the word model.

The alphabet bounds the tables (64^4 grams), whatever the corpus, so that a dense table of 34 MB at most is what workers hold.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, groups

ORDER, BITS, START = 4, 6, 63
CLASSES = 1 << BITS
SCALE = 800  # the least probability, 2**-40, is -32000


@cache
def class_table() -> np.ndarray:
    """Class of each code point below 65536; those above are of the class of other signs."""
    out = np.full(1 << 16, 62, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if c > 127:
            out[c] = (61 if ch.isupper() else 60) if ch.isalpha() else 53 if ch.isdigit() else 62
        elif ch.isalpha():
            out[c] = c - 96 if ch.islower() else c - 64 + 26
        elif ch.isdigit():
            out[c] = 53
        else:
            out[c] = {"\n": 59, " ": 0, ".": 54, ",": 55, "!": 56, "?": 56}.get(ch, 0 if ch.isspace() else 57 if ch in "'\"()-:;" else 58)
    return out


def grams(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram that ends at each character, characters of each text); START stands before a text."""
    pad = "\U0010ffff" * (ORDER - 1)
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer((pad + pad.join(texts.to_pylist())).encode("utf-32-le", "replace"), np.uint32)
    code = table[np.minimum(points, (1 << 16) - 1)]
    high = np.flatnonzero(points > 0xFFFF)
    code[high] = np.where(points[high] == 0x10FFFF, START, 62)
    keep = np.ones(len(code), bool)
    starts = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    for k in range(ORDER - 1):
        keep[starts + k] = False
    gram = code.copy()
    for k in range(1, ORDER):
        gram[k:] |= code[:-k] << np.uint32(BITS * k)
    return gram[keep], n


@freed
def _count(batches):
    """(half, gram, c) of texts (text, half)."""
    table = class_table()
    for batch in batches:
        texts, halves = pc.fill_null(batch.column("text"), ""), batch.column("half").to_numpy()
        for lo, hi in groups(texts, 1_000_000):
            gram, n = grams(texts.slice(lo, hi - lo), table)
            both, c = np.unique(np.repeat(halves[lo:hi].astype(np.uint32), n) << np.uint32(BITS * ORDER) | gram, return_counts=True)
            both = both.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both >> (BITS * ORDER)), pa.array(both & ((1 << BITS * ORDER) - 1)), pa.array(c)], names=["half", "gram", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; plain values where counts of counts are missing."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


class Model:
    """Discounted shares and back-off weights of orders 1 to 4; dense() unfolds them to the log2 probability of each gram."""

    def __init__(self, gram: np.ndarray, c: np.ndarray):
        """gram: different grams of the highest order. Below it a gram's count is the classes seen before it."""
        counts = [(gram, c)]
        for order in range(ORDER - 1, 0, -1):
            counts.insert(0, np.unique(counts[0][0] & ((1 << BITS * order) - 1), return_counts=True))
        self.levels = []
        for gram, c in counts:
            cut = np.array(discounts(*[int((c == k).sum()) for k in (1, 2, 3, 4)]))[np.minimum(c, 3) - 1]
            context, at = np.unique(gram >> BITS, return_inverse=True)
            total = np.bincount(at, c)
            self.levels.append((gram, (c - cut) / total[at], context, np.bincount(at, cut) / total))

    def dense(self) -> np.ndarray:
        """log2 of probabilities in steps of 1 / SCALE, as whole numbers, so that sums are exact. The table of an order is the only large array."""
        lower = np.full(1, 1 / CLASSES, np.float32)
        for order, (gram, share, context, backoff) in enumerate(self.levels, 1):
            weight = np.ones(CLASSES ** (order - 1), np.float32)
            weight[context] = backoff
            p = np.empty(CLASSES**order, np.float32)
            p.reshape(-1, len(lower))[:] = lower
            p.reshape(-1, CLASSES)[:] *= weight[:, None]
            p[gram] += share.astype(np.float32)
            lower = p
        np.maximum(lower, 1e-12, out=lower)
        np.log2(lower, out=lower)
        lower *= SCALE
        return np.rint(lower, out=lower).astype(np.int16)


@lru_cache(1)
def unfolded(shared) -> np.ndarray:
    """The dense table of a broadcast model: one at a time in a worker, however many tasks use it."""
    return shared.value.dense()


def trained(texts: DataFrame) -> list[Model | None]:
    """The models of the texts (text, half) of half 0 and of half 1; None where there are none."""
    counts = texts.select("text", "half").mapInArrow(_count, "half long, gram long, c long").groupBy("half", "gram").agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # bounded by the alphabet
    half, gram, c = (found.column(k).to_numpy() for k in ("half", "gram", "c"))
    return [Model(gram[at], c[at]) if (at := np.flatnonzero(half == k)).size else None for k in (0, 1)]


def spelled(words: pa.Array, table: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """log2 probability of the spelling of each word, from the blank before it to the one after it."""
    gram, n = grams(pc.binary_join_element_wise(" ", words, " ", ""), table)
    total = np.concatenate([[0], np.cumsum(dense[gram], dtype=np.int64)])
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n + 1]) / SCALE
