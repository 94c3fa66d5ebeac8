"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at 4 or fewer differing bits. They are cut into segments of 22, 21 and 21 bits, each a
word of the binary Golay code's space of 23 bits. The code is perfect: each word lies within 3 bits of exactly one of
its 4096 codewords. A segment's keys are the codewords of the word and of its 23 neighbours at one bit: 1 or 6 of them.
Two segments that differ in at most 2 bits have a word within one bit of both and so share a key.

Pigeonhole over three segments with at most 4 errors in all:
- no segment has more than 2 errors: the fingerprints share a key in each segment, so a triple of keys;
- one segment has 3 or 4: the other two have at most 1 together, so one is equal and the other shares a key.

Tasks sort these compound keys and verify candidates inside each run of equal keys. A task sends the edges of a
spanning forest of what it has verified, never the pairs of a group: within a run, each new vertex is compared only
with those not yet reached. Equal fingerprints are one vertex from the start.

Defined results: a null or empty text has fingerprint zero, linked like any other; rows with a null id take part, but
are no component's smallest id unless all its ids are null; repeated rows link with each other; other columns are left
out; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, freed, spread

MAX_BITS, SEED, SHINGLE = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GOLAY = 0b101011100011


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of words of up to 23 bits, divided by the generator: the syndrome, 11 bits."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0).astype(x.dtype)
    return x


class Golay:
    """Keys of segments by table: the syndromes of 12 high and 11 low bits, and the error of each syndrome."""

    def __init__(self):
        self.high = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *[a | b for i, a in enumerate(bits) for b in bits[:i]], *[a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]]
        errors = np.array(errors, np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        self.error[_remainder(errors)] = errors  # 2048 errors, one for each syndrome

    def index(self, x: np.ndarray) -> np.ndarray:
        """Number of the codeword next to each word: its 12 high bits, which determine it."""
        return (x ^ self.error[self.high[x >> 11] ^ (x & 0x7FF)]) >> 11

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, 6) keys of each word, repeated where there are fewer."""
        near = np.sort(np.stack([self.index(x)] + [self.index(x ^ (1 << i)) for i in range(23)], axis=1), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        place = np.cumsum(new, axis=1) - 1
        assert place.max(initial=0) < 6
        out = np.repeat(near[:, :1], 6, axis=1)
        rows = np.nonzero(new)[0]
        out[rows, place[new]] = near[new]
        return out


def compound_keys(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row of each key, key): all of a fingerprint's compound keys, each once."""
    seg = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    keys = [code.keys(s) for s in seg]
    n = len(fp)
    triple = (keys[0][:, :, None, None] << 24 | keys[1][:, None, :, None] << 12 | keys[2][:, None, None, :]).reshape(n, 216)
    found = [triple]
    for k, (a, b) in enumerate([(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]):  # a equal, b near
        found.append((k + 1) << 40 | seg[a][:, None] << 12 | keys[b])
    every = np.sort(np.concatenate(found, axis=1), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.nonzero(new)[0], every[new]


def fingerprint(text: bytes, xxh64) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ([0] + ends[:-1].tolist())[: max(1, len(words) - SHINGLE + 1)]
    h = np.array([xxh64(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :].tolist(), strict=True)], "<u8")
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@freed
def _fingerprints(batches):
    import xxhash

    for batch in batches:
        found = np.array([fingerprint(t or b"", xxhash.xxh64_intdigest) for t in batch.column("text").to_pylist()], np.uint64)
        more = [c for c in batch.schema.names if c == "carry"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, ["doc_id", *more]), pa.array(found.view(np.int64))], names=["doc_id", *more, "fp"])


@freed
def _explode(batches):
    code = Golay()
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys = compound_keys(part, code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


class Forest:
    """Union-find over the fingerprints that a task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def run_links(fp: np.ndarray, max_bits: int):
    """Edges of a spanning forest of the distinct fingerprints of one run."""
    left = fp
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                for y in left[near].tolist():
                    yield int(x), y
                front += list(left[near])
                left = left[~near]


def _verify(max_bits: int):
    def run(batches):
        forest, held_key, held_fp = Forest(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(key: np.ndarray, fp: np.ndarray):
            out = []
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            bits = fp.view(np.uint64)
            for a in (bits[start[size == 2]], ):  # pairs, most of all runs, at once
                b = bits[start[size == 2] + 1]
                near = np.bitwise_count(a ^ b) <= max_bits
                out += [e for e in zip(a[near].tolist(), b[near].tolist(), strict=True) if forest.join(*e)]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out += [e for e in run_links(bits[s : s + n], max_bits) if forest.join(*e)]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            if cut:
                yield edges(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield edges(held_key, held_fp)

    return freed(run)


def simhash_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): edges that join all fingerprints of `fps` (fp, distinct) within max_bits of each other."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys cover up to {MAX_BITS} bits")
    keys = fps.select("fp").mapInArrow(_explode, "key long, fp long")
    # dealt out and sorted by key: all fingerprints of a key are one run of one task
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), root (the component's smallest fingerprint, signed) of each document,
    and carry, a struct of the columns that it names."""
    ws = Workspace(docs.sparkSession)
    more = [F.struct(*carry).alias("carry")] if carry else []
    narrow = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more), "doc_id")
    kinds = dict(narrow.dtypes)
    fps = ws.save(narrow.mapInArrow(_fingerprints, ", ".join([f"{c} {kinds[c]}" for c in kinds if c != "text"] + ["fp long"])), "fps")
    classes = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(ws.save(simhash_links(spread(classes, "fp"), max_bits), "edges"), ws)
    placed = classes.join(roots, classes.fp == roots.v, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = ws.save(placed.join(least, "root").select("fp", "root", "component_id"), "placed")
    found = fps.join(placed, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *["carry"] * bool(carry))
