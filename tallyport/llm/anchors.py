"""Repeated windows of W symbols: minimizer anchors, super-windows, and exact classes by prefix doubling.

A window's anchor is its k-mer of least hash, the leftmost of equals: equal windows have equal anchors at equal
places. Consecutive windows with one anchor are a super-window; there are about 2 / (W - k + 2) of them a symbol, and
each window is in one. So windows need to be compared only among super-windows with equal anchor k-mers:

- an anchor k-mer seen once: none of its windows is repeated;
- super-windows with equal content: all their windows are repeated;
- others of a k-mer seen again: their contents meet in one task, one of each distinct content, where all their suffixes are
  sorted by the fingerprint of their first W symbols and neighbours are compared symbol by symbol. Where a k-mer has very
  many contents (a common line in many surroundings), its windows are counted by fingerprint over all tasks instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, freed, parts

#: Odd multipliers of the hashes, made from a rule: golden-ratio steps, made odd.
STEPS = np.array([(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)) | 1 for i in range(16)], np.uint64)
BASE = STEPS[4]
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE_BITS = 25
SEGMENT, BUFFER = 1 << 23, 1 << 20
#: Anchor k-mers with more different contents than this have their windows told apart by a distributed aggregate.
MANY = 8192
ROW = "h long, sig long, rid long, first long, windows int, anchor int"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * STEPS[5]
    x ^= x >> np.uint64(29)
    x = x * STEPS[6]
    return x ^ (x >> np.uint64(32))


class Bytes:
    """Symbols are the bytes of a text; hashes read eight at a time."""

    symbol = np.uint8
    span = 8

    def __init__(self, window: int, k: int = 32):
        self.window, self.k = window, k

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = pc.fill_null(column.cast(pa.binary()), b"")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        return data, offsets - offsets[0]

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as one number."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()

    def hashes(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Of the k-mers from each place."""
        x = np.zeros(n, np.uint64)
        for i in range(0, self.k, 8):
            x += grams[i : i + n] * STEPS[i // 8]
        return mix(x)


class Words:
    """Symbols are 64-bit hashes of words."""

    symbol = np.uint64
    span = 1

    def __init__(self, window: int, k: int = 6):
        self.window, self.k = window, k

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        words = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
        at = words.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = words.flatten().dictionary_encode()
        table = coded.dictionary.cast(pa.binary()).to_pylist()
        place = coded.indices.to_numpy()
        real = np.array([len(w) > 0 for w in table], bool)[place] if table else np.zeros(0, bool)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in table], np.uint64)
        return hashes[place[real]] if table else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(real)])[at]

    def grams(self, data: np.ndarray) -> np.ndarray:
        return data

    def hashes(self, grams: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros(n, np.uint64)
        for i in range(self.k):
            x += grams[i : i + n] * STEPS[i]
        return mix(x)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive numbers: of the end of one block and the start of the next."""
    n = len(x)
    blocks = np.full((n + w - 1) // w * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - w + 1], head[w - 1 : n])


def _range_hashes(kind, grams: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hashes of the symbols at[i] .. at[i] + length[i]: polynomials over mixed grams, from sums of prefixes, modulo 2**64."""
    powers = np.full(len(grams), BASE, np.uint64)
    powers[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams * STEPS[7] + STEPS[8]) * np.cumprod(powers))])
    powers[:] = INVERSE
    powers[:1] = 1
    return (sums[at + length - kind.span + 1] - sums[at]) * np.cumprod(powers)[at]


def super_windows(kind, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, anchor behind first, hash of the anchor, hash of the content) of the super-windows
    of pieces of `data`, each at least a window long."""
    window, k = kind.window, kind.k
    grams = kind.grams(data)
    n = len(data) - k + 1
    h = kind.hashes(grams, n)
    keyed = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    anchor = (sliding_min(keyed, window - k + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + lengths - window + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(anchor)))
    at, count = at[valid[at]], count[valid[at]]
    a = anchor[at]
    content = _range_hashes(kind, grams, at, count + window - 1)
    sig = mix(content + count.astype(np.uint64) * STEPS[9] + (a - at).astype(np.uint64) * STEPS[10])
    return np.searchsorted(starts, at, "right") - 1, at, count, a - at, h[a], sig


def _segments(offsets: np.ndarray, window: int):
    """(text, first symbol, symbols) pieces of at most SEGMENT windows, so that places fit their bits; together in buffers."""
    held, size = [], 0
    for i, n in enumerate(np.diff(offsets).tolist()):
        for first in range(0, n - window + 1, SEGMENT):
            piece = min(n - first, SEGMENT + window - 1)
            if held and size + piece > BUFFER:
                yield held
                held, size = [], 0
            held.append((i, first, piece))
            size += piece
    if held:
        yield held


def _rows(kind):
    def run(batches):
        for batch in parts(batches, 4_000_000):
            data, offsets = kind.texts(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for held in _segments(offsets, kind.window):
                text, first, length = (np.array(x, np.int64) for x in zip(*held, strict=True))
                starts = np.cumsum(length) - length
                buffer = np.concatenate([data[offsets[i] + f : offsets[i] + f + n] for i, f, n in held])
                piece, at, count, anchor, h, sig = super_windows(kind, buffer, starts, length)
                columns = [h.view(np.int64), sig.view(np.int64), rid[text[piece]], at - starts[piece] + first[piece], count.astype(np.int32), anchor.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "sig", "rid", "first", "windows", "anchor"])

    return freed(run)


def anchor_rows(texts: DataFrame, kind) -> DataFrame:
    """A row for each super-window of `texts` (rid, text)."""
    return texts.select("rid", "text").mapInArrow(_rows(kind), ROW)


def repeated_windows(kind, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the window from each place (rising) is equal to the window from another of these places.

    Suffixes are put in order of the fingerprint of their first `window` symbols; neighbours with equal fingerprints are
    compared symbol by symbol. Where the windows one place before are neighbours too, one more symbol decides.
    """
    window, grams = kind.window, kind.grams(symbols)
    hashes = _range_hashes(kind, grams, places, window)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    partner = np.full(len(places) + 1, -2, np.int64)
    partner[b] = a
    step = lambda x: (x > 0) & (places[x] == places[x - 1] + 1)
    chain = step(a) & step(b) & (partner[b - 1] == a - 1)
    equal = np.where(chain, symbols[places[a] + window - 1] == symbols[places[b] + window - 1], True)
    x, y = places[a[~chain]], places[b[~chain]]
    full = np.ones(len(x), bool)
    for k in {*range(0, window - kind.span + 1, kind.span), window - kind.span}:
        full &= grams[x + k] == grams[y + k]
    equal[~chain] = full
    out = np.zeros(len(places), bool)
    if not equal.all():  # two windows with one fingerprint: tell all apart by their symbols
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(symbols, window)[places])
        number = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        return np.bincount(number)[number] > 1
    out[a] = out[b] = True
    return out


def _contents(kind):
    def run(batches):
        for batch in parts(batches, 4_000_000):
            data, offsets = kind.texts(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            owner = np.repeat(np.arange(len(wanted)), pc.list_value_length(wanted).to_numpy())
            first, count = flat.field("first").to_numpy(), flat.field("windows").to_numpy()
            lo = offsets[owner] + first
            size = count + kind.window - 1
            itemsize = np.dtype(kind.symbol).itemsize
            raw = np.ascontiguousarray(data).view(np.uint8)
            for at in range(0, len(lo), 4096):
                a, n = lo[at : at + 4096], size[at : at + 4096]
                ends = np.cumsum(n * itemsize)
                body = raw[np.repeat(a * itemsize - (ends - n * itemsize), n * itemsize) + np.arange(int(ends[-1]))]
                content = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])
                part = flat.slice(at, len(a))
                rid = pc.take(batch.column("rid"), pa.array(owner[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([part.field("h"), rid, part.field("first"), part.field("windows"), part.field("n"), content], names=["h", "rid", "first", "windows", "n", "content"])

    return freed(run)


def _matches(kind, most: int = 2 << 20):
    """Runs of equal anchor hashes are brought together into suffix arrays of some MB each."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = batch.column("windows").to_numpy().astype(np.int64)
        column = batch.column("content")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        itemsize = np.dtype(kind.symbol).itemsize
        symbols = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind.symbol)
        begins = (offsets[:-1] - offsets[0]) // itemsize
        row = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        again = repeated_windows(kind, symbols, begins[row] + j)
        single = batch.column("n").to_numpy()[row] == 1
        hit = np.flatnonzero(again & single)
        row, j = row[hit], j[hit]
        opens = np.append(True, (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1))[: len(row)]
        closes = np.append(opens[1:], True)[: len(row)]
        first = batch.column("first").to_numpy()[row[opens]]
        rid = batch.column("rid").to_numpy()[row[opens]]
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(first + j[opens]), pa.array(first + j[closes] + kind.window)], names=["rid", "lo", "hi"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) < most:
                continue
            every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = every.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield found(every.slice(0, cut))
            held = [every.slice(cut)]
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return freed(run)


def repeated_spans(rows: DataFrame, texts: DataFrame, kind, ws: Workspace, name: str, solid_spans=None) -> DataFrame:
    """(rid, lo, hi): spans of symbols that together are all repeated windows which an anchor in `rows` with is_new shows.

    rows: super-windows, with is_new. texts: (rid, text) of all of them. solid_spans(again, contents, kind, ws, name), where
    given, makes (rid, lo, hi) of the super-windows whose content is repeated.
    """
    seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("is_new").alias("is_new")).where("n > 1 and is_new")
    seen = ws.save(seen.select("h"), f"{name}-seen")
    ws.release()
    again = ws.save(rows.drop("is_new").join(seen, "h", "left_semi"), f"{name}-again")
    ws.release()
    contents = again.groupBy("h", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "windows")).alias("one"))
    contents = ws.save(contents, f"{name}-contents")
    mixed = contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    mixed = ws.save(mixed.select("h", (F.col("kinds") > MANY).alias("many")), f"{name}-mixed")
    crowded = bool(mixed.where("many").head(1))
    ws.release()
    if solid_spans:
        solid = solid_spans(again, contents, kind, ws, name)
    else:
        solid = again.join(contents.where("n > 1").select("h", "sig"), ["h", "sig"], "left_semi")
        solid = solid.select("rid", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + kind.window - 1).alias("hi"))
    solid = ws.save(solid, f"{name}-solid")
    ws.release()
    schema = "h long, rid long, first long, windows int, n long, content binary"

    def pieces(many: bool) -> DataFrame:
        wanted = contents.join(mixed.where("many" if many else "not many").select("h"), "h", "left_semi").select("h", "n", "one.*")
        wanted = ws.save(wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "first", "windows", "n")).alias("wanted")), f"{name}-wanted-{int(many)}")
        ws.release()
        return texts.join(wanted, "rid").mapInArrow(_contents(kind), schema)

    found = pieces(False).repartition("h").sortWithinPartitions("h").mapInArrow(_matches(kind), "rid long, lo long, hi long")
    found = ws.save(found, f"{name}-found")
    if crowded:
        # windows of crowded anchors: equal where 128 bits of fingerprint are; no task holds an anchor's contents
        windows = ws.save(pieces(True).mapInArrow(_window_rows(kind), "f long, g long, rid long, lo long, n long"), f"{name}-windows")
        again_too = ws.save(windows.groupBy("f", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f", "g"), f"{name}-window-counts")
        hit = windows.where("n = 1").join(again_too, ["f", "g"], "left_semi").select("rid", "lo", (F.col("lo") + kind.window).alias("hi"))
        found = found.unionByName(ws.save(hit, f"{name}-found-too"))
        ws.drop(f"{name}-windows", f"{name}-window-counts")
    ws.drop(*[f"{name}-{x}" for x in ("seen", "again", "contents", "mixed", "wanted-0", "wanted-1")])
    ws.release()
    return solid.unionByName(found)


def _window_rows(kind):
    """(f, g, rid, lo, n): two fingerprints of each window of a content, g independent of f."""

    def run(batches):
        for batch in batches:
            count = batch.column("windows").to_numpy().astype(np.int64)
            column = batch.column("content")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            symbols = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind.symbol)
            begins = (offsets[:-1] - offsets[0]) // np.dtype(kind.symbol).itemsize
            ends = np.cumsum(count)
            for a in range(0, len(count), 2048):
                part = slice(a, a + 2048)
                row = np.repeat(np.arange(len(count))[part], count[part])
                j = np.arange(len(row)) - np.repeat((ends - count)[part] - (ends - count)[a], count[part])
                lo = int(begins[a])
                hi = int(begins[min(a + 2048, len(count)) - 1] + count[min(a + 2048, len(count)) - 1] + kind.window - 1)
                grams, at = kind.grams(symbols[lo:hi]), begins[row] + j - lo
                f = _range_hashes(kind, grams, at, kind.window)
                g = _range_hashes(kind, mix(grams ^ STEPS[11]), at, kind.window)
                taken = pa.array(row)
                columns = [pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), batch.column("rid").take(taken), pa.array(batch.column("first").to_numpy()[row] + j), batch.column("n").take(taken)]
                yield pa.RecordBatch.from_arrays(columns, names=["f", "g", "rid", "lo", "n"])

    return freed(run)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
