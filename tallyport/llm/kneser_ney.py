"""Quality classifier: interpolated modified Kneser-Ney model of word bigrams, trained on trusted text, by sharded count joins.

All trusted text is counted. A gram's hash gives its shard; tasks send each shard the distinct grams of a block of documents with
their counts, as packed sorted arrays, and a shard adds them up. How many words a gram's first word is followed by, and its last
word follows, is summed by shards of words, which send discounted back-off weights and continuation shares back to the shards
of grams. The model so has a value for each gram: what it changes of the logarithm that lower orders alone would give. The
last back-off is spelling (spelling.py), whose tables are bounded by its alphabet. Model and counts grow with the corpus; they
are joined shard by shard and never broadcast.

Scoring joins blocks of documents (some MB of text each) with the shards: a block sends every shard its distinct grams, once
however many of its documents hold them, and gets their values back, so that neither a frequent gram nor a large group of
copies makes a large task. A document's bits are its spelling's less the values of its grams.

No text is scored by a model that has seen it: texts are halved by a hash of the text, so that equal texts stay together, and
each is scored by the trusted texts of the other half. So all trusted documents are held out. The halves' models are made one
after the other, and the documents of a half are scored in ROUNDS parts, so that a part of the shuffle is on disk at a time; each
part reads the table's text once more.

A document is rejected where its bits per character lie above its language's quantile of trusted documents, or the bits of its
spelling alone outside theirs, widened by a margin (MARGIN bits at 2,000 characters) that shrinks with length and with the number
of those documents, thrice as wide below: above for noise, below for endless repetition. Copies of trusted texts have few bits
by their words whatever else stands between them, so few bits by words reject nothing, and spelling is judged by itself.
Quantiles are exact to 1 / GRID bit and don't depend on how the table is dealt.

Defined results: kept is false for texts without a word, and every other text, however short, is judged by the limits; texts of
any length are scored whole, the longest alone in a block; documents with equal bits are judged alike; a null language is a
language of its own; a language without any trusted document of QUANTILE_CHARS characters uses the quantiles of all of them; with
all trusted text in one half that half's model scores all; without any trusted text all texts with a word are kept; rows with a
null id are scored and never trusted; repeated rows are scored each by itself; repeated labels count as trusted if one does;
other columns are left out, or handed on as they are in the struct `carry`; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Workspace, freed, groups, spread
from .spelling import BITS, SCALE, class_table, discounts, grams, spelled, trained, unfolded

LOW, HIGH, MARGIN, SHORT, QUANTILE_CHARS, FEW_DOCS, GRID = 0.005, 0.995, 0.05, 40, 100, 50, 1024
#: Bytes of text in a block, parts in which a half is scored, shards at least (as a power of two), bytes of all text for a shard.
BLOCK, ROUNDS, SHARD_BITS, SHARD_BYTES = 3_000_000, 3, 6, 32_000_000
#: Words are hashes of 48 bits. Those that stand before and after a text; multipliers of hashes; bits of an end by spelling.
BEFORE, AFTER, STEP, END_BITS = np.uint64(0x9E3779B97F4A), np.uint64(0xC2B2AE3D27D4), np.uint64(0xD6E8FEB86659FD93), float(BITS)
ROW = "shard long, kind int, source long, a binary, b binary, c binary"
NAMES = ["shard", "kind", "source", "a", "b", "c"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(*words: np.ndarray) -> np.ndarray:
    """64-bit hash of grams of one or two words."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mixed(h * STEP + w)
    return h


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :6] = body
    return out.view("<u8").ravel()


def squeezed(x: np.ndarray) -> bytes:
    """A table of whole numbers, column by column, in the smallest type that holds all, compressed."""
    x = np.ascontiguousarray(x.T.astype(np.min_scalar_type(int(x.max(initial=0)))))
    return x.dtype.char.encode() + pa.compress(x.tobytes(), "zstd", asbytes=True)


def loosened(raw, rows: int, columns: int) -> np.ndarray:
    kind = np.dtype(bytes(raw[:1]).decode())
    return np.frombuffer(pa.decompress(raw[1:], rows * columns * kind.itemsize, "zstd"), kind).reshape(columns, rows).T.astype(np.int64)


class Shards:
    """2**bits shards; a key's shard is its top bits, its place in the shard the 48 bits behind them."""

    def __init__(self, bits: int):
        self.bits = bits

    def of_key(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def place(self, key: np.ndarray) -> np.ndarray:
        return key << np.uint64(self.bits) >> np.uint64(16)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        return (word >> np.uint64(48 - self.bits)).astype(np.int64)

    def rows(self, shard: np.ndarray, kind: int, source, **columns: np.ndarray) -> pa.RecordBatch:
        """A row for each run of equal shards; 48-bit columns are packed, others go as they are. source: a number, or the shards' own."""
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(first, len(shard))
        blobs = []
        for name in ("a", "b", "c"):
            x = columns.get(name)
            if x is None:
                blobs.append(pa.nulls(len(first), pa.binary()))
                continue
            raw, size = (pack48(x), 6) if x.dtype == np.uint64 else (np.ascontiguousarray(x).tobytes(), x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1))
            blobs.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(raw)]))
        heads = [pa.array(shard[first]), pa.array(np.full(len(first), kind, np.int32)), pa.array(np.full(len(first), source, np.int64))]
        return pa.RecordBatch.from_arrays([*heads, *blobs], names=NAMES)


def rows_of(batches):
    """(shard, kind, source, a, b, c) row by row, blobs as buffers."""
    for batch in batches:
        heads = [batch.column(c).to_pylist() for c in NAMES[:3]]
        blobs = [batch.column(c) for c in NAMES[3:]]
        for i, head in enumerate(zip(*heads, strict=True)):
            yield *head, *[b[i].as_buffer() for b in blobs]


def runs(batches, by: int = 0):
    """(shard or source, rows of it): rows come sorted by it."""
    held, now = [], None
    for row in rows_of(batches):
        if held and row[by] != now:
            yield now, held
            held = []
        now = row[by]
        held.append(row)
    if held:
        yield now, held


def words_of(texts: pa.Array, table: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, log2 probability of its spelling, text it is of) of all texts in turn: BEFORE, its words, AFTER."""
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    owner = owner[full.to_numpy(zero_copy_only=False)]
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = np.bincount(owner, minlength=len(texts)) + 2
    ends = np.cumsum(n)
    word, bits = np.full(int(n.sum()), BEFORE, np.uint64), np.zeros(int(n.sum()))
    word[ends - 1], bits[ends - 1] = AFTER, -END_BITS
    if len(code):
        at = np.arange(len(code)) + 2 * owner + 1
        word[at] = np.array([xxh64_intdigest(w) >> 16 for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[code]
        bits[at] = spelled(coded.dictionary, table, dense)[code]
    return word, bits, np.repeat(np.arange(len(texts)), n)


def pairs_at(owner: np.ndarray) -> np.ndarray:
    """Places of the words that have one behind them in the same text."""
    return np.flatnonzero(owner[1:] == owner[:-1])


def summed(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each different key, rising by key; sum of its c)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(c[order], first) if len(first) else c[:0]


def _counts(shared, shards: Shards):
    """Kind 0: first words, second words and counts of a block's bigrams, to shards of grams. Kind 1: words and their spelling, to shards of words."""

    def run(batches):
        table, dense = class_table(), unfolded(shared)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for lo, hi in groups(texts, BLOCK):
                word, bits, owner = words_of(texts.slice(lo, hi - lo), table, dense)
                at = pairs_at(owner)
                key = gram_keys(word[at], word[at + 1])
                one, c = summed(key, np.ones(len(at), np.int64))
                yield shards.rows(shards.of_key(key[one]), 0, 0, a=word[at[one]], b=word[at[one] + 1], c=c)
                w, first = np.unique(word, return_index=True)
                yield shards.rows(shards.of_word(w), 1, 0, a=w, b=bits[first].astype(np.float32))

    return freed(run)


@freed
def _added(batches):
    """A shard's rows of a kind added up; n1 to n4: how many bigrams have these counts, n: how many there are."""
    for shard, rows in runs(batches):
        out = {"a": [], "b": [], "c": [], "kind": [], "n": []}
        for kind in (0, 1):
            some = [r for r in rows if r[1] == kind]
            if not some:
                continue
            a = np.concatenate([unpack48(r[3]) for r in some])
            if kind:
                a, first = np.unique(a, return_index=True)
                body = [pack48(a), np.concatenate([np.frombuffer(r[4], np.float32) for r in some])[first].tobytes(), None]
                n = np.zeros(5, np.int64)
            else:
                b = np.concatenate([unpack48(r[4]) for r in some])
                one, c = summed(gram_keys(a, b), np.concatenate([np.frombuffer(r[5], np.int64) for r in some]))
                body, n = [pack48(a[one]), pack48(b[one]), c.tobytes()], np.append(len(c), np.bincount(np.minimum(c, 5), minlength=6)[1:5])
            for k, x in zip(("a", "b", "c", "kind", "n"), (*body, kind, n), strict=True):
                out[k].append(x)
        k, n = len(out["kind"]), np.array(out["n"]).T
        heads = [pa.array([shard] * k, pa.int64()), pa.array(out["kind"], pa.int32()), pa.array([0] * k, pa.int64())]
        yield pa.RecordBatch.from_arrays([*heads, *[pa.array(out[c], pa.binary()) for c in "abc"], *map(pa.array, n)], names=[*NAMES, "n", "n1", "n2", "n3", "n4"])


def _words_in(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([v, w]))


def _requests(shards: Shards):
    """Kind 2, from shards of grams to shards of words: each word of a shard's bigrams, with (bigrams that it begins counted once, twice, more
    often; how often it begins one; bigrams that it ends) there."""

    def run(batches):
        for shard, _, _, a, b, c in rows_of(batches):
            v, w, c = unpack48(a), unpack48(b), np.frombuffer(c, np.int64)
            words = _words_in(v, w)
            at, size = np.searchsorted(words, v), len(words)
            stats = [np.bincount(at, c == 1, size), np.bincount(at, c == 2, size), np.bincount(at, c > 2, size), np.bincount(at, c, size), np.bincount(np.searchsorted(words, w), minlength=size)]
            stats, to = np.stack(stats, axis=1).astype(np.int64), shards.of_word(words)
            out = shards.rows(to, 2, shard, a=words)
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            blobs = [squeezed(x) for x in np.split(stats, first[1:])]
            yield out.set_column(4, "b", pa.array(blobs, pa.binary()))

    return freed(run)


@freed
def _word_stats(batches):
    """A shard's words with the sums of their numbers and their spelling; m1 to m4: how many end so many bigrams, m: sum of these."""
    for shard, rows in runs(batches):
        asked = [r for r in rows if r[1] == 2]
        known = [r for r in rows if r[1] == 1]
        words, at = np.unique(np.concatenate([unpack48(r[3]) for r in asked]), return_inverse=True)
        stats = np.zeros((len(words), 5), np.int64)
        found = np.concatenate([loosened(r[4], len(r[3]) // 6, 5) for r in asked])
        for k in range(5):
            stats[:, k] = np.bincount(at, found[:, k], len(words))
        spell = np.concatenate([np.frombuffer(r[4], np.float32) for r in known])[np.searchsorted(np.concatenate([unpack48(r[3]) for r in known]), words)]
        m = np.append(stats[:, 4].sum(), np.bincount(np.minimum(stats[:, 4], 5), minlength=6)[1:5])
        blobs = [pa.array([x], pa.binary()) for x in (pack48(words), stats.tobytes(), spell.tobytes())]
        heads = [pa.array([x], t) for x, t in ((shard, pa.int64()), (0, pa.int32()), (0, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*heads, *blobs, *[pa.array([int(x)]) for x in m]], names=[*NAMES, "m", "m1", "m2", "m3", "m4"])


def _replies(shards: Shards, cut: tuple, cut_low: tuple, total: int, rest: float):
    """Kind 1, to the shards of grams that asked: log2 of the words' back-off weights, of their lower-order probabilities, and how often they begin
    a bigram. Kind 2, to the shards of the words' own keys: the value of each word."""

    def run(batches):
        for _, rows in runs(batches):
            words, stats, spell = unpack48(rows[0][3]), np.frombuffer(rows[0][4], np.int64).reshape(-1, 5), np.frombuffer(rows[0][5], np.float32).astype(np.float64)
            n, ends = stats[:, 3], stats[:, 4]
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(n > 0, np.log2((stats[:, :3] @ np.array(cut)) / n), 0.0)
            share = np.where(ends > 0, (ends - np.array([0.0, *cut_low])[np.minimum(ends, 3)]) / total, 0.0)
            low = np.log2(share + np.exp2(rest + spell))
            value = weight + np.where(ends > 0, low - rest - spell, 0.0)
            key = gram_keys(words)
            order = np.argsort(key)
            key = key[order]
            yield shards.rows(shards.of_key(key), 2, 0, a=shards.place(key), b=value[order].astype(np.float32))
            every = np.stack([weight, low, n], axis=1).astype(np.float32)
            for shard, kind, source, a, _, _ in rows:
                if kind == 2:
                    found = every[np.searchsorted(words, unpack48(a))]
                    yield shards.rows(np.full(len(found), source), 1, shard, b=found)

    return freed(run)


def _values(shards: Shards, cut: tuple):
    """Kind 0: a shard's keys, rising, and their values: of bigrams and of single words."""

    def run(batches):
        for shard, rows in runs(batches):
            keys, values = [unpack48(r[3]) for r in rows if r[1] == 2], [np.frombuffer(r[4], np.float32) for r in rows if r[1] == 2]
            for _, kind, _, a, b, c in rows:
                if kind == 0:
                    v, w, c = unpack48(a), unpack48(b), np.frombuffer(c, np.int64)
                    known = np.concatenate([np.frombuffer(r[4], np.float32).reshape(-1, 3) for r in rows if r[1] == 1]).astype(np.float64)
                    words = _words_in(v, w)
                    weight, low, n = known[np.searchsorted(words, v), 0], known[np.searchsorted(words, w), 1], known[np.searchsorted(words, v), 2]
                    below = weight + low
                    p = np.log2((c - np.array([0.0, *cut])[np.minimum(c, 3)]) / n + np.exp2(below))
                    keys.append(shards.place(gram_keys(v, w)))
                    values.append((p - below).astype(np.float32))
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            yield shards.rows(np.full(len(key), shard), 0, 0, a=key[order], b=value[order])

    return freed(run)


def _by(df: DataFrame, *order: str) -> DataFrame:
    """All rows of a shard (or source) in one task, in order."""
    return df.repartition(order[0]).sortWithinPartitions(*order)


def word_model(texts: DataFrame, spelling, shards: Shards, ws: Workspace) -> tuple[DataFrame, float]:
    """(shard rows of keys and values, log2 of the weight that words leave to spelling) of the trusted `texts` (text)."""
    counts = ws.save(_by(texts.select("text").mapInArrow(_counts(spelling, shards), ROW), "shard").mapInArrow(_added, ROW + ", n long, n1 long, n2 long, n3 long, n4 long"), "counts")
    ws.release()
    found = counts.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()
    cut = discounts(*found)
    bigrams = counts.where("kind = 0").select(*NAMES)
    asked = bigrams.mapInArrow(_requests(shards), ROW)
    stats = _by(asked.unionByName(counts.where("kind = 1").select(*NAMES)), "shard").mapInArrow(_word_stats, ROW + ", m long, m1 long, m2 long, m3 long, m4 long")
    stats = ws.save(stats, "words")
    ws.release()
    total, *found = stats.agg(*[F.sum(c) for c in ("m", "m1", "m2", "m3", "m4")]).first()
    cut_low = discounts(*found)
    types = stats.agg(F.sum(F.length("b") / 40)).first()[0] - 1  # but BEFORE, which ends no bigram
    n1, n2 = found[:2]
    rest = float(np.log2((cut_low[0] * n1 + cut_low[1] * n2 + cut_low[2] * (types - n1 - n2)) / total))
    told = _by(asked.unionByName(stats.select(*NAMES)), "shard", "kind").mapInArrow(_replies(shards, cut, cut_low, total, rest), ROW)
    model = _by(bigrams.unionByName(told), "shard", "kind", "source").mapInArrow(_values(shards, cut), ROW)
    model = ws.save(model, "model")
    ws.drop("counts", "words")
    ws.release()
    return model, rest


def plain_bits(texts: pa.Array, table: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Bits of each text by spelling alone."""
    gram, n = grams(texts, table)
    total = np.concatenate([[0], np.cumsum(dense[gram], dtype=np.int64)])
    ends = np.cumsum(n)
    return (total[ends - n] - total[ends]) / SCALE


def narrowed(x: np.ndarray) -> pa.Array:
    """In the smallest type of unsigned numbers that holds all."""
    return pa.array(x.astype(np.min_scalar_type(int(x.max(initial=0)))))


def _ipc(batch: pa.RecordBatch) -> pa.Array:
    """A batch as one compressed binary value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def _asked(shared, shards: Shards, rest: float, carried: list[str]):
    """Kind 1: the different grams of a block, to their shards. Kind 2: the block's documents, how often each has each of these grams, and its bits
    by spelling, which pass through any shard."""

    def run(batches):
        table, dense = class_table(), unfolded(shared)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            every = pc.fill_null(batch.column("text"), "")
            for lo, hi in groups(every, BLOCK):
                texts = every.slice(lo, hi - lo)
                plain = np.concatenate([plain_bits(texts.slice(a, b - a), table, dense) for a, b in groups(texts, 1_000_000)])
                word, bits, owner = words_of(texts, table, dense)
                base = -np.bincount(owner, bits, len(texts)) - rest * (np.bincount(owner, minlength=len(texts)) - 1)
                at = pairs_at(owner)
                key, of = np.concatenate([gram_keys(word), gram_keys(word[at], word[at + 1])]), np.concatenate([owner, owner[at]])
                order = np.argsort(key, kind="stable")
                key, of = key[order], of[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
                count = np.diff(np.append(first, len(key)))
                key, of = key[first], of[first]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                yield shards.rows(shards.of_key(key[first]), 1, block, a=shards.place(key[first]))
                docs = batch.select(carried).slice(lo, hi - lo).append_column("plain", pa.array(plain)).append_column("base", pa.array(base))
                # of consecutive entries, the first of a gram is one gram on
                step = np.append(False, key[1:] != key[:-1])
                use = pa.RecordBatch.from_arrays([narrowed(x) for x in (step, of, count)], names=["step", "of", "count"])
                heads = [pa.array([x], t) for x, t in ((int(mixed(np.array([block], np.uint64))[0] >> np.uint64(64 - shards.bits)), pa.int64()), (2, pa.int32()), (block, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*heads, _ipc(docs), _ipc(use), pa.nulls(1, pa.binary())], names=NAMES)
                block += 1

    return freed(run)


@freed
def _looked_up(batches):
    """The values of the grams that blocks ask a shard for, 0 for those that it doesn't hold."""
    now, keys, values = None, np.zeros(0, np.uint64), np.zeros(0, np.float32)
    for batch in batches:
        out = []
        for shard, kind, source, a, b, c in rows_of([batch]):
            if shard != now:
                now, keys, values = shard, np.zeros(0, np.uint64), np.zeros(0, np.float32)
            if kind == 0:
                keys, values = unpack48(a), np.frombuffer(b, np.float32)
            elif kind == 2:
                out.append((shard, kind, source, a.to_pybytes(), b.to_pybytes(), None))
            else:
                asked = unpack48(a)
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                found = np.where(keys[at] == asked, values[at], np.float32(0)) if len(keys) else np.zeros(len(asked), np.float32)
                out.append((shard, 1, source, None, found.tobytes(), None))
        if out:
            heads = [pa.array(x, t) for x, t in zip(list(zip(*out, strict=True))[:3], (pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(col, pa.binary()) for col in list(zip(*out, strict=True))[3:]]], names=NAMES)


def _scored(names: list[str]):
    def run(batches):
        for _, rows in runs(batches, 2):
            values = np.concatenate([np.frombuffer(r[4], np.float32) for r in rows[:-1]])
            docs = pa.ipc.open_stream(rows[-1][3]).read_next_batch()
            use = pa.ipc.open_stream(rows[-1][4]).read_next_batch()
            step, of, count = (c.to_numpy() for c in use.columns)
            gram = np.cumsum(step, dtype=np.int64)
            assert len(values) == gram[-1] + 1
            gain = np.bincount(of, count * values[gram].astype(np.float64), docs.num_rows)
            size = np.maximum(docs.column("n_chars").to_numpy(), 1)
            plain, bits = docs.column("plain").to_numpy() / size, (docs.column("base").to_numpy() - gain) / size
            yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in names], pa.array(plain), pa.array(bits)], names=[*names, "plain", "bits"])

    return freed(run)


def word_bits(seen: DataFrame, trusted: DataFrame, ws: Workspace) -> DataFrame | None:
    """The columns of `seen` but text, half and round, with plain (bits of spelling alone) and bits, by character; None without trusted text.

    seen: text, n_chars, half, round and others. trusted: text, half.
    """
    size = seen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = Shards(max(SHARD_BITS, int(np.ceil(np.log2(max(size, 1) / SHARD_BYTES)))))
    names = [c for c in seen.columns if c not in ("text", "half", "round")]
    kinds = dict(seen.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in names], "plain double", "bits double"])
    models = trained(trusted)
    if models == [None, None]:
        return None
    parts = []
    for half in (0, 1):
        by = 1 - half if models[1 - half] else half
        own = trusted.where(F.col("half") == by)
        shared = seen.sparkSession.sparkContext.broadcast(models[by])  # bounded by the alphabet
        model, rest = word_model(own, shared, shards, ws)
        for k in range(ROUNDS):
            asked = seen.where((F.col("half") == half) & (F.col("round") == k)).select("text", *names).mapInArrow(_asked(shared, shards, rest, names), ROW)
            told = _by(model.unionByName(asked), "shard", "kind").mapInArrow(_looked_up, ROW)
            parts.append(ws.save(_by(told, "source", "kind", "shard").mapInArrow(_scored(names), schema), f"scored-{half}-{k}"))
            ws.release()
        ws.drop("model")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents with a label of quality 1."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def quantiles(values: DataFrame, by: list[str]) -> DataFrame:
    """Of each group of `values` (by, plain, bits): low and most (LOW and HIGH quantiles of plain), high (HIGH of bits), n.

    Values are counted by steps of 1 / GRID, so that what is sorted is the steps of a group, not its rows.
    """
    step = lambda c: F.round(F.col(c) * GRID).cast("long")
    steps = values.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("m"), step("plain").alias("x")), F.struct(F.lit(1).alias("m"), step("bits").alias("x")))).alias("s"))
    steps = steps.groupBy(*by, "s.m", "s.x").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*by, "m")
    steps = steps.withColumns({"below": F.sum("c").over(group.orderBy("x")), "n": F.sum("c").over(group)})
    at = lambda m, q: F.min(F.when((F.col("m") == m) & (F.col("below") >= F.ceil(F.col("n") * q)), F.col("x"))) / GRID
    return steps.groupBy(*by).agg(at(0, LOW).alias("low"), at(0, HIGH).alias("most"), at(1, HIGH).alias("high"), F.max("n").alias("n"))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple = ()) -> DataFrame:
    """doc_id, lang, n_chars, bits_per_char, perplexity, spelling_bits, low, spelling_high, high, kept of each document, and carry, a struct of the
    columns that it names; trusted text: labels with quality 1."""
    ws = Workspace(docs.sparkSession)
    text = F.col(text_col).cast("string")
    more = [F.struct(*carry).alias("carry")] if carry else []
    narrow = docs.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), text.alias("text"), *more)
    dealt = spread(narrow, "key")
    if dealt is not narrow:  # blocks must be the same when a lost task runs again
        dealt = dealt.sortWithinPartitions("key", "text")
    trusted = ws.save(trusted_ids(labels), "trusted")
    place = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    half, part = F.pmod(place, F.lit(2)).alias("half"), F.pmod(F.shiftright(place, 1), F.lit(ROUNDS)).alias("round")
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("has_word")
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    own = dealt.select("key", "text").join(trusted, F.col("key") == F.col("doc_id"), "left_semi").select("text", half)
    seen = dealt.select("key", "lang", "text", has_word, n_chars, half, part, *["carry"] * bool(carry))
    scored = word_bits(seen, own, ws)
    if scored is None:
        scored = ws.save(seen.drop("text", "half", "round").withColumns({"plain": F.lit(0.0), "bits": F.lit(0.0)}), "scored")
    ws.release()
    size = F.greatest("n_chars", F.lit(1))
    slack = MARGIN * F.sqrt(F.lit(2000.0) / size) * (1 + SHORT / size)
    # short texts vary too much for limits that all lengths share: the slack widens those of longer ones for them
    known = scored.where(F.col("n_chars") >= QUANTILE_CHARS).join(trusted, F.col("key") == F.col("doc_id"), "left_semi")
    known = ws.save(known.select("lang", "plain", "bits"), "known")
    by_lang = ws.save(quantiles(known, ["lang"]).withColumnRenamed("lang", "l"), "limits")
    every = quantiles(known, []).first()  # one row
    low, most, high, n = every or (None, None, None, None)
    found = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    few = slack * (1 + FEW_DOCS / F.coalesce("n", F.lit(max(n or 0, 1))))  # quantiles of few documents are uncertain
    or_all = lambda c, x: F.coalesce(c, F.lit(x).cast("double"))
    found = found.withColumns({"low": or_all("low", low) - 3 * few, "most": or_all("most", most) + few, "high": or_all("high", high) + few})
    inside = F.coalesce(F.col("plain").between(F.col("low"), F.col("most")) & (F.col("bits") <= F.col("high")), F.lit(True))
    return found.select(
        F.col("key").alias("doc_id"), "lang", "n_chars", F.col("bits").alias("bits_per_char"), F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.col("plain").alias("spelling_bits"), "low", F.col("most").alias("spelling_high"), "high", (F.col("has_word") & inside).alias("kept"), *["carry"] * bool(carry),
    )
