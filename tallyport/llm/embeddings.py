"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes its largest coordinate
with its sign. A table joins `hashes` of them to a bucket; a vector enters the `probes` buckets of a table that lose
least against the largest coordinates, so near vectors share one though their largest coordinates differ. In a bucket all
cosines are computed in double precision from the full vectors, by blocks. A pair that shares several buckets counts in the
first only, which both vectors' keys tell, so no pairs are written to be told apart.

Equal vectors are one class from the start. Buckets above TILE members are parted in tiles, each pair of parts in a task of
its own. A task sends per-class counts and a spanning forest, never the pairs of a group.

The number of hashes follows the number of vectors and the sides of the cross-polytope, two for each dimension, so that buckets
keep their size: at 64 dimensions 2 hashes up to 130,000 vectors and 3 up to 17 million, at 1,536 dimensions 2 up to 130 million.
Keys of any number of hashes are folded to 58 bits; keys that so meet only share a bucket. Measured recall of pairs at cosine 0.9
exactly is in the README; nearer pairs are met more often.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; a null vec_id is never a component's smallest id while another is there; repeated rows link
with each other; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import STEPS, mix
from .components import components
from .shared import Workspace, freed, spread
from .simhash_golay import Forest

MIN_COSINE, TABLES, SEED, TILE = 0.9, 6, 42, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def shape(dim: int, n: int) -> tuple[int, int]:
    """(hashes, probes) for n vectors, for buckets of about eight."""
    hashes = max(2, math.ceil(math.log(max(n, 2) / 8, 2 * width(dim))))
    return hashes, 1 << hashes


def width(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


KEY_BITS = 58


class CrossPolytope:
    """Bucket keys of unit vectors of one dimension: the table in the top bits, below it a hash of dimension and sides."""

    def __init__(self, dim: int, hashes: int, probes: int, tables: int = TABLES, seed: int = SEED):
        self.dim, self.hashes, self.probes, self.tables, self.width = dim, hashes, probes, tables, width(dim)
        self.signs = np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, self.width))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, probes)."""
        x = np.zeros((len(unit), self.width))
        x[:, : self.dim] = unit
        return np.stack([self._table(x, t) for t in range(self.tables)], axis=1)

    def _table(self, x: np.ndarray, t: int) -> np.ndarray:
        n, most = len(x), min(4, self.width)
        code, loss = np.full((n, 1), self.dim, np.uint64), np.zeros((n, 1))
        for signs in self.signs[t]:
            y = x
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :most]
            value = np.take_along_axis(size, top, 1)
            own = (2 * top + (np.take_along_axis(y, top, 1) < 0)).astype(np.uint64)
            code = mix(code[:, :, None] * STEPS[0] + own[:, None, :] + np.uint64(1)).reshape(n, -1)
            loss = (loss[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : max(self.probes, most)]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        code = code[:, : self.probes]
        code = np.concatenate([code, np.repeat(code[:, :1], self.probes - code.shape[1], axis=1)], axis=1)
        return (code >> np.uint64(64 - KEY_BITS)).astype(np.int64) | t << KEY_BITS


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(total: int, hashes: int | None, dtype: str):
    def run(batches):
        hashers = {}
        for batch in batches:
            size = np.diff(batch.column("e").offsets.to_numpy())
            flat = batch.column("e").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                hasher = hashers.get(dim) or hashers.setdefault(dim, CrossPolytope(dim, *((hashes, 1 << hashes) if hashes else shape(dim, total))))
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    vectors = flat[starts[part][:, None] + np.arange(dim)]
                    keys = hasher.keys(units(vectors))
                    columns = [batch.column("cid").take(pa.array(part)), batch.column("copies").take(pa.array(part))]
                    blobs = [[v.tobytes() for v in vectors.astype(dtype)], [k.tobytes() for k in keys]]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(b, pa.binary()) for b in blobs]], names=["cid", "copies", "vector", "keys"])

    return freed(run)


@freed
def _entries(batches):
    """(bucket, cid) of each bucket that a class enters, once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        blobs = batch.column("keys").to_pylist()
        every = np.frombuffer(b"".join(blobs), np.int64)
        rows = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        order = np.lexsort((every, rows))
        bucket, rows = every[order], rows[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (rows[1:] != rows[:-1]))
        rows = pa.array(rows[new])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), *[batch.column(c).take(rows) for c in ("cid", "copies", "vector", "keys")]], names=["bucket", "cid", "copies", "vector", "keys"])


def bucket_links(bucket: int, x: np.ndarray, keys: np.ndarray, part: np.ndarray, min_cosine: float):
    """(i, j) arrays of the pairs of a bucket, or of two parts of it, at min_cosine whose first shared bucket it is."""
    table = bucket >> KEY_BITS
    two = len(np.unique(part)) > 1
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x[at:].T >= min_cosine
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        keep = i < j
        if two:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            for t in range(table):
                fresh = ~(keys[a, t][:, :, None] == keys[b, t][:, None, :]).any(axis=(1, 2))
                a, b = a[fresh], b[fresh]
            shared = np.where(keys[a, table][:, :, None] == keys[b, table][:, None, :], keys[a, table][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2), initial=np.iinfo(np.int64).max)
            yield a[shared == bucket], b[shared == bucket]


def _verify(tables: int, dtype: str, min_cosine: float):
    def run(batches):
        forest, held = Forest(), None

        def links(table: pa.Table) -> pa.RecordBatch:
            bucket, tile, cid, copies = (table.column(c).to_numpy() for c in ("bucket", "tile", "cid", "copies"))
            part = table.column("part").to_numpy()
            vectors, keys = table.column("vector").to_pylist(), table.column("keys").to_pylist()
            size = np.array([len(v) for v in vectors])
            # vectors of different lengths meet by a chance of their keys only
            order = np.lexsort((size, tile, bucket))
            if (order[1:] < order[:-1]).any():
                bucket, tile, cid, copies, part, size = (x[order] for x in (bucket, tile, cid, copies, part, size))
                vectors, keys = [vectors[i] for i in order], [keys[i] for i in order]
            start = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1]) | (size[1:] != size[:-1])))
            count = np.zeros(len(bucket), np.int64)
            edges = []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True):
                if hi - lo < 2:
                    continue
                x = units(np.frombuffer(b"".join(vectors[lo:hi]), dtype).reshape(hi - lo, -1))
                k = np.frombuffer(b"".join(keys[lo:hi]), np.int64).reshape(hi - lo, tables, -1)
                for i, j in bucket_links(int(bucket[lo]), x, k, part[lo:hi], min_cosine):
                    np.add.at(count, lo + i, copies[lo + j])
                    np.add.at(count, lo + j, copies[lo + i])
                    edges += [e for e in zip(cid[lo + i].tolist(), cid[lo + j].tolist(), strict=True) if forest.join(*e)]
            some = np.flatnonzero(count)
            a = np.concatenate([cid[some], np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(some) + [e[1] for e in edges], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
            bucket, tile = held.column("bucket").to_numpy(), held.column("tile").to_numpy()
            cut = int(np.flatnonzero((bucket == bucket[-1]) & (tile == tile[-1]))[0])  # the last run may go on
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield links(held)

    return freed(run)


def embedding_groups(embeddings: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector. hashes: of each table; without it, as many as shape() says."""
    ws = Workspace(embeddings.sparkSession)
    e = F.col(vector_col)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.when(valid, F.xxhash64(e)).alias("cid"), e.alias("e"))
    classes = ws.save(rows.where("cid is not null").groupBy("cid").agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "classes")
    n = classes.count()
    dtype = "<f4" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "<f8"
    keyed = spread(classes, "cid").select("cid", "copies", "e").mapInArrow(_keys(n, hashes, dtype), "cid long, copies long, vector binary, keys binary")
    entries = keyed.mapInArrow(_entries, "bucket long, cid long, copies long, vector binary, keys binary")
    sizes = entries.groupBy("bucket").count().where(F.col("count") > TILE).withColumn("parts", F.ceil(F.col("count") / TILE).cast("int")).drop("count")
    sizes = ws.save(sizes, "large")
    entries = entries.join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.withColumn("part", F.pmod(F.hash("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    entries = entries.withColumn("other", other).withColumn("tile", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    entries = entries.select("bucket", "tile", "part", "cid", "copies", "vector", "keys")
    linked = entries.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(_verify(TABLES, dtype, min_cosine), "a long, b long, n long")
    linked = ws.save(linked, "linked")
    ws.release()
    counts = linked.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(linked.where("b is not null").select("a", "b"), ws)
    placed = classes.drop("e").join(roots, classes.cid == roots.v, "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = ws.save(placed.join(least, "root").join(counts, "cid", "left").select("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "placed")
    found = rows.select("vec_id", "cid").join(placed, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
