"""What the operators of this subpackage have in common: a shared work folder, written tables, text input."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a single-JVM session may go without; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyport-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _nothing(rows) -> None:
    pass


def freed(run):
    """A function of Arrow batches, after which the worker gives unused memory back to the system: other tasks reuse the worker beside a JVM that
    has its own needs."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return wrapped


@contextmanager
def arrow_batches(spark: SparkSession, most: int = 8 << 20):
    """While tables are written, tasks hand Python batches of `most` bytes: each is held by the JVM and by Python, twice while it grows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """Tables written to the shared folder, which cut the lineage: a lost executor costs no upstream stage.

    Tables still there when the program ends are removed then; drop() removes one earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tallyport-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with arrow_batches(self.spark):
            df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans whose results are written, so that they don't add up.

        The scheduler's threads refer to the last job until there is another; an empty one frees it.
        """
        self.spark.range(0, 1, 1, 1).foreachPartition(_nothing)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may have gone before
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table of fewer partitions than cores out by key; leave any larger one as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def text_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), and nothing else of the input."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def groups(texts: pa.Array, most: int = 8_000_000):
    """(first, last + 1) of runs of consecutive texts of about `most` bytes; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def parts(batches, most: int = 8_000_000):
    """Arrow batches in slices of about `most` bytes of text, so that what is made of a slice stays small."""
    for batch in batches:
        for lo, hi in groups(batch.column("text"), most):
            yield batch.slice(lo, hi - lo)
