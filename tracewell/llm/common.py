"""Helpers that the operators of this subpackage share.

Texts move between the JVM and Python in Arrow batches of the session's bounds
(`small_batches` lowers them for a pipeline); tasks work on slices of them, so
that a run of very long texts cannot fill a Python worker's memory.  A single
text is never cut.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of an Arrow batch in a pipeline; a batch ends with the row that passes them.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(it: Iterator[pa.RecordBatch], column: str, size: int, row: int = 32) -> Iterator[pa.RecordBatch]:
    """Spark's Arrow batches (64 MB at most by default) in slices of about `size` bytes of a text or binary column.

    Slices share the batch's memory; what a task computes for one is bounded
    without a change of the session's settings.  One text is never cut; each row
    counts as `row` bytes more than its text.
    """
    for b in it:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + row)
        at, before = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(at, to - at)
            at, before = to, int(ends[to - 1])
    _give_back()


def _give_back() -> None:
    """Return a worker's free memory at the end of a partition, as Spark keeps the worker for others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(fn):
    """fn of one table or two for applyInArrow; after each group the worker returns its free memory."""

    def one(t: pa.Table) -> pa.Table:
        try:
            return fn(t)
        finally:
            _give_back()

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return fn(a, b)
        finally:
            _give_back()

    return one if fn.__code__.co_argcount == 1 else two  # Spark counts the arguments


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ARROW_BYTES, unless the session names a bound itself.

    A batch is held by the JVM outside its heap, in buffers that double as they
    fill, and again by the Python worker.  What the C library has once handed to
    a JVM's threads for buffers of many MB stays with the executor, so stages of
    one session add up.  The rows and results are the same for any bound.
    """
    if ARROW_BATCH not in spark.conf.getAll:
        spark.conf.set(ARROW_BATCH, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir.  Only a local session, as in
    tests, may do without: driver and tasks are one machine there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            base = given.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file:///tmp/checkpoints/tracewell"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"


@contextmanager
def _own_shuffles(spark: SparkSession):
    """Have Spark delete a write's shuffle files as soon as the write has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and
    the shuffle files behind df go at once.  `forget` deletes the folder.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        spark, name = df.sparkSession, getattr(df, "stored_at", None)
        if name is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def let(value, body):
    """body(value) with value computed once for a row, inside one expression."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(col):
    return F.translate(col, UPPER, UPPER.lower())


def words(text):
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text (native)."""
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * 5), " "), lambda w: w != "")
