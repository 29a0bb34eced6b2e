"""Shared helpers: reading tables, the cluster's shared folder, bounded slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python operator works on at once; a longer text is a step of its own.
SLICE_BYTES = 1_000_000


#: Rows of an Arrow batch: texts are long, and a batch stands in the JVM's memory and in the worker's.
ARROW_ROWS = 2_000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Ask the session for Arrow batches of ARROW_ROWS rows, unless it has a number of its own (Spark's is 10,000). Results don't depend on it."""
    if spark.conf.get(_ARROW_SETTING) == "10000":
        spark.conf.set(_ARROW_SETTING, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by a session with small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none, as in local tests, a temporary folder is made
    and set; on a cluster that would not be seen by other machines, so it is refused there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="waymark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    Files belong to the enclosing scratch() block, if there is one, and go with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    if _OWNERS:
        _OWNERS[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns what stored() writes inside the block and deletes it at the end; for results that were written elsewhere by then."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark knows; a folder that isn't there is none of its business."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterable[pa.RecordBatch], text_at: int, most: int = SLICE_BYTES, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows into pieces with at most that many rows and bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, at: int) -> list[str]:
    """A column of texts as Python strings, null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def without_gc(f: Callable) -> Callable:
    """For a generator over batches: no cyclic collection while it runs, as its many small objects hold no cycles; then freed memory is given back."""

    @functools.wraps(f)
    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from f(batches)
        finally:
            if was:
                gc.enable()
            _give_back()

    return run


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """A worker's own copy of what make() builds, kept for later tasks; of one operator (the key's first part) at a time, so that a reused worker doesn't gather the tables of all."""
    if key not in _HELD:
        for other in [k for k in _HELD if k[0] != key[0]]:
            del _HELD[other]
        _HELD[key] = make()
    return _HELD[key]
