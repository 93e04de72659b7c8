"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one task holds as Python objects at a time.
SLICE_BYTES = 4 << 20


T = TypeVar("T")
_resident: dict[Hashable, object] = {}


def resident(key: Hashable, build: Callable[[], T]) -> T:
    """What ``build`` makes, kept for this worker's next tasks. A reused worker holds one such thing: another key drops it."""
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = build()
        give_back()
    return _resident[key]


def give_back() -> None:
    """Returns free memory to the system, so that what a reused worker once needed is not held by all later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches; the memory it leaves free goes back at the end of the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and ``text`` with null as the empty string."""
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where the session names none, a folder of this machine, if it is the only one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wayline-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows read from a table of their own in the shared folder, and its path.

    Unlike a checkpoint it has a true size; the sizes that Spark guesses for joins of checkpoints multiply with every step of a loop.
    """
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing depends on any more."""
    context = spark.sparkContext
    for path in map(context._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text; one row at least."""
    sizes = batch.column(column)
    start = held = 0
    lengths = pa.compute.binary_length(sizes).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if len(lengths) > start:
        yield batch.slice(start)
