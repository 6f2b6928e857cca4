"""What the operators share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a temporary one is made and set, but only if the session runs on this
    machine alone: no executor of a cluster would see it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete the checkpoints of tables made by ``cut`` that nothing will read again."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove_folder(df.sparkSession, file.get())


#: The one thing that this worker process keeps between tasks, by its key.
_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each worker process.

    A process keeps only the last such thing: workers go from operator to operator, and what one
    of them remembers would be held while the next one works.
    """
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of what the process keeps, and give the memory back to the system."""
    _kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """``function`` turns each record batch into batches of ``schema``.

    keeps: the start of the keys it asks ``kept`` for; all else that a worker keeps is let go first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(not keeps or not key.startswith(keeps) for key in _kept):
            release()
        for batch in batches:
            yield from function(batch)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``function`` turns all record batches of a partition into batches of ``schema``.

    The session's batches are brought down to BATCH_BYTES, if they are larger, for good: texts
    differ in length a thousandfold, so a number of rows does not bound a batch, and Spark reads the
    setting only when the result is computed.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    """A size setting in bytes; 0 for what is not a plain number or one with k, m or g."""
    digits = setting.lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 1)
    digits = digits.rstrip("kmg")
    return int(digits) * factor if digits.isdigit() else 0


def text_groups(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about so many characters of text, or one longer document; nulls as empty texts."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > chars:
            yield batch.slice(lo, k - lo), texts[lo:k]
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield batch.slice(lo), texts[lo:]


def crc32_mod3(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3
