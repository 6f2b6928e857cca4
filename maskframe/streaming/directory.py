"""A directory job: files of a folder, each worked on once however often the job is run.

The folder is a file stream, so what was taken is remembered in the job's checkpoint.  Each batch
is written to a folder named by its number, which is overwritten if the batch is done again after a
loss: no file is missed and none stands twice.  Files that can't be worked on stay as error rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def run_directory(
    spark: SparkSession, source: str, output: str, work: Callable[[DataFrame], DataFrame], settings: dict[str, str] | None = None, files_per_batch: int = 1000, recursive: bool = False, glob: str | None = None
) -> int:
    """Work on the files of ``source`` that the job has not taken yet; returns the number of batches done.

    work: files (path, modificationTime, length, content) to rows with an ``error`` column, null for
    good ones.  settings (label names, thresholds): kept with the output; a job with other ones is
    refused, as its rows would not fit those that are there.
    """
    _settle(spark, output, settings or {})
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", recursive)
    files = (stream if glob is None else stream.option("pathGlobFilter", glob)).load(source)

    def write(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(f"{output}/rows/batch={number}")

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def _settle(spark: SparkSession, output: str, settings: dict[str, str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/settings")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        had = json.loads(spark.read.text(f"{output}/settings", wholetext=True).first()[0])
        if had != settings:
            raise ValueError(f"{output} was made with other settings: {had}")
    elif fs.exists(path.getParent()):
        raise ValueError(f"{output} holds something else than a job's output")
    else:
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{output}/settings")


def results(spark: SparkSession, output: str, failed: bool = False) -> DataFrame:
    """Rows of all batches so far, good ones or those with an error; the other kind's folders are not read."""
    return spark.read.parquet(f"{output}/rows").where(F.col("failed") == failed)
