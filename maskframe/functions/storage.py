"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or a temporary one where the session runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskframe-")
    return f"{base}/{uuid.uuid4().hex}"


class Written:
    """Tables written under one folder, which ``clear`` deletes when nothing reads them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read from there on."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
