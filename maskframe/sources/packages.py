"""Packages: samples as Parquet by split, with one row of attributes beside them.

A package is a folder with ``samples`` (partitioned by split) and ``attrs`` (JSON).  It is written
beside its place, checked there, and moved in whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def attributes(samples: DataFrame, dataset_name: str, dataset_type: str) -> DataFrame:
    """The row of attributes: name, type, counts, label names."""
    return samples.agg(
        F.count("*").alias("n_samples"), F.count_distinct(F.coalesce("subject_id", "sample_id")).alias("n_subjects"), F.array_sort(F.collect_set("split")).alias("splits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("label_names")))).alias("label_names"),
    ).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(dataset_name).alias("dataset_name"), F.lit(dataset_type).alias("dataset_type"), "*")


def check_target(spark: SparkSession, path: str, overwrite: bool) -> None:
    """A target may be there only with ``overwrite``, and only if it is a package."""
    fs, target, hadoop = _fs(spark, path)
    if fs.exists(target) and not (overwrite and fs.exists(hadoop(path, "attrs"))):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    fs, target, _ = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def write_package(samples: DataFrame, path: str, dataset_name: str, dataset_type: str = "xray", overwrite: bool = False) -> None:
    """Write, check and move in a package; an existing one is replaced only with ``overwrite`` and if it is a package."""
    spark = samples.sparkSession
    check_target(spark, path, overwrite)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    samples.write.partitionBy("split").parquet(f"{beside}/samples")
    move_in(spark, beside, path, dataset_name, dataset_type)


def move_in(spark: SparkSession, beside: str, path: str, dataset_name: str, dataset_type: str) -> None:
    """Add attributes to the samples of a folder, check them, and put the folder in the place of ``path``."""
    fs, target, hadoop = _fs(spark, path)
    attributes(spark.read.parquet(f"{beside}/samples"), dataset_name, dataset_type).coalesce(1).write.json(f"{beside}/attrs")
    found = [r["issue"] for r in package_issues(spark, beside).limit(20).collect()]
    if found:
        fs.delete(hadoop(beside), True)
        raise ValueError("; ".join(found))
    old = f"{beside}.old"
    if fs.exists(target):
        fs.rename(target, hadoop(old))
    if not fs.rename(hadoop(beside), target):
        if fs.exists(hadoop(old)):
            fs.rename(hadoop(old), target)
        raise OSError(f"can't move {beside} to {path}")
    if fs.exists(hadoop(old)):
        fs.delete(hadoop(old), True)


def read_package(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Samples of a package; a split is pruned to its folder, unused columns are not read."""
    samples = spark.read.parquet(f"{path}/samples")
    return samples if split is None else samples.where(F.col("split") == split)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("schema_version int, dataset_name string, dataset_type string, n_samples long, n_subjects long, splits array<string>, label_names array<string>").option("mode", "FAILFAST").json(f"{path}/attrs")


def package_issues(spark: SparkSession, path: str) -> DataFrame:
    """key, issue of a stored package: repeated samples, leaking subjects, counts that differ from the attributes."""
    samples, attrs = read_package(spark, path), read_attributes(spark, path)
    now = samples.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("subject_id", "sample_id")).alias("s"))
    counts = attrs.join(F.broadcast(now)).where("n <> n_samples OR s <> n_subjects").select(F.col("dataset_name").alias("key"), F.lit("counts differ from attributes").alias("issue"))  # one row
    repeated = samples.groupBy("sample_id").count().where("count > 1").select(F.col("sample_id").alias("key"), F.lit("sample_id stands twice").alias("issue"))
    leaks = samples.groupBy(F.coalesce("subject_id", "sample_id").alias("key")).agg(F.count_distinct("split").alias("n")).where("n > 1").select("key", F.lit("subject in several splits").alias("issue"))
    version = attrs.where(F.col("schema_version") != SCHEMA_VERSION).select(F.col("dataset_name").alias("key"), F.lit("schema version").alias("issue"))
    return counts.unionByName(repeated).unionByName(leaks).unionByName(version)


def inspect_package(spark: SparkSession, path: str) -> DataFrame:
    """split, n_samples, n_subjects."""
    return read_package(spark, path).groupBy("split").agg(F.count("*").alias("n_samples"), F.count_distinct(F.coalesce("subject_id", "sample_id")).alias("n_subjects"))


def write_artifacts(predictions: DataFrame, path: str, label_names: list[str]) -> None:
    """Prediction rows (stem, kind, shape, data) as Parquet by kind; an existing folder must have the same label names."""
    spark = predictions.sparkSession
    fs, sidecar, _ = _fs(spark, f"{path}/label_names")
    if fs.exists(sidecar):
        had = [r[0] for r in spark.read.json(str(sidecar)).orderBy("pos").select("label").collect()]
        if had != label_names:
            raise ValueError(f"{path} has labels {had}")
    elif fs.exists(sidecar.getParent()):
        raise ValueError(f"{path} holds artifacts without label names")
    else:
        spark.createDataFrame(list(enumerate(label_names)), "pos int, label string").coalesce(1).write.json(f"{path}/label_names")
    predictions.write.mode("append").partitionBy("kind").parquet(f"{path}/arrays")
