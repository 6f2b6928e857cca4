"""Manifests made from folders and from rendered views, ready for the package writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import selection

#: Shares of train, val and test by type of dataset, and suffixes of their files.
SHARES = {"xray-seg": {"train": 70, "val": 15, "test": 15}, "ct-seg": {"train": 90, "val": 10, "test": 0}}
SUFFIXES = {"xray-seg": (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".npy"), "ct-seg": (".nii.gz", ".nii", ".npy")}
#: Columns that describe a view's camera, as far as the views have them.
CAMERA = ("sdd", "delx", "dely", "x0", "y0", "rot", "xyz", "orthographic")


def scaffold(images: DataFrame, masks: DataFrame, dataset_type: str, shares: dict[str, int] | None = None, subject_regex: str | None = None) -> DataFrame:
    """Samples of images(path) and masks(path) that share a stem: sample_id, subject_id, split, image, label.

    The subject is what the first group of the pattern matches of the stem, or the stem; one that
    it does not match raises.  Subjects are split by the shares, never over two splits.
    """
    if dataset_type not in SHARES:
        raise ValueError(f"{dataset_type!r} is none of {', '.join(SHARES)}")
    stems = lambda df: selection.stems(df, SUFFIXES[dataset_type], "path").withColumn("stem", F.element_at(F.split("stem", "/"), -1))
    pairs = stems(images).join(stems(masks).withColumnRenamed("path", "mask_path"), "stem")
    subject = F.col("stem")
    if subject_regex is not None:
        found = F.regexp_extract("stem", subject_regex, 1)
        # the mask's path keeps the check above the join: files without a partner are not asked
        subject = F.when(found == "", F.raise_error(F.concat(F.lit("no subject in the stem of "), F.col("path"), F.lit(" and "), F.col("mask_path"))).cast("string")).otherwise(found)
    samples = pairs.select(F.col("stem").alias("sample_id"), subject.alias("subject_id"), F.col("path").alias("image"), F.col("mask_path").alias("label"))
    splits = selection.subject_splits(samples.select(F.col("subject_id").alias("subject")).distinct(), shares or SHARES[dataset_type])
    return samples.join(splits.withColumnRenamed("subject", "subject_id"), "subject_id").select("sample_id", "subject_id", "split", "image", "label")


def observed_labels(masks: DataFrame, data: str = "data") -> DataFrame:
    """native_id, native_label of the ids that masks hold: 0 is background, others label_<id>; ids that are not whole raise."""
    ids = masks.select(F.explode(F.array_distinct(data)).alias("x")).distinct()
    whole = F.when(F.col("x") != F.floor("x"), F.raise_error(F.lit("label ids are not whole")).cast("int")).otherwise(F.col("x").cast("int"))
    return ids.select(whole.alias("native_id")).select("native_id", F.when(F.col("native_id") == 0, "background").otherwise(F.concat(F.lit("label_"), F.col("native_id"))).alias("native_label"))


def write_manifest(samples: DataFrame, path: str, head: dict) -> None:
    """A manifest as a folder: ``head`` (one JSON document) and ``samples`` (JSON lines in parts), so no task holds them all."""
    spark = samples.sparkSession
    samples.write.json(f"{path}/samples")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")


def read_head(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/head").first()[0])


def view_stem(sample: str = "sample_id", render: str = "render_index", view: str = "view_index") -> Column:
    return F.format_string("%s__r%03d_v%02d", F.col(sample), F.col(render), F.col(view))


def rendered_samples(views: DataFrame, dataset_name: str, label_names: list[str], split: str = "train") -> DataFrame:
    """Samples with payloads of rendered views, for ``package_sink.write_payload_package``.

    views(sample_id, subject_id, render_index, view_index, height, width, image array, mask
    [channel][pixel], and camera columns).  Masks of whole numbers are uint8, others float16;
    metadata names the source and the camera.
    """
    hard = ~F.exists("mask", lambda c: F.exists(c, lambda x: x != F.rint(x)))
    shape = lambda n: F.array(n, F.col("height"), F.col("width")).cast("array<int>")
    payload = lambda dtype, n, data: F.struct(dtype.alias("dtype"), shape(n).alias("shape"), data.cast("array<double>").alias("data"))
    text = lambda c: F.to_json(c) if dict(views.dtypes)[c].startswith(("array", "struct")) else F.col(c).cast("string")
    source = [("source_sample_id", F.col("sample_id").cast("string")), *((c, F.col(c).cast("string")) for c in ("render_index", "view_index")), *((c, text(c)) for c in CAMERA if c in views.columns)]
    return views.select(
        view_stem().alias("sample_id"), "subject_id", F.lit(split).alias("split"), F.lit(dataset_name).alias("dataset_name"), F.lit("xray").alias("modality"),
        F.array(*map(F.lit, label_names)).alias("label_names"), payload(F.lit("float32"), F.lit(1), F.col("image")).alias("image"),
        payload(F.when(hard, "uint8").otherwise("float16"), F.size("mask"), F.flatten("mask")).alias("label"), F.create_map(*(x for k, v in source for x in (F.lit(k), v))).alias("metadata"),
    )
