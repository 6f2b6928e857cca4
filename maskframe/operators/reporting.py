"""Run-level aggregation of metric records, and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def phase_means(records: DataFrame) -> DataFrame:
    """key, metric, value: weighted means over everything and for each dataset (key ``dataset/``), from
    records(dataset, metric, value, weight); records of weight 0 count for nothing and leave no key."""
    sums = records.where("weight <> 0").groupingSets([["metric"], ["dataset", "metric"]], "dataset", "metric").agg(
        F.grouping_id().alias("g"), (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value")
    )
    overall = F.col("g").bitwiseAND(F.lit(2)) > 0
    return sums.select(F.when(overall, F.col("metric")).otherwise(F.concat_ws("/", "dataset", "metric")).alias("key"), "metric", "value")


def evaluation_means(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean score of each dataset over its eligible images (0 if none), and the unweighted mean of those by evaluation set."""
    by_dataset = images.groupBy("eval_set", "dataset").agg(F.coalesce(F.avg(F.when(F.col("eligible"), F.col("score"))), F.lit(0.0)).alias("dice"))
    return by_dataset, by_dataset.groupBy("eval_set").agg(F.avg("dice").alias("dice"))


def phase_label(phase: str = "phase", dataset: str = "dataset") -> Column:
    return F.concat_ws("/", F.col(phase), F.nullif(F.col(dataset), F.lit("")))


def metrics_table(records: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """epoch, metric and one column a phase label: the last value that is not null.

    records(epoch, phase, dataset, metric, value, pos).  Naming the phases saves a pass.
    """
    labelled = records.withColumn("label", phase_label()).where("value IS NOT NULL")
    return labelled.groupBy("epoch", "metric").pivot("label", phases).agg(F.max_by("value", "pos"))


def metric_order(records: DataFrame) -> DataFrame:
    """Metrics in the order of first appearance."""
    return records.groupBy("metric").agg(F.min("pos").alias("first"))


def every_nth(n: int, index: str = "idx", last: str = "is_last") -> Column:
    """The first, every n-th and the last batch, idx from 0."""
    return (F.col(index) == 0) | ((F.col(index) + 1) % n == 0) | F.col(last)


def evaluates(epoch: str, every: int, epochs: int) -> Column:
    """Whether an epoch (from 1) is evaluated: every n-th and the last."""
    return (F.col(epoch) % every == 0) | (F.col(epoch) == epochs)


def moving_average(values: DataFrame, decay: float, start_after: int = 0, every: int = 1) -> DataFrame:
    """name, step, shadow: decayed averages over steps, the first value copied; steps up to start_after and between updates are skipped.

    values(name, step, value).  A value counts (1 - d) d^(later updates), the first d^(all later
    ones): sums over blocks of updates so long that whatever lies two blocks back has vanished in
    double precision, and no sequential pass.
    """
    used = values.where((F.col("step") > start_after) & (F.col("step") % every == 0))
    size = max(1, int(300 / max(-math.log(decay), 1e-12)))
    k = F.row_number().over(Window.partitionBy("name").orderBy("step")) - 1
    d = F.lit(float(decay))
    at = used.withColumn("k", k).withColumn("block", F.floor(F.col("k") / size)).withColumn("r", F.col("k") % size)
    part = F.col("value") * F.pow(d, -F.col("r")) * F.when(F.col("k") == 0, 1.0).otherwise(1.0 - d)
    local = at.withColumn("local", F.pow(d, F.col("r")) * F.sum(part).over(Window.partitionBy("name", "block").orderBy("k")))
    ends = local.groupBy("name", "block").agg(F.max_by("local", "k").alias("before")).withColumn("block", F.col("block") + 1)
    return local.join(ends, ["name", "block"], "left").select("name", "step", (F.col("local") + F.coalesce(F.col("before") * F.pow(d, F.col("r") + 1), F.lit(0.0))).alias("shadow"))


def label_statistics(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """count, fraction, mean and largest probability of each image and label inside its content box.

    pixels(image, label, y, x, p, y0, x0, y1, x1); a pixel is in the mask from ``threshold`` on.
    """
    inside = pixels.where("y >= y0 AND y < y1 AND x >= x0 AND x < x1")
    n = F.count_if(F.col("p") >= threshold)
    return inside.groupBy("image", "label").agg(n.alias("pixel_count"), (n / F.count("*")).alias("pixel_fraction"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))


def centroids(voxels: DataFrame) -> DataFrame:
    """Mean place of each positive label of each sample: voxels(sample_id, label, i, j, k)."""
    return voxels.where("label > 0").groupBy("sample_id", "label").agg(F.avg("i").alias("i"), F.avg("j").alias("j"), F.avg("k").alias("k"), F.count("*").alias("n"))
