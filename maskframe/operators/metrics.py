"""Segmentation metrics and losses, with their reductions.

The table is ``images(sample_id, pred, target)``: both [channel][pixel] arrays of one image.
Everything up to a score for each sample and class stays in the row; reductions are grouped sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskframe.functions import kernels
from maskframe.functions.arrays import ColumnLike, added, argmax, bind, bind_fields, col, dot, folded, sequence0, total, transpose
from maskframe.functions.normalise import sigmoid, softmax

EPS = 1e-7


# -- from predictions to channels -------------------------------------------------------------------

def channels(images: DataFrame, mode: str = "binary", threshold: float | None = 0.5, from_logits: bool = False) -> DataFrame:
    """sample_id, class_id, p, t: one row a channel.

    binary: every channel by itself; p > threshold and t > 0.5 if a threshold is given.
    onehot: channels are classes of one pixel; with a threshold (whatever its value) the largest
    becomes 1, in prediction and target.  multiclass: as onehot, target an array of class ids in
    its first channel.  NaN or infinite predictions raise.
    """
    pred, target = F.col("pred").cast("array<array<double>>"), F.col("target").cast("array<array<double>>")
    n = F.size(pred)
    if from_logits:
        pred = F.transform(pred, lambda c: F.transform(c, sigmoid)) if mode == "binary" else transpose(F.transform(transpose(pred), softmax))
    if mode == "multiclass":
        target = F.transform(sequence0(n), lambda k: F.transform(F.get(target, F.lit(0)), lambda x: F.when(x == k, 1.0).otherwise(0.0)))
    if threshold is not None:
        if mode == "binary":
            pred = F.transform(pred, lambda c: F.transform(c, lambda x: F.when(x > threshold, 1.0).otherwise(0.0)))
            target = F.transform(target, lambda c: F.transform(c, lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)))
        else:
            pred, target = _hard(pred), _hard(target)
    bad = F.exists("pred", lambda c: F.exists(c.cast("array<double>"), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = images.select("sample_id", F.when(bad, F.raise_error("predictions that are not finite").cast("array<array<double>>")).otherwise(pred).alias("p"), target.alias("t"))
    return rows.select("sample_id", F.posexplode(F.arrays_zip("p", "t")).alias("class_id", "x")).select("sample_id", "class_id", "x.p", "x.t")


def _hard(a: Column) -> Column:
    winners = lambda m: bind_fields(lambda s: F.transform(sequence0(s["n"]), lambda k: F.transform(s["best"], lambda b: F.when(b == k, 1.0).otherwise(0.0))), n=F.size(m), best=F.transform(transpose(m), argmax))
    return bind(a, winners)


# -- scores by sample and class ------------------------------------------------------------------------

def dice(rows: DataFrame, smooth: float = 1e-7, eps: float = EPS) -> DataFrame:
    """score = (2 |P and T| + smooth) / max(|P| + |T| + smooth, eps), and amount, |T|; 1 where both are empty, unless smooth is 0."""
    inter, p, t = dot("p", "t"), total("p"), total("t")
    return rows.select("sample_id", "class_id", ((2 * inter + smooth) / F.greatest(p + t + smooth, F.lit(eps))).alias("score"), t.alias("amount"))


def soft_dice(rows: DataFrame, smooth: float = 1e-7, eps: float = EPS, square: bool = True, weight: str | None = None) -> DataFrame:
    """Dice of probabilities, pixels weighted by the array ``weight``; squares in the denominator by default."""
    w = F.col(weight) if weight else F.transform("t", lambda x: F.lit(1.0))
    squares = lambda a: F.transform(a, lambda x: x * x) if square else F.col(a)
    inter = dot(F.zip_with("p", "t", lambda x, y: x * y), w)
    down = dot(squares("p"), w) + dot(squares("t"), w)
    return rows.select("sample_id", "class_id", ((2 * inter + smooth) / F.greatest(down + smooth, F.lit(eps))).alias("score"), total("t").alias("amount"))


def surface(mask: ColumnLike, width: ColumnLike) -> Column:
    """(y, x) of the positive pixels of a row-major mask with a 4-neighbour outside; beyond the border counts as outside."""
    m, w = col(mask), col(width).cast("int")
    h = (F.size(m) / w).cast("int")
    on = lambda y, x: F.when((y < 0) | (x < 0) | (y >= h) | (x >= w), False).otherwise(F.get(m, y * w + x) > 0)
    points = F.transform(F.filter(sequence0(F.size(m)), lambda i: F.get(m, i) > 0), lambda i: F.struct(F.floor(i / w).cast("int").alias("y"), (i % w).alias("x")))
    inner = lambda q: on(q["y"] - 1, q["x"]) & on(q["y"] + 1, q["x"]) & on(q["y"], q["x"] - 1) & on(q["y"], q["x"] + 1)
    return F.filter(points, lambda q: ~inner(q))


@F.pandas_udf(T.DoubleType())
def _hausdorff95(p: pd.Series, t: pd.Series, width: pd.Series) -> pd.Series:
    lit = lambda m, w: np.asarray(m, float).reshape(-1, int(w)) > 0
    return pd.Series([None if a is None or b is None else kernels.hausdorff95(lit(a, w), lit(b, w)) for a, b, w in zip(p, t, width)], dtype=float)


def hd95(rows: DataFrame, width: str = "width") -> DataFrame:
    """95th percentile Hausdorff distance, the larger of the two directed ones; rows are 0/1 masks p and t with their width.

    Both empty: 0.  One empty: the diagonal of the grid between pixel centres.  Distances come from
    an exact transform of each outline, so an image's work is linear in its pixels.
    """
    return rows.select("sample_id", "class_id", _hausdorff95("p", "t", F.col(width).cast("int")).alias("score"), total("t").alias("amount"))


# -- reductions -------------------------------------------------------------------------------------------

def weigh(scores: DataFrame, weights: DataFrame | None = None, ignore_index: list[int] | None = None, ignore_empty: bool = False, ignore_background: bool = False) -> DataFrame:
    """scores with ``weight``: class weights(class_id, weight) or 1, 0 for ignored classes and, if asked, for empty
    targets; the background's is 0 where any other class of the sample has a positive weight."""
    out = scores.join(weights, "class_id", "left") if weights is not None else scores.withColumn("weight", F.lit(1.0))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    if ignore_index:
        w = F.when(F.col("class_id").isin(ignore_index), 0.0).otherwise(w)
    if ignore_empty:
        w = w * F.when(F.col("amount") > 0, 1.0).otherwise(0.0)
    out = out.withColumn("weight", w)
    if ignore_background:
        rest = F.max(F.when(F.col("class_id") > 0, F.col("weight"))).over(Window.partitionBy("sample_id"))
        out = out.withColumn("weight", F.when((F.col("class_id") == 0) & (F.coalesce(rest, F.lit(0.0)) > 0), 0.0).otherwise(F.col("weight")))
    return out


def reduce_classes(scores: DataFrame, reduction: str = "mean") -> DataFrame:
    """One value a sample: weighted mean (null if all weights are 0), weighted sum, or for none one row a class, times its weight."""
    if reduction == "none":
        return scores.select("sample_id", "class_id", (F.col("score") * F.col("weight")).alias("score"))
    s, w = F.sum(F.col("score") * F.col("weight")), F.sum("weight")
    return scores.groupBy("sample_id").agg((F.when(w > 0, s / w) if reduction == "mean" else s).alias("score"))


def reduce_batch(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over samples that have a value, 0 if none has."""
    grouped = samples.groupBy(*(by or []))
    return grouped.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))


def eligible_count(rows: DataFrame) -> DataFrame:
    """Images with any target above 0.5."""
    return rows.groupBy("sample_id").agg(F.max(F.array_max("t")).alias("top")).agg(F.count_if(F.col("top") > 0.5).alias("n"))


def area_filtered(scores: DataFrame, pixels: int | Column, min_fraction: float) -> DataFrame:
    """Mean of foreground scores of each sample, over classes that cover min_fraction of its pixels; samples without one go."""
    big = (F.col("class_id") > 0) & (F.col("amount") > 0) & (F.col("amount") / pixels >= min_fraction)
    return scores.where(big).groupBy("sample_id").agg(F.avg("score").alias("score"))


# -- losses ---------------------------------------------------------------------------------------------------

def soft_dice_loss(score: ColumnLike, log: bool = False, eps: float = EPS) -> Column:
    return -F.ln(F.greatest(col(score), F.lit(eps))) if log else 1.0 - col(score)


def bce(p: ColumnLike, t: ColumnLike, from_logits: bool = True) -> Column:
    """Binary cross-entropy of arrays, pixel by pixel."""
    if from_logits:
        return F.zip_with(col(p), col(t), lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))
    floor = lambda v: F.greatest(F.when(v > 0, F.ln(v)).otherwise(F.lit(-100.0)), F.lit(-100.0))
    return F.zip_with(col(p), col(t), lambda x, y: -(y * floor(x) + (1 - y) * floor(1 - x)))


def categorical_cross_entropy(images: DataFrame, from_logits: bool = True, class_weights: list[float] | None = None, ignore_index: int | None = None) -> DataFrame:
    """sample_id, loss array: one-hot targets; predictions are logits or log probabilities; pixels of the ignored class are 0."""
    pred, target = F.col("pred").cast("array<array<double>>"), F.col("target").cast("array<array<double>>")
    if from_logits:  # log softmax, channel by channel: neither pixels nor channels are looked up one by one
        top = folded(pred, lambda x, y: F.greatest(x, y))
        norm = lambda m: F.zip_with(m["top"], added(F.transform(m["pred"], lambda c: F.zip_with(c, m["top"], lambda x, t: F.exp(x - t)))), lambda t, s: t + F.ln(s))
        logs = bind_fields(lambda m: bind_fields(lambda z: F.transform(z["pred"], lambda c: F.zip_with(c, z["norm"], lambda x, n: x - n)), pred=m["pred"], norm=norm(m)), pred=pred, top=top)
    else:
        logs = pred

    def loss(m: Column) -> Column:
        terms = F.zip_with(m["target"], m["logs"], lambda t, p: F.zip_with(t, p, lambda x, y: -x * y))
        if class_weights:
            weights = F.array(*map(F.lit, map(float, class_weights)))
            terms = F.zip_with(terms, weights, lambda c, w: F.transform(c, lambda x: x * w))
        if ignore_index is None:
            return added(terms)
        return F.zip_with(added(terms), F.get(m["target"], F.lit(ignore_index)), lambda x, t: F.when(t > 0, 0.0).otherwise(x))

    return images.select("sample_id", bind_fields(loss, target=target, logs=logs).alias("loss"))


def reduce_pixels(loss: ColumnLike, weights: ColumnLike | None = None, reduction: str = "mean") -> Column:
    """An array of losses as one: mean, or with weights their sum over max(sum of weights, 1); or the sum."""
    if weights is None:
        return F.try_divide(total(loss), F.size(col(loss))) if reduction == "mean" else total(loss)
    up = dot(loss, weights)
    return up / F.greatest(total(weights), F.lit(1.0)) if reduction == "mean" else up


def channel_keep(rows: DataFrame, ignore_empty: bool = False, known_negatives: list[int] | None = None, ignore_background: bool = False) -> DataFrame:
    """rows with ``keep`` (0 or 1): non-empty targets or known negatives, and no background where the sample has foreground."""
    amount = total("t")
    keep = F.lit(1.0)
    if ignore_empty:
        keep = F.when((amount > 0) | F.col("class_id").isin(known_negatives or []), 1.0).otherwise(0.0)
    out = rows.withColumn("keep", keep)
    if ignore_background:
        any_fg = F.max(F.when(F.col("class_id") > 0, amount)).over(Window.partitionBy("sample_id"))
        out = out.withColumn("keep", F.when((F.col("class_id") == 0) & (F.coalesce(any_fg, F.lit(0.0)) > 0), 0.0).otherwise(F.col("keep")))
    return out


def reduce_kept(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of kept losses over max(number kept, 1): losses(loss, keep)."""
    return losses.groupBy(*(by or [])).agg((F.sum(F.col("loss") * F.col("keep")) / F.greatest(F.sum("keep"), F.lit(1.0))).alias("loss"))


def combined_loss(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of components(batch, component, value) by weights(component, weight); the parts stay as a map."""
    return components.join(weights, "component").groupBy("batch").agg(
        F.sum(F.col("value") * F.col("weight")).alias("loss"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "value")))).alias("parts")
    )


def routed_loss(components: DataFrame, routes: DataFrame, weights: DataFrame) -> DataFrame:
    """Loss of each batch by its dataset's profile.

    components(batch, dataset, component, value), routes(dataset, profile), weights(profile,
    component, weight).  Returns batch, profile, component, value, loss: components of all
    profiles are listed, those of other profiles with 0.
    """
    active = components.join(routes, "dataset").join(weights, ["profile", "component"])
    losses = active.groupBy("batch", F.col("profile").alias("active")).agg(F.sum(F.col("value") * F.col("weight")).alias("loss"))
    grid = losses.crossJoin(F.broadcast(weights.select("profile", "component").distinct()))  # the components of a configuration
    got = active.select("batch", "profile", "component", "value")
    return grid.join(got, ["batch", "profile", "component"], "left").select("batch", "active", "profile", "component", F.coalesce("value", F.lit(0.0)).alias("value"), "loss")


def routing_issues(datasets: DataFrame, routes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active datasets without a route, routes of inactive datasets, and routes to unknown profiles."""
    return (
        datasets.join(routes, "dataset", "left_anti").select("dataset", F.lit("no route").alias("issue"))
        .unionByName(routes.join(datasets, "dataset", "left_anti").select("dataset", F.lit("inactive dataset").alias("issue")))
        .unionByName(routes.join(profiles, "profile", "left_anti").select("dataset", F.lit("unknown profile").alias("issue")))
    )
