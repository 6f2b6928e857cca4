"""Post-processing by dataset: which rule applies to an image, and what it does to its channels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.operators import raster
from maskframe.operators.stacks import merged_arrays


@dataclass(frozen=True)
class Rule:
    """A change to the channel ``changes``, given all ``required`` channels by name, height, width and threshold.

    truth: the channel of the image's own label (column ``label``) that the rule needs too, as ``truth``.
    """

    dataset: str
    required: tuple[str, ...]
    changes: str
    apply: Callable[[dict[str, Column], Column, Column, float], Column]
    truth: str | None = None


#: Rules that come with the library: dataset, labels needed, label changed.
RULES = (
    Rule("HipRay", ("hips", "femurs"), "hips", lambda c, h, w, t: raster.remove_near(c["hips"], c["femurs"], w, t, 4.0)),
    Rule("MendeleyCXR", ("lungs", "liver"), "lungs", lambda c, h, w, t: raster.suppress(c["lungs"], c["liver"], t)),
    Rule("ShoulderMonch", ("clavicles", "humeri"), "clavicles", lambda c, h, w, t: raster.closest_component(_above(c["clavicles"], t), _above(c["truth"], 0.5), h, w, 2, 0.05), "humeri"),
)


def postprocess(images: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, enabled: bool = True) -> DataFrame:
    """images(dataset, label_names, prob [channel][pixel], height, width, ...) with prob changed and ``status``.

    status: disabled, no_rule (unknown dataset), missing_labels, missing_truth (the rule needs a
    positive pixel of the image's own ``label``, [channel][pixel] too, and there is none), or
    applied; all but the last leave an image as it is.  Images stay in their rows.
    """
    if not enabled:
        return images.withColumn("status", F.lit("disabled"))
    at = lambda name: F.array_position("label_names", F.lit(name)) - 1
    prob, status, changed = F.col("prob"), F.lit("no_rule"), {}
    for k, rule in enumerate(rules):
        mine = F.col("dataset") == rule.dataset
        fits = named = mine & F.forall(F.array(*map(F.lit, rule.required)), lambda n: F.array_contains("label_names", n))
        truth = None
        if rule.truth:
            truth = F.get("label", at(rule.truth).cast("int")) if "label" in images.columns else F.lit(None).cast("array<double>")
            fits = named & F.coalesce(F.exists(truth, lambda x: x > 0.5), F.lit(False))
        channels = {n: F.when(fits, F.get("prob", at(n).cast("int"))) for n in rule.required}  # null: nothing to do for the rule
        if rule.truth:
            channels["truth"] = F.when(fits, truth)
        changed[f"__changed{k}"] = rule.apply(channels, F.col("height"), F.col("width"), threshold)
        prob = F.when(fits, _replaced("prob", at(rule.changes), F.col(f"__changed{k}"))).otherwise(prob)
        status = F.when(fits, "applied").when(named, "missing_truth").when(mine, "missing_labels").otherwise(status)
    return images.withColumns(changed).withColumns({"prob": prob, "status": status}).drop(*changed)


def _above(channel: Column, threshold: float) -> Column:
    return F.transform(channel, lambda x: F.when(x > threshold, 1.0).otherwise(0.0))


def _replaced(channels: str, place: Column, new: Column) -> Column:
    return F.transform(channels, lambda c, i: F.when(i == place, new).otherwise(c))


def predicted_mask(prob: str = "prob", threshold: float = 0.5) -> Column:
    """Masks of an inference: 1 from the threshold on (metrics count only what is above theirs)."""
    return F.transform(prob, lambda c: F.transform(c, lambda p: F.when(p >= threshold, 1.0).otherwise(0.0)))


def mean_members(members: DataFrame) -> DataFrame:
    """Mean probability of each image, channel and pixel over members(image, member, prob)."""
    return merged_arrays(members.select("image", F.posexplode("prob").alias("channel", "p")), ["image", "channel"], "p")
