"""Intensity scaling and probability algebra as column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.arrays import ColumnLike, ascending, bind, bind_fields, col, doubles, mean, quantile_of_sorted, total

EPS = 1e-8
#: Lower and upper bound of integer types of at most 16 bits.
INTEGER_BOUNDS = {"bool": (0, 1), "int8": (-128, 127), "uint8": (0, 255), "int16": (-32768, 32767), "uint16": (0, 65535)}


# -- scalars ---------------------------------------------------------------------------------

def sigmoid(x: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def softmax(a: ColumnLike) -> Column:
    """Softmax of an array of logits."""
    shifted = bind(doubles(a), lambda v: bind_fields(lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])), v=v, top=F.array_max(v)))
    return bind(shifted, lambda e: bind_fields(lambda s: F.transform(s["e"], lambda x: x / s["sum"]), e=e, sum=total(e)))


def quantize_probability(p: ColumnLike) -> Column:
    """Probability as 0 to 255, halves to even."""
    return F.least(F.greatest(F.rint(col(p) * 255.0), F.lit(0.0)), F.lit(255.0)).cast("smallint")


def dequantize_probabilities(a: ColumnLike, dtype: ColumnLike) -> Column:
    """Saved probabilities of a source type as [0, 1]: uint8 over 255, bool as is, other integers as
    is up to 1 and over 255 up to 255, floats as they are; anything outside raises."""
    v, d = doubles(a), col(dtype)
    low, high = F.array_min(v), F.array_max(v)
    over = F.transform(v, lambda x: x / 255.0)
    bad = F.raise_error(F.concat(F.lit("probabilities of type "), d, F.lit(" out of range"))).cast("array<double>")
    integers = F.when((low < 0) | (high > 255), bad).when(high <= 1, v).otherwise(over)
    return F.when(d == "bool", v).when(d == "uint8", over).when(d.startswith("float"), F.when((low < 0) | (high > 1), bad).otherwise(v)).otherwise(integers)


def probability_logit(p: ColumnLike, categorical: bool = False, eps: float = 1e-6) -> Column:
    """Mean probability back to a logit: log p - log(1 - p), or log p for one of several classes."""
    c = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(c) if categorical else F.ln(c) - F.log1p(-c)


def integer_scale(x: ColumnLike, dtype: str) -> Column:
    """(x - low) / (high - low) by the bounds of a type of at most 16 bits."""
    low, high = INTEGER_BOUNDS[dtype]
    return (col(x).cast("double") - low) / (high - low)


def luminance(r: ColumnLike, g: ColumnLike, b: ColumnLike, alpha: ColumnLike | None = None) -> Column:
    """Luminance, over black where alpha is below 1."""
    y = 0.299 * col(r) + 0.587 * col(g) + 0.114 * col(b)
    return y if alpha is None else y * F.least(F.greatest(col(alpha), F.lit(0.0)), F.lit(1.0))


def hu_window(x: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def hu_bounds(x: ColumnLike, hu_min: float | None, air_clamp: float | None) -> Column:
    """Raise to hu_min, but values at or below air_clamp become air (-1000)."""
    v = col(x).cast("double")
    raised = F.greatest(v, F.lit(float(hu_min))) if hu_min is not None else v
    return raised if air_clamp is None else F.when(v <= air_clamp, F.lit(-1000.0)).otherwise(raised)


# -- whole arrays (one image a row): bounds and moments are bound once, so the work is linear in pixels -----

def _by_range(a: ColumnLike, scaled: Callable[[Column, Column, Column], Column]) -> Column:
    """``scaled`` of every element with the smallest and the largest one."""
    return bind(doubles(a), lambda v: bind_fields(lambda s: F.transform(s["v"], lambda x: scaled(x, s["low"], s["high"])), v=v, low=F.array_min(v), high=F.array_max(v)))


def unit_range(a: ColumnLike) -> Column:
    """(x - min) / (max - min); a constant image is 0."""
    return _by_range(a, lambda x, low, high: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))


def minmax(a: ColumnLike, eps: float = EPS) -> Column:
    return _by_range(a, lambda x, low, high: (x - low) / F.greatest(high - low, F.lit(eps)))


def percentile_minmax(a: ColumnLike, low: float = 0.5, high: float = 99.5, eps: float = EPS) -> Column:
    """Clip to two percentiles (linear interpolation) and scale between them."""
    scaled = lambda s: F.transform(s["v"], lambda x: (F.least(F.greatest(x, s["p"]), s["q"]) - s["p"]) / F.greatest(s["q"] - s["p"], F.lit(eps)))
    ends = lambda s: bind_fields(scaled, v=s["v"], p=quantile_of_sorted(s["sorted"], low / 100), q=quantile_of_sorted(s["sorted"], high / 100))
    return bind(doubles(a), lambda v: bind_fields(ends, v=v, sorted=ascending(v)))


def standardize(a: ColumnLike, eps: float = EPS) -> Column:
    """(x - mean) / (standard deviation with n - 1, and eps)."""
    centred = bind(doubles(a), lambda v: bind_fields(lambda s: F.transform(s["v"], lambda x: x - s["mean"]), v=v, mean=mean(v)))
    deviation = lambda c: F.coalesce(F.sqrt(F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x), F.size(c) - 1)), F.lit(0.0)) + eps
    return bind(centred, lambda c: bind_fields(lambda s: F.transform(s["c"], lambda x: x / s["by"]), c=c, by=deviation(c)))


#: Scalings that settings may name.
SCHEMES = {"standardize": standardize, "minmax": minmax, "percentile_minmax": percentile_minmax}


def normalisation(settings: dict | None) -> dict:
    """scheme, percentiles and eps of ``train.normalization``.

    Without that block: standardize. A block without a scheme: percentile_minmax from 0.5 to 99.5.
    Unknown keys, schemes, percentiles that don't ascend within 0 to 100 and an eps that is not
    positive and finite are errors; percentiles are null for the other schemes.
    """
    block = ((settings or {}).get("train") or {}).get("normalization")
    if block is None:
        return {"scheme": "standardize", "percentiles": None, "eps": EPS}
    if unknown := sorted(set(block) - {"scheme", "percentiles", "eps"}):
        raise ValueError(f"unknown keys {unknown}")
    scheme, eps, ends = block.get("scheme", "percentile_minmax"), block.get("eps", EPS), block.get("percentiles")
    if scheme not in SCHEMES:
        raise ValueError(f"scheme {scheme!r} is none of {sorted(SCHEMES)}")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    if not number(eps) or eps <= 0:
        raise ValueError(f"eps {eps!r} is not positive and finite")
    if ends is None and scheme == "percentile_minmax":
        ends = (0.5, 99.5)
    if ends is not None and not (len(ends) == 2 and all(map(number, ends)) and 0 <= ends[0] < ends[1] <= 100):
        raise ValueError(f"percentiles {ends!r}")
    return {"scheme": scheme, "percentiles": tuple(map(float, ends)) if scheme == "percentile_minmax" else None, "eps": float(eps)}


def normalised(a: ColumnLike, settings: dict | None) -> Column:
    """An image scaled as the settings say."""
    how = normalisation(settings)
    return SCHEMES[how["scheme"]](a, *(how["percentiles"] or ()), eps=how["eps"])


def finite_or_zero(a: ColumnLike) -> Column:
    inf = F.lit(float("inf"))
    return F.transform(doubles(a), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == inf), F.lit(0.0)).otherwise(x))


def integer_range_scale(a: ColumnLike, dtype: ColumnLike) -> Column:
    """By the bounds of the source type up to 16 bits; wider integers by their own range; floats as they are."""
    v, d = doubles(a), col(dtype)
    between = lambda low, high: F.transform(v, lambda x: (x - low) / (high - low))
    out = F.when(d.startswith("float") | (d == "bool"), v)
    for name, (low, high) in INTEGER_BOUNDS.items():
        if name != "bool":
            out = out.when(d == name, between(low, high))
    return out.otherwise(unit_range(v))


# -- rows of one value (the group is a window) -----------------------------------------------------

def scaled_in_group(value: str, by: list[str], how: str, eps: float = EPS) -> Column:
    """The scalings above for a table of one value a row and groups ``by``: minmax or standardize."""
    w = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    if how == "minmax":
        return (v - F.min(v).over(w)) / F.greatest(F.max(v).over(w) - F.min(v).over(w), F.lit(eps))
    if how == "standardize":
        return (v - F.avg(v).over(w)) / (F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)) + eps)
    raise ValueError(how)
