"""An ordered plan of random transforms over image and labels, in one Arrow pass.

A plan is made from settings (transform name to its options, in order).  Every number that a plan
draws is a column, a hash of the seed, the sample's keys and the draw's name, so a lost task draws
the same again and partitions don't matter; the draws stay beside the results.  Transforms that look
at labels come first, the others in their order; then labels that were 0 and 1 are made so again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import kernels
from maskframe.operators.sampling import uniform

# The glyphs of side markers.
GLYPHS = {
    "L": ("1....", "1....", "1....", "1....", "1....", "1....", "11111"),
    "R": ("1111.", "1...1", "1...1", "1111.", "1.1..", "1..1.", "1...1"),
}
#: Grid of tiles of histogram equalisation.
GRID = (8, 8)

Draws = Mapping[str, float]
Change = Callable[[np.ndarray, np.ndarray, Draws], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Transform:
    """One step: the draws it asks for, and what it does with them to an image [y, x] and labels [channel, y, x]."""

    name: str
    draws: tuple[str, ...]
    apply: Change
    by_label: bool = False


def _probability(value: Any, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"{name} {value!r} is not within 0 to 1")
    return float(value)


def _range(value: Any, name: str, symmetric: bool = False) -> tuple[float, float]:
    if symmetric and isinstance(value, (int, float)):
        value = (-abs(value), abs(value))
    if not isinstance(value, (list, tuple)) or len(value) != 2 or not all(isinstance(x, (int, float)) and np.isfinite(x) for x in value) or value[0] > value[1]:
        raise ValueError(f"{name} {value!r} are not two ascending numbers")
    return float(value[0]), float(value[1])


def _between(u: float, ends: tuple[float, float]) -> float:
    return ends[0] + (ends[1] - ends[0]) * u


def _one_of(u: float, n: int) -> int:
    return min(int(u * n), n - 1)


def horizontal_flip(p: float = 0.5) -> Transform:
    p = _probability(p, "p")
    return Transform("RandomHorizontalFlip", ("on",), lambda x, t, d: (x[:, ::-1], t[:, :, ::-1]) if d["on"] < p else (x, t))


def label_zoom(zoom_range: Any = (1.5, 4.0), p: float = 0.5, label_ids: Any = None) -> Transform:
    """The box of an image's size over a zoom, around the centroid of one foreground channel, brought to the image's size."""
    ends, p = _range(zoom_range, "zoom_range"), _probability(p, "p")
    if ends[0] < 1:
        raise ValueError(f"zoom_range starts below 1: {zoom_range!r}")

    def apply(x: np.ndarray, t: np.ndarray, d: Draws) -> tuple[np.ndarray, np.ndarray]:
        present = [c for c in (range(1, len(t)) if label_ids is None else sorted(label_ids)) if 1 <= c < len(t) and (t[c] > 0).any()]
        if d["on"] >= p or not present:
            return x, t
        size, zoom = x.shape, _between(d["zoom"], ends)
        middle = np.argwhere(t[present[_one_of(d["channel"], len(present))]] > 0).mean(axis=0)
        crop = [max(1, min(n, round(n / zoom))) for n in size]
        (top, left) = (max(0, min(n - c, round(float(m) - c / 2))) for n, c, m in zip(size, crop, middle))
        box = np.s_[top : top + crop[0], left : left + crop[1]]
        near = [np.stack([kernels.resize(c[box], *size, "nearest") for c in t])] if len(t) else [t]
        return kernels.resize(x[box], *size, "bilinear"), near[0]

    return Transform("RandomLabelZoom", ("on", "channel", "zoom"), apply, by_label=True)


def intensity_scale(factors: Any = 0.1, prob: float = 0.5) -> Transform:
    ends, p = _range(factors, "factors", symmetric=True), _probability(prob, "prob")
    return Transform("RandomIntensityScale", ("on", "factor"), lambda x, t, d: (x * (1 + _between(d["factor"], ends)) if d["on"] < p else x, t))


def letter_drop(p: float = 0.25, min_size: float = 0.03, max_size: float = 0.1, intensity_range: Any = (0.8, 1.0)) -> Transform:
    """A bright L or R of a random height, blended in by maximum."""
    p, ends = _probability(p, "p"), _range(intensity_range, "intensity_range")
    if not 0 < min_size <= max_size <= 1:
        raise ValueError(f"sizes {min_size!r} to {max_size!r} are no fractions")

    def apply(x: np.ndarray, t: np.ndarray, d: Draws) -> tuple[np.ndarray, np.ndarray]:
        if d["on"] >= p:
            return x, t
        height, width = x.shape
        least = max(1, int(min_size * height))
        most = min(max(least, int(max_size * height)), height)
        least = min(least, most)
        h = least + _one_of(d["size"], most - least + 1)
        w = max(1, min(width, round(h * 5 / 7)))
        glyph = np.array([[c == "1" for c in row] for row in GLYPHS["L" if d["letter"] < 0.5 else "R"]], float)
        top, left = _one_of(d["top"], max(1, height - h + 1)), _one_of(d["left"], max(1, width - w + 1))
        out = x.copy()
        box = np.s_[top : top + h, left : left + w]
        out[box] = np.maximum(out[box], kernels.resize(glyph, h, w, "nearest") * _between(d["intensity"], ends))
        return out, t

    return Transform("RandomLetterDrop", ("on", "letter", "size", "top", "left", "intensity"), apply)


def invert(p: float = 0.5) -> Transform:
    p = _probability(p, "p")
    return Transform("RandomInvert", ("on",), lambda x, t, d: (1 - x if d["on"] < p else x, t))


def clahe_or_gamma(clip_limit: Any = (1.0, 2.0), gamma: Any = (0.9, 1.1), gain: Any = (1.0, 1.0), clahe_prob: float = 0.1, gamma_prob: float = 0.25) -> Transform:
    """One draw decides between equalisation, gain * x^gamma (within 0 to 1), and neither."""
    clips, gammas, gains = _range(clip_limit, "clip_limit"), _range(gamma, "gamma"), _range(gain, "gain")
    first, second = _probability(clahe_prob, "clahe_prob"), _probability(gamma_prob, "gamma_prob")
    if first + second > 1:
        raise ValueError("clahe_prob and gamma_prob exceed 1 together")

    def apply(x: np.ndarray, t: np.ndarray, d: Draws) -> tuple[np.ndarray, np.ndarray]:
        if d["branch"] < first:
            return kernels.equalize_tiles(x, _between(d["clip"], clips), GRID), t
        if d["branch"] < first + second:
            return np.clip(_between(d["gain"], gains) * np.clip(x, 0, None) ** _between(d["gamma"], gammas), 0, 1), t
        return x, t

    return Transform("RandomClaheOrGamma", ("branch", "clip", "gamma", "gain"), apply)


def contrast(contrast: Any = (0.8, 1.2), p: float = 0.5) -> Transform:
    """The image times a factor, within 0 to 1."""
    ends, p = _range(contrast, "contrast"), _probability(p, "p")
    return Transform("RandomContrast", ("on", "factor"), lambda x, t, d: (np.clip(x * _between(d["factor"], ends), 0, 1) if d["on"] < p else x, t))


def gaussian_noise(mean: float = 0.0, std: float = 1.0, p: float = 0.5) -> Transform:
    """Normal noise whose generator is started by a draw."""
    p = _probability(p, "p")

    def apply(x: np.ndarray, t: np.ndarray, d: Draws) -> tuple[np.ndarray, np.ndarray]:
        return (x + np.random.default_rng(int(d["noise"] * (1 << 32))).normal(mean, std, x.shape) if d["on"] < p else x), t

    return Transform("RandomGaussianNoise", ("on", "noise"), apply)


def aspect_crop(height_range: Any, width_range: Any, p: float = 0.5) -> Transform:
    """Zero outside a centred strip of a random height (landscape) or width (portrait), of the axis' parity."""
    ranges, p = [tuple(map(int, _range(r, n))) for r, n in ((height_range, "height_range"), (width_range, "width_range"))], _probability(p, "p")

    def apply(x: np.ndarray, t: np.ndarray, d: Draws) -> tuple[np.ndarray, np.ndarray]:
        sizes = []
        for (least, most), n in zip(ranges, x.shape):
            first = least + (n - least) % 2
            if most > n or first > most:
                raise ValueError(f"no strip of {least} to {most} in an axis of {n}")
            sizes.append(first + 2 * _one_of(d["size"], (most - first) // 2 + 1))
        if d["on"] >= p:
            return x, t
        axis = 0 if d["landscape"] < 0.5 else 1
        keep = np.zeros(x.shape, bool)
        start = (x.shape[axis] - sizes[axis]) // 2
        keep[(np.s_[start : start + sizes[axis]], np.s_[:])[:: 1 if axis == 0 else -1]] = True
        return np.where(keep, x, 0.0), np.where(keep, t, 0.0)

    return Transform("RandomAspectCrop", ("on", "landscape", "size"), apply)


#: Transforms by the name that settings give them.
TRANSFORMS = {
    "RandomHorizontalFlip": horizontal_flip, "RandomLabelZoom": label_zoom, "RandomIntensityScale": intensity_scale, "RandomLetterDrop": letter_drop, "RandomInvert": invert,
    "RandomClaheOrGamma": clahe_or_gamma, "RandomContrast": contrast, "RandomGaussianNoise": gaussian_noise, "RandomAspectCrop": aspect_crop,
}


def plan(settings: Mapping[str, Mapping[str, Any]] | None) -> list[Transform]:
    """Steps in the order they are done: those that look at labels first.  Unknown names and options raise."""
    if settings is not None and not isinstance(settings, Mapping):
        raise TypeError("transforms must be a mapping from name to options")
    steps = []
    for name, options in (settings or {}).items():
        if name not in TRANSFORMS:
            raise ValueError(f"transform {name!r} is none of {', '.join(TRANSFORMS)}")
        if options is not None and not isinstance(options, Mapping):
            raise TypeError(f"options of {name} must be a mapping")
        try:
            steps.append(TRANSFORMS[name](**{k: v for k, v in (options or {}).items() if k != "module"}))
        except TypeError as e:
            raise ValueError(f"options of {name}: {e}") from e
    return [s for s in steps if s.by_label] + [s for s in steps if not s.by_label]


def hardened(before: np.ndarray, labels: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Labels that were 0 and 1 made so again, background where no foreground is; others stay soft."""
    if not len(labels) or not np.isin(before, (0, 1)).all():
        return labels
    out = (labels > threshold).astype(float)
    out[0] = ~(out[1:] > 0).any(axis=0)
    return out


def augment(samples: DataFrame, settings: Mapping[str, Mapping[str, Any]] | None, seed: int, keys: list[str], harden: bool = True) -> DataFrame:
    """samples(image array, label [channel][pixel], height, width, and the columns ``keys``) with image and label transformed.

    Channel 0 of a label is background.  keys name a sample, with an epoch among them if each epoch
    is to draw anew.  ``draws`` lists the plan's numbers in order; null images stay as they are.
    """
    steps = plan(settings)
    names = [(k, d) for k, s in enumerate(steps) for d in s.draws]
    drawn = F.array(*(uniform(seed, *keys, F.lit(f"{k}.{steps[k].name}.{d}")) for k, d in names)) if names else F.array().cast("array<double>")
    kind = T.StructType([T.StructField("image", T.ArrayType(T.DoubleType())), T.StructField("label", T.ArrayType(T.ArrayType(T.DoubleType())))])

    @F.pandas_udf(kind)
    def run(image: pd.Series, label: pd.Series, height: pd.Series, width: pd.Series, draws: pd.Series) -> pd.DataFrame:
        rows = []
        for x, t, h, w, numbers in zip(image, label, height, width, draws):
            if x is None or t is None:
                rows.append((x, t))
                continue
            x = np.asarray(x, float).reshape(h, w)
            t = before = np.stack([np.asarray(c, float).reshape(h, w) for c in t]) if len(t) else np.zeros((0, h, w))
            of = [{d: float(u) for (j, d), u in zip(names, numbers) if j == k} for k in range(len(steps))]
            for step, d in zip(steps, of):
                x, t = step.apply(x, t, d)
            if harden and steps:
                t = hardened(before, t)
            rows.append((x.ravel(), [c.ravel() for c in t]))
        return pd.DataFrame({"image": pd.Series([r[0] for r in rows], dtype=object), "label": pd.Series([r[1] for r in rows], dtype=object)})

    out = samples.withColumn("draws", drawn).withColumn("__new", run("image", "label", "height", "width", "draws"))
    return out.withColumns({"image": F.col("__new.image"), "label": F.col("__new.label")}).drop("__new")
