"""The chain from an image to the canvas of a model or package, its geometry, and the way back.

Padding and resampling are one step: the weights of both axes, cached by shape, leave out the
padding, so nothing larger than the image and the canvas is made.  The geometry of every image is a
struct beside it, from which masks and probabilities on the canvas are brought back to the image.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import kernels, normalise
from maskframe.functions.arrays import ColumnLike, col, doubles
from maskframe.operators.raster import DOUBLES

#: Intensity modes of packages, and pixel scales of inference.
INTENSITY = ("per_image_minmax", "dtype_range")
SCALES = ("zero_one", "none")


def geometry(height: ColumnLike, width: ColumnLike, pad_to_square: bool, size: tuple[int, int] | None) -> Column:
    """original_shape, pad_before, pad_after, padded_shape, processed_shape and resize_scale, each (rows, columns)."""
    h, w = col(height).cast("int"), col(width).cast("int")
    side = F.greatest(h, w)
    padded = (side, side) if pad_to_square else (h, w)
    before = [F.floor((p - n) / 2).cast("int") for p, n in zip(padded, (h, w))]
    after = [p - n - b for p, n, b in zip(padded, (h, w), before)]
    out = padded if size is None else tuple(F.lit(n).cast("int") for n in size)
    pair = lambda name, values: F.array(*values).alias(name)
    return F.struct(
        pair("original_shape", (h, w)), pair("pad_before", before), pair("pad_after", after), pair("padded_shape", padded), pair("processed_shape", out), pair("resize_scale", [o / p for o, p in zip(out, padded)])
    )


def scaled_values(values: np.ndarray, dtype: str | None, scale: str) -> np.ndarray:
    """Pixels before padding, with what is not finite as 0.

    zero_one: integers of up to 16 bits by the bounds of their type, wider ones by their own range;
    per_image_minmax: any by their own range; none and dtype_range: as they are.
    """
    own = scale == "per_image_minmax"
    if scale == "zero_one" and dtype is not None and not dtype.startswith(("float", "bool")):
        if dtype in normalise.INTEGER_BOUNDS:
            low, high = normalise.INTEGER_BOUNDS[dtype]
            values = (values - low) / (high - low)
        else:
            own = True
    if own and values.size:
        low, high = values.min(), values.max()
        values = (values - low) / (high - low) if high > low else np.zeros_like(values)
    return np.where(np.isfinite(values), values, 0.0)


def _canvas(how: str, scale: str, clip: bool):
    @F.pandas_udf(DOUBLES)
    def run(data: pd.Series, dtype: pd.Series, shape: pd.Series, padded: pd.Series, before: pd.Series, out: pd.Series) -> pd.Series:
        made = []
        for d, kind, (h, w), pad, (top, left), size in zip(data, dtype, shape, padded, before, out):
            if d is None:
                made.append(None)
                continue
            rows, columns = (kernels.bands(how, int(p), int(o), int(b), int(n)) for p, o, b, n in ((pad[0], size[0], top, h), (pad[1], size[1], left, w)))
            values = kernels.resample(scaled_values(np.asarray(d, float), kind, scale).reshape(h, w), rows, columns).ravel()
            made.append(np.clip(values, 0, 1) if clip else values)
        return pd.Series(made, dtype=object)

    return run


def to_canvas(data: ColumnLike, geometry: ColumnLike, how: str, scale: str = "none", dtype: ColumnLike | None = None, clip: bool = False) -> Column:
    """An image scaled, padded with zeros and resampled (area, bilinear or nearest) as its geometry says, in one Arrow pass; null images stay null."""
    g = col(geometry)
    kind = F.lit(None).cast("string") if dtype is None else col(dtype)
    return _canvas(how, scale, clip)(doubles(data), kind, g["original_shape"], g["padded_shape"], g["pad_before"], g["processed_shape"])


def _image(how: str):
    @F.pandas_udf(DOUBLES)
    def run(data: pd.Series, shape: pd.Series, padded: pd.Series, before: pd.Series, size: pd.Series) -> pd.Series:
        made = []
        for d, (h, w), pad, (top, left), (ch, cw) in zip(data, shape, padded, before, size):
            if d is None:
                made.append(None)
                continue
            canvas = np.asarray(d, float).reshape(ch, cw)
            if how == "nearest":  # the canvas cell that the middle of a pixel lies in
                y, x = (np.minimum(((np.arange(n) + b + 0.5) * c / p).astype(int), c - 1) for n, b, c, p in ((h, top, ch, pad[0]), (w, left, cw, pad[1])))
                made.append(canvas[y][:, x].ravel())
                continue
            rows, columns = (kernels.bands(how, int(c), int(p)) for c, p in ((ch, pad[0]), (cw, pad[1])))
            rows, columns = (kernels.Bands(r.first[b : b + n], r.weights[b : b + n]) for r, b, n in ((rows, top, h), (columns, left, w)))
            made.append(kernels.resample(canvas, rows, columns).ravel())
        return pd.Series(made, dtype=object)

    return run


def to_image(data: ColumnLike, geometry: ColumnLike, how: str = "nearest") -> Column:
    """A mask (nearest) or probabilities (bilinear) on the canvas brought back to the image's own pixels, without the padding."""
    g = col(geometry)
    return _image(how)(doubles(data), g["original_shape"], g["padded_shape"], g["pad_before"], g["processed_shape"])


def _size(value: Any, name: str) -> tuple[int, int]:
    if not isinstance(value, (list, tuple)) or len(value) != 2 or not all(isinstance(n, int) and not isinstance(n, bool) and n > 0 for n in value):
        raise ValueError(f"{name} must be two positive whole numbers, not {value!r}")
    return value[0], value[1]


@dataclass(frozen=True)
class PackagePreprocessing:
    """What a manifest asks for before images are packed."""

    intensity: str = "per_image_minmax"
    pad_to_square: bool = False
    output_size: tuple[int, int] | None = None

    @classmethod
    def from_manifest(cls, block: Mapping[str, Any]) -> PackagePreprocessing:
        if not isinstance(block, Mapping) or set(block) - {"intensity", "pad_to_square", "output_size"}:
            raise ValueError(f"preprocessing is no mapping of intensity, pad_to_square and output_size: {block!r}")
        intensity, pad, size = block.get("intensity", "per_image_minmax"), block.get("pad_to_square", False), block.get("output_size")
        if intensity not in INTENSITY:
            raise ValueError(f"intensity {intensity!r} is none of {INTENSITY}")
        if not isinstance(pad, bool):
            raise ValueError("pad_to_square must be true or false")
        return cls(intensity, pad, None if size is None else _size(size, "output_size"))

    def to_attrs(self) -> dict[str, Any]:
        return {"intensity": self.intensity, "pad_to_square": self.pad_to_square, "output_size": None if self.output_size is None else list(self.output_size)}

    def apply(self, samples: DataFrame, image: str = "image", label: str | None = "label", height: str = "height", width: str = "width") -> DataFrame:
        """Samples with image (in [0, 1]), label (nearest, so ids stay whole; a channel list if it is nested) and ``geometry``."""
        out = samples.withColumn("geometry", geometry(height, width, self.pad_to_square, self.output_size))
        resized = self.output_size is not None
        if self.pad_to_square or resized:
            values = to_canvas(image, "geometry", "area" if resized else "nearest", self.intensity, clip=resized)
        else:
            values = normalise.unit_range(image) if self.intensity == "per_image_minmax" else doubles(image)
        out = out.withColumn(image, values)
        if label is not None and (self.pad_to_square or self.output_size is not None):
            channels = isinstance(samples.schema[label].dataType.elementType, T.ArrayType)
            out = out.withColumn(label, _channels_to_canvas(label) if channels else to_canvas(label, "geometry", "nearest"))
        return out


@F.pandas_udf(T.ArrayType(DOUBLES))
def _nearest_channels(data: pd.Series, shape: pd.Series, padded: pd.Series, before: pd.Series, out: pd.Series) -> pd.Series:
    made = []
    for channels, (h, w), pad, (top, left), size in zip(data, shape, padded, before, out):
        if channels is None:
            made.append(None)
            continue
        rows, columns = (kernels.bands("nearest", int(p), int(o), int(b), int(n)) for p, o, b, n in ((pad[0], size[0], top, h), (pad[1], size[1], left, w)))
        made.append([kernels.resample(np.asarray(c, float).reshape(h, w), rows, columns).ravel() for c in channels])
    return pd.Series(made, dtype=object)


def _channels_to_canvas(label: str) -> Column:
    g = F.col("geometry")
    return _nearest_channels(F.col(label).cast(T.ArrayType(DOUBLES)), g["original_shape"], g["padded_shape"], g["pad_before"], g["processed_shape"])


@dataclass(frozen=True)
class InferencePreprocessing:
    """What a model's metadata ask for before an image is segmented."""

    image_size: tuple[int, int] = (256, 256)
    pad_to_square: bool = True
    scale: str = "zero_one"
    scheme: str = "none"
    percentiles: tuple[float, float] | None = None
    eps: float = normalise.EPS
    mean: float | None = None
    std: float | None = None

    @classmethod
    def from_metadata(cls, metadata: Mapping[str, Any] | None) -> InferencePreprocessing:
        """Settings of a metadata mapping; what is not there has its default, what is not supported raises."""
        data = dict(metadata or {})
        size = _size(data.get("image_size", data.get("size", [256, 256])), "image_size")
        if str(data.get("color_mode", "grayscale")).lower() != "grayscale":
            raise ValueError(f"color_mode {data['color_mode']!r} is not supported")
        scale = str(data.get("scale", "zero_one")).lower()
        if scale not in SCALES:
            raise ValueError(f"scale {scale!r} is none of {SCALES}")
        block = data.get("normalization")
        if block is not None and not isinstance(block, Mapping):
            raise TypeError("normalization must be a mapping")
        block = dict(block or {})
        per_image = "scheme" in block and block["scheme"] != "none"
        how: dict[str, Any] = {"scheme": "none", "percentiles": None, "eps": normalise.EPS}
        if per_image:
            if block["scheme"] == "percentile_minmax" and block.get("percentiles") is None:
                raise ValueError("percentile_minmax needs two percentiles")
            if block["scheme"] != "percentile_minmax" and block.get("percentiles") is not None:
                raise ValueError("percentiles go with percentile_minmax only")
            how = normalise.normalisation({"train": {"normalization": block}})
        source = {} if "scheme" in block else block
        mean, std = (None if v is None else float(v) for v in (source.get(n, data.get(n)) for n in ("mean", "std")))
        if per_image and (mean is not None or std is not None):
            raise ValueError("a scheme and mean or std exclude each other")
        if std is not None and not (np.isfinite(std) and std > 0):
            raise ValueError("std must be positive")
        return cls(size, bool(data.get("pad_to_square", True)), scale, how["scheme"], how["percentiles"], how["eps"], mean, std)

    def to_metadata(self) -> dict[str, Any]:
        out: dict[str, Any] = {"image_size": list(self.image_size), "color_mode": "grayscale", "pad_to_square": self.pad_to_square, "scale": self.scale, "mean": self.mean, "std": self.std}
        if self.scheme != "none":
            out["normalization"] = {"scheme": self.scheme, "eps": self.eps} | ({"percentiles": list(self.percentiles)} if self.percentiles else {})
        return out

    def prepare(self, images: DataFrame, data: str = "data", height: str = "height", width: str = "width", dtype: str = "source_dtype") -> DataFrame:
        """Images (grey values, row-major) with ``canvas`` and ``geometry``.

        Integers are scaled by their type, values that are not finite count as 0; then come padding,
        resampling (bilinear, antialiased) and normalisation over the canvas.
        """
        out = images.withColumn("geometry", geometry(height, width, self.pad_to_square, self.image_size))
        out = out.withColumn("canvas", to_canvas(data, "geometry", "bilinear", self.scale, dtype))
        canvas = F.col("canvas")
        if self.scheme != "none":
            canvas = normalise.SCHEMES[self.scheme]("canvas", *(self.percentiles or ()), eps=self.eps)
        if self.mean is not None or self.std is not None:
            canvas = F.transform(canvas, lambda x: (x - (self.mean or 0.0)) / (self.std or 1.0))
        return out.withColumn("canvas", canvas)
