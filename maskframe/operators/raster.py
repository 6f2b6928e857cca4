"""Geometry of rasters, post-processing and view merging.

A raster is a row-major array with its height and width in one row.  What columns can express
stays in the row; resampling, components and filters are Arrow pandas UDFs over one image each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskframe.functions import kernels
from maskframe.functions.arrays import ColumnLike, bind, bind_fields, col, doubles, sequence0
from maskframe.operators.stacks import merged_arrays

DOUBLES = T.ArrayType(T.DoubleType())


# -- geometry -------------------------------------------------------------------------------------------

def square_padding(height: ColumnLike, width: ColumnLike) -> Column:
    """pad_y0, pad_y1, pad_x0, pad_x1 to a square: half before, the rest after."""
    h, w = col(height), col(width)
    side = F.greatest(h, w)
    y, x = F.floor((side - h) / 2).cast("int"), F.floor((side - w) / 2).cast("int")
    return F.struct(y.alias("pad_y0"), (side - h - y).cast("int").alias("pad_y1"), x.alias("pad_x0"), (side - w - x).cast("int").alias("pad_x1"))


def content_box(height: ColumnLike, width: ColumnLike, canvas: int = 256) -> Column:
    """y0, x0, y1, x1 of an image inside its padded, resized square; halves to even, at least one pixel."""
    h, w = col(height), col(width)
    side = F.greatest(h, w)

    def axis(n: Column) -> tuple[Column, Column]:
        before = F.floor((side - n) / 2)
        lo = F.rint(before * canvas / side).cast("int")
        hi = F.rint((before + n) * canvas / side).cast("int")
        lo = F.least(lo, F.lit(canvas - 1))
        return lo, F.least(F.greatest(hi, lo + 1), F.lit(canvas))

    (y0, y1), (x0, x1) = axis(h), axis(w)
    return F.struct(y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))


def pad_square(data: ColumnLike, height: ColumnLike, width: ColumnLike, fill: float = 0.0) -> Column:
    """The raster on its padded square, by index arithmetic."""

    def square(s: Column) -> Column:
        a, h, w, side, pad = (s[n] for n in ("a", "h", "w", "side", "pad"))

        def pixel(i: Column) -> Column:
            y, x = F.floor(i / side).cast("int") - pad["pad_y0"], (i % side) - pad["pad_x0"]
            return F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), F.get(a, y * w + x)).otherwise(F.lit(fill))

        return F.transform(sequence0(side * side), pixel)

    h, w = col(height), col(width)
    return bind_fields(square, a=col(data), h=h, w=w, side=F.greatest(h, w), pad=square_padding(h, w))


def resize_nearest(data: ColumnLike, height: ColumnLike, width: ColumnLike, out_height: int, out_width: int) -> Column:
    """Source pixel floor(place * in / out) of each output pixel."""
    source = lambda s: lambda i: F.get(s["a"], F.floor(F.floor(i / out_width) * s["h"] / out_height).cast("int") * s["w"] + F.floor((i % out_width) * s["w"] / out_width).cast("int"))
    return bind_fields(lambda s: F.transform(sequence0(out_height * out_width), source(s)), a=col(data), h=col(height), w=col(width))


def resample_1d(data: ColumnLike, size: int) -> Column:
    """Nearest resampling of one axis."""
    return bind(col(data), lambda a: F.transform(sequence0(size), lambda i: F.get(a, F.floor(i.cast("long") * F.size(a) / size).cast("int"))))


def _resized(height: int, width: int, how: str):
    @F.pandas_udf(DOUBLES)
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else np.clip(kernels.resize(np.asarray(d, float).reshape(a, b), height, width, how), 0, 1).ravel() for d, a, b in zip(data, h, w)])

    return run


def resize_area(data: ColumnLike, height: ColumnLike, width: ColumnLike, out_height: int, out_width: int) -> Column:
    """Area average, clipped to [0, 1]."""
    return _resized(out_height, out_width, "area")(col(data), col(height), col(width))


def resize_bilinear(data: ColumnLike, height: ColumnLike, width: ColumnLike, out_height: int, out_width: int) -> Column:
    return _resized(out_height, out_width, "bilinear")(col(data), col(height), col(width))


def crop_or_pad(data: ColumnLike, shape: tuple[Column, Column, Column], size: tuple[int, int, int], offset: tuple[Column, Column, Column], fill: float) -> Column:
    """A window of ``size`` of a 3-D raster from ``offset`` (negative: starts before it), ``fill`` outside."""
    sx, sy, sz = size

    def window(s: Column) -> Column:
        def voxel(i: Column) -> Column:
            x, y, z = F.floor(i / (sy * sz)).cast("int") + s["ox"], (F.floor(i / sz) % sy).cast("int") + s["oy"], (i % sz) + s["oz"]
            inside = (x >= 0) & (x < s["nx"]) & (y >= 0) & (y < s["ny"]) & (z >= 0) & (z < s["nz"])
            return F.when(inside, F.get(s["a"], (x * s["ny"] + y) * s["nz"] + z)).otherwise(F.lit(fill))

        return F.transform(sequence0(sx * sy * sz), voxel)

    return bind_fields(window, a=col(data), **dict(zip(("nx", "ny", "nz"), shape)), **dict(zip(("ox", "oy", "oz"), offset)))


def crop_offset(extent: ColumnLike, size: int, u: ColumnLike) -> Column:
    """Start of a random crop from u in [0, 1): floor(u (n + 1)) of the room, negative where the crop is larger."""
    n = col(extent)
    return F.when(n >= size, F.floor(col(u) * (n - size + 1))).otherwise(-F.floor(col(u) * (size - n + 1))).cast("int")


def offset_affine(affine: ColumnLike, z_offset: ColumnLike) -> Column:
    """A row-major 4 x 4 affine with its origin moved along the third axis."""
    return bind(doubles(affine), lambda a: F.transform(a, lambda v, i: F.when(i.isin(3, 7, 11), v + F.get(a, i - 1) * col(z_offset)).otherwise(v)))


def voxel_to_world(affine: ColumnLike, i: ColumnLike, j: ColumnLike, k: ColumnLike) -> Column:
    a = doubles(affine)
    return F.array(*(F.get(a, F.lit(4 * r)) * col(i) + F.get(a, F.lit(4 * r + 1)) * col(j) + F.get(a, F.lit(4 * r + 2)) * col(k) + F.get(a, F.lit(4 * r + 3)) for r in range(3)))


def determinant(affine: ColumnLike) -> Column:
    """Determinant of the upper left 3 x 3 of a 4 x 4 affine."""
    a = doubles(affine)
    m = lambda r, c: F.get(a, F.lit(4 * r + c))
    return m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))


def intrinsics(sdd: ColumnLike, delx: ColumnLike, dely: ColumnLike, x0: ColumnLike, y0: ColumnLike, height: int, width: int) -> Column:
    """Inverse of the camera matrix (row-major 3 x 3): fx = sdd / delx, cx = x0 / delx + width / 2."""
    fx, fy = col(sdd) / col(delx), col(sdd) / col(dely)
    cx, cy = col(x0) / col(delx) + width / 2.0, col(y0) / col(dely) + height / 2.0
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one / fx, zero, -cx / fx, zero, one / fy, -cy / fy, zero, zero, one)


@F.pandas_udf(DOUBLES)
def _dense(places: pd.Series, values: pd.Series, size: pd.Series) -> pd.Series:
    out = []
    for at, value, n in zip(places, values, size):
        raster = np.zeros(int(n))
        if at is not None and len(at):
            raster[np.asarray(at, np.int64)] = 1 if value is None else value
        out.append(raster)
    return pd.Series(out)


def from_places(places: ColumnLike, size: ColumnLike, values: ColumnLike | None = None) -> Column:
    """A raster of ``size`` pixels with these values (1 without any) at these places and 0 elsewhere; null places: none."""
    return _dense(col(places).cast("array<long>"), F.lit(None).cast(DOUBLES) if values is None else doubles(values), col(size).cast("int"))


# -- filters -----------------------------------------------------------------------------------------------

@F.pandas_udf(DOUBLES)
def _smooth(data: pd.Series, h: pd.Series, w: pd.Series, sigma: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else np.clip(kernels.gaussian(np.asarray(d, float).reshape(a, b), s, k), 0, 1).ravel() for d, a, b, s, k in zip(data, h, w, sigma, size)])


def smooth_labels(data: ColumnLike, height: ColumnLike, width: ColumnLike, sigma: float, size: int) -> Column:
    return _smooth(col(data), col(height), col(width), F.lit(float(sigma)), F.lit(size))


@F.pandas_udf(DOUBLES)
def _equalize(data: pd.Series, h: pd.Series, w: pd.Series, clip: pd.Series, gy: pd.Series, gx: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else kernels.equalize_tiles(np.asarray(d, float).reshape(a, b), c, (y, x)).ravel() for d, a, b, c, y, x in zip(data, h, w, clip, gy, gx)])


def equalize(data: ColumnLike, height: ColumnLike, width: ColumnLike, clip: float = 40.0, grid: tuple[int, int] = (8, 8)) -> Column:
    return _equalize(col(data), col(height), col(width), F.lit(float(clip)), F.lit(grid[0]), F.lit(grid[1]))


# -- post-processing ---------------------------------------------------------------------------------------

def suppress(data: ColumnLike, other: ColumnLike, threshold: float) -> Column:
    """0 where another channel is above the threshold."""
    return F.zip_with(col(data), col(other), lambda x, o: F.when(o > threshold, F.lit(0.0)).otherwise(x))


@F.pandas_udf(DOUBLES)
def _far(data: pd.Series, other: pd.Series, width: pd.Series, threshold: pd.Series, distance: pd.Series) -> pd.Series:
    out = []
    for d, o, w, t, r in zip(data, other, width, threshold, distance):
        if d is None:
            out.append(None)
            continue
        lit = lambda a: ~(np.asarray(a, float) <= t)  # noqa: E731, B023
        kept = lit(d) if o is not None else np.zeros(len(d), bool)
        away = None if o is None else kernels.distance_to(lit(o).reshape(-1, int(w)))
        if away is not None:
            kept &= np.rint(away.ravel() ** 2) > r * r
        out.append(kept.astype(float))
    return pd.Series(out)


def remove_near(data: ColumnLike, other: ColumnLike, width: ColumnLike, threshold: float, distance: float) -> Column:
    """1 where a channel is above the threshold and farther than ``distance`` from every pixel where the other is, else 0."""
    return _far(col(data), col(other), col(width).cast("int"), F.lit(float(threshold)), F.lit(float(distance)))


@F.pandas_udf(DOUBLES)
def _closest(mask: pd.Series, other: pd.Series, h: pd.Series, w: pd.Series, limit: pd.Series, relative: pd.Series) -> pd.Series:
    out = []
    for m, o, a, b, n, r in zip(mask, other, h, w, limit, relative):
        if m is None:
            out.append(None)
            continue
        grid = np.asarray(m, float).reshape(a, b)
        away = None if o is None else kernels.distance_to(np.asarray(o, float).reshape(a, b) > 0)
        labels, sizes = kernels.components(grid > 0)
        ids = kernels.largest_components(sizes, n, r)
        if away is None or not ids:
            out.append(grid.ravel())
            continue
        best = min(range(len(ids)), key=lambda k: (away[labels == ids[k]].min(), k, ids[k]))
        out.append((labels == ids[best]).astype(float).ravel())
    return pd.Series(out)


def closest_component(mask: ColumnLike, other: ColumnLike, height: ColumnLike, width: ColumnLike, limit: int = 2, min_relative: float = 0.05) -> Column:
    """Of the largest 8-connected components of a mask the one nearest to another mask; unchanged without that or without any."""
    return _closest(col(mask), col(other), col(height), col(width), F.lit(limit), F.lit(float(min_relative)))


def top_components(sizes: DataFrame, by: str, size: str, component: str, limit: int, min_relative: float) -> DataFrame:
    """The largest components of each group, at least max(1, ceil(largest * min_relative)) in size: sizes(by, component, size)."""
    best = sizes.groupBy(by).agg(F.max(size).alias("_top"))
    kept = sizes.join(best, by).where(F.col(size) >= F.greatest(F.lit(1), F.ceil(F.col("_top") * min_relative))).drop("_top")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(size), component))).where(F.col("rank") <= limit)


def merge_views(views: DataFrame) -> DataFrame:
    """image, channel, p: mean probabilities over views and members, flipped ones turned back; views(image, channel, flipped, width, p array).

    Views stay arrays: of each image and channel those of a task are added up pixel by pixel, and
    the tasks' sums after one exchange of a row each.
    """
    even = views.select("image", "channel", F.when(F.col("flipped"), flipped("p", "width")).otherwise(doubles("p")).alias("p"))
    return merged_arrays(even, ["image", "channel"], "p")


def flipped(data: ColumnLike, width: ColumnLike) -> Column:
    """The image turned left to right."""
    back = lambda s: F.transform(sequence0(F.size(s["a"])), lambda i: F.get(s["a"], F.floor(i / s["w"]).cast("int") * s["w"] + (s["w"] - 1 - i % s["w"])))
    return bind_fields(back, a=doubles(data), w=col(width).cast("int"))
