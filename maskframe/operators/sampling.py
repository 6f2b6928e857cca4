"""Seeded random draws, camera views and augmentations as columns.

Every draw is a function of a seed and the row's keys (an MD5 read as a number in [0, 1)), so a
lost task draws the same again and the number of partitions does not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.arrays import ColumnLike, bind_fields, col, doubles, sequence0
from maskframe.operators.labels import background_complement
from maskframe.operators.raster import flipped, voxel_to_world


def uniform(seed: int, *keys: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) decided by the seed and the keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))
    return low + (high - low) * (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0)


def bernoulli(p: float, seed: int, *keys: ColumnLike) -> Column:
    return uniform(seed, *keys) < p


def normal(seed: int, *keys: ColumnLike) -> Column:
    """A standard normal number (Box-Muller)."""
    u = F.greatest(uniform(seed, *keys, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("v")))


def truncated_lognormal(mode: float, sigma: float, low: float, high: float, seed: int, *keys: ColumnLike, tries: int = 16) -> Column:
    """The first of ``tries`` lognormal draws inside [low, high], else the mode brought inside: mu = ln(mode) + sigma^2."""
    mu = math.log(mode) + sigma * sigma
    draws = [F.exp(mu + sigma * normal(seed, *keys, F.lit(k))) for k in range(tries)]
    return F.coalesce(*(F.when((d >= low) & (d <= high), d) for d in draws), F.lit(min(max(mode, low), high)))


def scalar_or_range(value: float | tuple[float, float], seed: int, *keys: ColumnLike) -> Column:
    """A fixed number, or one drawn from [low, high)."""
    return F.lit(float(value)) if isinstance(value, (int, float)) else uniform(seed, *keys, low=float(value[0]), high=float(value[1]))


# -- camera views -----------------------------------------------------------------------------------------

def poses(views: DataFrame, rotation: list[tuple[float, float]], shift: list[tuple[float, float]], sdd: tuple[float, float], seed: int) -> DataFrame:
    """views(sample_id, view_idx) with rot, xyz and sdd: uniform on each axis; the distance y of the source and sdd are sorted so that y <= sdd."""
    key = ("sample_id", "view_idx")
    draw = lambda name, r: uniform(seed, *key, F.lit(name), low=r[0], high=r[1])
    y, d = draw("y", shift[1]), draw("sdd", sdd)
    return views.withColumn("rot", F.array(*(draw(f"r{k}", r) for k, r in enumerate(rotation)))).withColumn("xyz", F.array(draw("x", shift[0]), F.least(y, d), draw("z", shift[2]))).withColumn("sdd", F.greatest(y, d))


def camera_requests(views: DataFrame, intrinsics: dict[str, float | tuple[float, float]], rotation: list[tuple[float, float]], shift: list[tuple[float, float]], seed: int, orthographic: float = 0.0) -> DataFrame:
    """views(sample_id, view_idx) with all that a render needs: sdd, delx, dely, x0, y0, rot, xyz and whether it is orthographic.

    An intrinsic is a number or a range that is drawn from for each view; dely without a value of
    its own is delx.  The projection is drawn once for all views of a sample.
    """
    if missing := {"sdd", "delx"} - set(intrinsics):
        raise ValueError(f"intrinsics lack {sorted(missing)}")
    sdd = intrinsics["sdd"]
    out = poses(views, rotation, shift, (float(sdd), float(sdd)) if isinstance(sdd, (int, float)) else sdd, seed)
    draw = lambda name: scalar_or_range(intrinsics[name], seed, "sample_id", "view_idx", F.lit(name))
    out = out.withColumn("delx", draw("delx")).withColumns({n: draw(n) if n in intrinsics else F.lit(0.0) for n in ("x0", "y0")})
    return out.withColumns({"dely": draw("dely") if "dely" in intrinsics else F.col("delx"), "orthographic": bernoulli(orthographic, seed, "sample_id", F.lit("orthographic"))})


def cycled_presets(views: DataFrame, presets: DataFrame, n_presets: int) -> DataFrame:
    """Views with presets(preset_idx, ...) taken in turn."""
    return views.withColumn("preset_idx", F.pmod("view_idx", F.lit(n_presets)).cast("int")).join(presets, "preset_idx")


def volume_center(nx: ColumnLike, ny: ColumnLike, nz: ColumnLike, affine: ColumnLike) -> Column:
    """World place of the middle of a volume."""
    return voxel_to_world(affine, (col(nx) - 1) / 2.0, (col(ny) - 1) / 2.0, (col(nz) - 1) / 2.0)


def sample_isocenters(centroids: DataFrame, n_views: int, seed: int, replacement: bool = False) -> DataFrame:
    """sample_id, view_idx and the centroid (i, j, k) each view looks at.

    Without replacement the centroids of a sample come in hashed order; views beyond them, and all
    views with replacement, draw any.  Without replacement a task keeps the first n_views centroids of
    a sample before they meet; with it they are ordered whole, in one task a sample.
    """
    order = uniform(seed, "sample_id", "label")
    ranked = centroids.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, "label")))
    if not replacement:  # all ranks drawn are below n_views; Spark limits the groups of such a filter before the exchange
        ranked = ranked.where(F.col("rank") <= n_views)
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    views = centroids.groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("view_idx", F.explode(sequence0(n_views)))
    drawn = F.floor(uniform(seed, "sample_id", "view_idx", F.lit("again")) * F.col("n")).cast("int")
    want = drawn if replacement else F.when(F.col("view_idx") < F.col("n"), F.col("view_idx")).otherwise(drawn)
    return views.withColumn("rank", want).join(ranked, ["sample_id", "rank"]).select("sample_id", "view_idx", "label", "i", "j", "k")


# -- augmentations (one image a row) ------------------------------------------------------------------------

def intensity_scale(data: ColumnLike, low: float, high: float, p: float, seed: int, *keys: ColumnLike) -> Column:
    """The image times 1 + a draw from [low, high), with probability p."""
    factor = F.when(bernoulli(p, seed, *keys, F.lit("on")), 1.0 + uniform(seed, *keys, low=low, high=high)).otherwise(1.0)
    return F.transform(doubles(data), lambda x: x * factor)


def gamma(data: ColumnLike, low: float, high: float, p: float, seed: int, *keys: ColumnLike, gain: float = 1.0) -> Column:
    """gain * x^g clipped to [0, 1], with probability p."""
    g = uniform(seed, *keys, F.lit("gamma"), low=low, high=high)
    bent = F.transform(doubles(data), lambda x: F.least(F.greatest(gain * F.pow(x, g), F.lit(0.0)), F.lit(1.0)))
    return F.when(bernoulli(p, seed, *keys, F.lit("on")), bent).otherwise(doubles(data))


def branch(p_first: float, p_second: float, seed: int, *keys: ColumnLike) -> Column:
    """first, second or none of two exclusive transforms, by one draw."""
    u = uniform(seed, *keys)
    return F.when(u < p_first, "first").when(u < p_first + p_second, "second").otherwise("none")


def aspect_crop(data: ColumnLike, height: ColumnLike, width: ColumnLike, rows: ColumnLike, columns: ColumnLike) -> Column:
    """Zero outside the centred strip of rows x columns; the strip's size is brought to the parity of the image's."""
    h, w = col(height), col(width)
    even = lambda n, m: n - F.pmod(m - n, F.lit(2))
    r, c = even(col(rows), h), even(col(columns), w)

    def strip(s: Column) -> Column:
        y, x = (lambda i: F.floor(i / s["w"])), (lambda i: i % s["w"])
        inside = lambda i: (y(i) >= s["y0"]) & (y(i) < s["y1"]) & (x(i) >= s["x0"]) & (x(i) < s["x1"])
        return F.transform(s["a"], lambda v, i: F.when(inside(i), v).otherwise(F.lit(0.0)))

    y0, x0 = F.floor((h - r) / 2), F.floor((w - c) / 2)
    return bind_fields(strip, a=doubles(data), w=w, y0=y0, y1=y0 + r, x0=x0, x1=x0 + c)


def flip(data: ColumnLike, width: ColumnLike) -> Column:
    """The image turned left to right."""
    return flipped(data, width)


def zoom_box(y: ColumnLike, x: ColumnLike, height: ColumnLike, width: ColumnLike, zoom: ColumnLike) -> Column:
    """y0, x0, y1, x1 of a box of the image's size over ``zoom`` around a place, moved inside the image."""
    h, w = F.floor(col(height) / col(zoom)), F.floor(col(width) / col(zoom))
    y0 = F.least(F.greatest(F.floor(col(y) - h / 2 + 0.5), F.lit(0)), col(height) - h)
    x0 = F.least(F.greatest(F.floor(col(x) - w / 2 + 0.5), F.lit(0)), col(width) - w)
    return F.struct(y0.cast("int").alias("y0"), x0.cast("int").alias("x0"), (y0 + h).cast("int").alias("y1"), (x0 + w).cast("int").alias("x1"))


def stamp(data: ColumnLike, width: ColumnLike, glyph: list[list[float]], y: ColumnLike, x: ColumnLike, intensity: ColumnLike) -> Column:
    """A small glyph blended in by maximum at a place."""
    gh, gw = len(glyph), len(glyph[0])
    flat = F.array(*(F.lit(float(v)) for row in glyph for v in row))
    w = col(width).cast("int")
    dy, dx = (lambda i: F.floor(i / w).cast("int") - col(y)), (lambda i: (i % w) - col(x))
    ink = lambda i: F.when((dy(i) >= 0) & (dy(i) < gh) & (dx(i) >= 0) & (dx(i) < gw), F.get(flat, (dy(i) * gw + dx(i)).cast("int")) * col(intensity)).otherwise(F.lit(0.0))
    return F.transform(doubles(data), lambda v, i: F.greatest(v, ink(i)))


def restore_hard(channels: ColumnLike, threshold: float = 0.5) -> Column:
    """Soft [channel][pixel] labels back to 0 and 1, background where no foreground is above the threshold."""
    return background_complement(F.transform(col(channels), lambda c: F.transform(c, lambda x: F.when(x > threshold, 1.0).otherwise(0.0))))


# -- rendering ---------------------------------------------------------------------------------------------

def parallel_projection(voxels: DataFrame, axis: str = "j") -> DataFrame:
    """Sums of attenuation along one axis: voxels(sample_id, i, j, k, value); the plain case of a rendered view."""
    rest = [c for c in "ijk" if c != axis]
    return voxels.groupBy("sample_id", *rest).agg(F.sum("value").alias("value"))


def scale_views(pixels: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Each view's pixels to [0, 1], non-finite ones as 0: pixels(view, value)."""
    inf = float("inf")
    clean = pixels.withColumn("value", F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == inf), 0.0).otherwise(F.col("value")))
    ends = clean.groupBy("view").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return clean.join(ends, "view").withColumn("value", (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(eps))).drop("_lo", "_hi")


def collapse_channels(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """Rendered channels merged into targets by maximum: pixels(view, channel, pixel, value), targets(channel, target); target 0 is dropped."""
    return pixels.join(targets.where("target > 0"), "channel").groupBy("view", (F.col("target") - 1).alias("channel"), "pixel").agg(F.max("value").alias("value"))
