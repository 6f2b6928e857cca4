"""Normalisation, geometry and post-processing on literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import kernels, normalise
from maskframe.operators import raster


def arrays(spark, *values):
    return spark.createDataFrame([(list(map(float, v)),) for v in values], "a array<double>")


def first(df, c):
    return df.select(c.alias("x")).first()["x"]


def test_probabilities(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.5, 1.0, 1.2, -0.1)], "p double")
    assert [r[0] for r in df.select(normalise.quantize_probability("p")).collect()] == [0, 128, 255, 255, 0]
    back = lambda v, d: first(arrays(spark, v), normalise.dequantize_probabilities("a", F.lit(d)))
    assert back([1, 0], "bool") == [1, 0] and back([0, 1], "int16") == [0, 1] and back([0, 128, 255], "int16") == pytest.approx([0, 128 / 255, 1]) and back([0.25, 1], "float64") == [0.25, 1]
    for v, d in (([-1], "int16"), ([1.1], "float32")):
        with pytest.raises(Exception, match="out of range"):
            back(v, d)


def test_scalings(spark):
    x = np.array([1.0, 2, 4, 9])
    df = arrays(spark, x)
    assert first(df, normalise.unit_range("a")) == pytest.approx((x - 1) / 8)
    assert first(df, normalise.standardize("a")) == pytest.approx((x - x.mean()) / (x.std(ddof=1) + 1e-8))
    lo, hi = np.percentile(x, [0.5, 99.5])
    assert first(df, normalise.percentile_minmax("a")) == pytest.approx((np.clip(x, lo, hi) - lo) / (hi - lo))
    for f in (normalise.unit_range, normalise.minmax, normalise.percentile_minmax, normalise.standardize):
        assert first(arrays(spark, [5, 5, 5]), f("a")) == [0, 0, 0]
    assert first(arrays(spark, [0, 255]), normalise.integer_range_scale("a", F.lit("uint8"))) == [0, 1]
    assert first(arrays(spark, [10, 30]), normalise.integer_range_scale("a", F.lit("int32"))) == [0, 1]
    assert first(arrays(spark, [1, float("nan"), float("inf")]), normalise.finite_or_zero("a")) == [1, 0, 0]


def test_hu(spark):
    df = spark.createDataFrame([(-990.0,), (-700.0,), (10.0,)], "x double")
    assert [r[0] for r in df.select(normalise.hu_bounds("x", -500, -900)).collect()] == [-1000, -500, 10]


def test_content_box(spark):
    got = spark.range(1).select(raster.content_box(F.lit(40), F.lit(64), 32).alias("b")).first()["b"]
    assert tuple(got) == (6, 0, 26, 32)
    pad = spark.range(1).select(raster.square_padding(F.lit(40), F.lit(64)).alias("b")).first()["b"]
    assert tuple(pad) == (12, 12, 0, 0)


def test_resizing(spark):
    image = np.arange(24.0).reshape(4, 6) / 24
    df = arrays(spark, image.ravel())
    assert first(df, raster.resize_area("a", F.lit(4), F.lit(6), 2, 3)) == pytest.approx(image.reshape(2, 2, 3, 2).mean(axis=(1, 3)).ravel())
    assert first(df, raster.resize_nearest("a", F.lit(4), F.lit(6), 2, 3)) == pytest.approx(image[[0, 2]][:, [0, 2, 4]].ravel())
    assert kernels.resize(np.ones((5, 7)), 3, 9, "bilinear") == pytest.approx(np.ones((3, 9)))


def test_hip_cleanup(spark):
    femur, hip = np.zeros((11, 11)), np.zeros((11, 11))
    femur[5, 5], hip[5, 9], hip[5, 10] = 0.9, 0.8, 0.8
    df = spark.createDataFrame([(hip.ravel().tolist(), femur.ravel().tolist())], "h array<double>, f array<double>")
    got = np.array(first(df, raster.remove_near("h", "f", F.lit(11), 0.5, 4.0))).reshape(11, 11)
    assert got[5, 9] == 0 and got[5, 10] == 1 and got.sum() == 1


def test_lung_cleanup(spark):
    df = spark.createDataFrame([([0.7, 0.6, 0.4, 0.2], [0.8, 0.5, 0.51, 0.49])], "l array<double>, o array<double>")
    assert first(df, raster.suppress("l", "o", 0.5)) == [0, 0.6, 0, 0.2]


def test_closest_component(spark):
    m, o = np.zeros((64, 64)), np.zeros((64, 64))
    m[10:30, 10:30] = m[45:51, 45:51] = m[55:58, 55:58] = 1
    o[54:58, 54:58] = 1
    df = spark.createDataFrame([(m.ravel().tolist(), o.ravel().tolist()), (m.ravel().tolist(), None)], "m array<double>, o array<double>")
    got = [np.array(r[0]).reshape(64, 64) for r in df.select(raster.closest_component("m", "o", F.lit(64), F.lit(64))).collect()]
    assert got[0].sum() == 36 and got[0][45:51, 45:51].all()
    assert (got[1] == m).all()


def test_components_are_8_connected():
    grid = np.zeros((9, 9), bool)
    for k in (6, 7, 8):
        grid[k, k] = True
    grid[0, 0] = grid[1, 0] = grid[0, 8] = True
    labels, sizes = kernels.components(grid)
    assert sizes.tolist() == [0, 2, 1, 3] and labels[8, 8] == 3
    rng = np.random.default_rng(0)
    for _ in range(20):
        g = rng.random((12, 15)) < 0.5
        labels, sizes = kernels.components(g)
        for y, x in zip(*np.nonzero(g)):
            around = labels[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            assert set(around[around > 0]) == {labels[y, x]}
        assert sizes.sum() == g.sum() and (np.bincount(labels.ravel(), minlength=len(sizes))[1:] == sizes[1:]).all()


def test_distance():
    rng = np.random.default_rng(1)
    g = rng.random((9, 13)) < 0.1
    y, x = np.nonzero(g)
    yy, xx = np.mgrid[:9, :13]
    want = np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(axis=-1))
    assert kernels.distance_to(g) == pytest.approx(want) and kernels.distance_to(g & False) is None


def test_equalize_keeps_range(spark):
    rng = np.random.default_rng(2)
    image = rng.random((32, 48)) * 0.2 + 0.4
    got = np.array(first(arrays(spark, image.ravel()), raster.equalize("a", F.lit(32), F.lit(48), 40.0, (2, 2))))
    assert got.min() >= 0 and got.max() <= 1 and got.std() > image.std()
    smooth = first(arrays(spark, image.ravel()), raster.smooth_labels("a", F.lit(32), F.lit(48), 1.0, 5))
    assert np.std(smooth) < image.std()


def test_affine(spark):
    df = arrays(spark, [2, 0, 0, 10, 0, 3, 0, -5, 0, 0, 0.5, 1, 0, 0, 0, 1])
    assert first(df, raster.determinant("a")) == 3
    assert first(df, raster.voxel_to_world(raster.offset_affine("a", F.lit(4)), F.lit(1), F.lit(1), F.lit(2))) == [12, -2, 4]
    assert first(spark.range(1), raster.intrinsics(F.lit(10.0), F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), 4, 6)) == pytest.approx([0.2, 0, -0.6, 0, 0.2, -0.4, 0, 0, 1])
    for n, size, u, want in ((10, 4, 0.99, 6), (4, 10, 0.0, 0), (4, 10, 0.99, -6)):
        assert first(spark.range(1), raster.crop_offset(F.lit(n), size, F.lit(u))) == want


def test_equalize_by_hand():
    flat = kernels.equalize_tiles(np.full((4, 4), 0.5), 40.0, (1, 1))  # limit 2: 2 stay in bin 127, 14 go to bins 0 to 13
    assert flat == pytest.approx(np.ones((4, 4)))
    halves = np.array([[1.0, 1, 0, 0], [1, 1, 0, 0]])  # two tiles, unclipped: bin 0 maps to 0 in the left one and to 1 in the right one
    assert kernels.equalize_tiles(halves, 256.0, (1, 2)) == pytest.approx(np.array([[1, 1, 0.5, 1]] * 2))
    steps = np.array([[0.0, 0.999, 0.25, 0.5]] * 4)  # bins 0, 254, 63 and 127, of 4 each
    assert kernels.equalize_tiles(steps, 256.0, (1, 1))[0] * 255 == pytest.approx([63, 255, 127, 191])
    odd = kernels.equalize_tiles(np.random.default_rng(3).random((3, 5)), 40.0, (8, 8))
    assert odd.shape == (3, 5)
    with pytest.raises(ValueError):
        kernels.equalize_tiles(flat, 0.0, (1, 1))


def test_removal_on_computed_masks(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((40, 50)), (rng.random((40, 50)) < 0.01) * 1.0
    y, x = np.nonzero(b)
    yy, xx = np.mgrid[:40, :50]
    near = (((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2) <= 9).any(axis=-1)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    assert first(df, raster.remove_near("a", "b", F.lit(50), 0.5, 3.0)) == ((a > 0.5) & ~near).astype(float).ravel().tolist()
    assert first(df, raster.remove_near("a", F.transform("b", lambda v: v * 0), F.lit(50), 0.5, 3.0)) == (a > 0.5).astype(float).ravel().tolist()


def test_scalings_are_linear_in_pixels(spark):
    """An image of 512 x 512 through every scaling; time by pixel squared would not end here."""
    n = 512 * 512
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * 7919 % 10_007).cast("double")).alias("a"))
    x = np.arange(n) * 7919 % 10_007
    lo, hi = np.percentile(x, [0.5, 99.5])
    want = {"unit_range": x / 10_006, "minmax": x / 10_006, "percentile_minmax": (np.clip(x, lo, hi) - lo) / (hi - lo), "standardize": (x - x.mean()) / x.std(ddof=1), "softmax": np.exp(x - 10_006.0) / np.exp(x - 10_006.0).sum()}
    for name, expected in want.items():
        got = df.select(F.transform(getattr(normalise, name)("a"), lambda y: y * y).alias("v")).select(F.aggregate("v", F.lit(0.0), lambda s, y: s + y)).first()[0]
        assert got == pytest.approx((expected**2).sum()), name


def test_normalisation_settings(spark):
    block = lambda **b: {"train": {"normalization": b}}
    assert normalise.normalisation(None) == normalise.normalisation({"train": {}}) == {"scheme": "standardize", "percentiles": None, "eps": 1e-8}
    assert normalise.normalisation(block()) == {"scheme": "percentile_minmax", "percentiles": (0.5, 99.5), "eps": 1e-8}
    assert normalise.normalisation(block(scheme="minmax", percentiles=[1, 2], eps=1)) == {"scheme": "minmax", "percentiles": None, "eps": 1.0}
    for bad in ({"x": 1}, {"scheme": "none"}, {"eps": 0}, {"eps": float("nan")}, {"percentiles": [2, 1]}, {"percentiles": [0, 101]}, {"percentiles": [1]}, {"percentiles": [True, 2]}):
        with pytest.raises(ValueError):
            normalise.normalisation(block(**bad))
    df = arrays(spark, [1, 2, 3, 9])
    for settings, column in ((None, normalise.standardize("a")), (block(scheme="minmax"), normalise.minmax("a")), (block(percentiles=[10, 90]), normalise.percentile_minmax("a", 10, 90))):
        assert first(df, normalise.normalised("a", settings)) == first(df, column)
