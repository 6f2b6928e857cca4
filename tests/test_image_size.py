"""Images of real size: exact distances, and work that is linear in pixels."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import kernels
from maskframe.operators import metrics, raster, stacks

RNG = np.random.default_rng(11)


def test_squared_distances_are_exact():
    for _ in range(300):
        h, w = RNG.integers(1, 14, 2)
        mask = RNG.random((h, w)) < RNG.choice([0.03, 0.3, 0.8])
        got = kernels.squared_distance_to(mask)
        if not mask.any():
            assert got is None
            continue
        ys, xs = np.nonzero(mask)
        want = ((np.arange(h)[:, None, None] - ys) ** 2 + (np.arange(w)[None, :, None] - xs) ** 2).min(axis=-1)
        assert (got == want).all()


def test_envelope_of_any_heights():
    for _ in range(100):
        heights = RNG.integers(0, 60, (4, 17)).astype(float)
        x = np.arange(17)
        assert (kernels.lower_envelope(heights) == (heights[:, None, :] + (x[:, None] - x[None, :]) ** 2).min(axis=2)).all()


def test_outline_and_hausdorff():
    square = np.zeros((5, 5), bool)
    square[1:4, 1:4] = True
    assert kernels.outline(square).sum() == 8 and kernels.outline(np.ones((3, 3), bool)).sum() == 8
    assert kernels.hausdorff95(square, square) == 0 and kernels.hausdorff95(square & False, square & False) == 0
    assert kernels.hausdorff95(np.ones((5, 4), bool), np.zeros((5, 4), bool)) == 5


@pytest.mark.parametrize("share", [0.5, 0.01, 0.0001])
def test_noise_of_512_by_512(share):
    a, b = (RNG.random((512, 512)) < share for _ in "ab")
    began = time.time()
    assert kernels.hausdorff95(a, b) > 0
    assert time.time() - began < 4  # about 0.4 s alone on a machine


@pytest.fixture(scope="module")
def image(spark):
    """One image of 512 x 512 pixels, and the same with fewer, as columns that are not plain."""
    n = 512 * 512
    made = spark.range(1).select(F.lit("a").alias("sample_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * 7919 % 1009) / 1009.0).alias("a"))
    return made.cache()


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_losses_and_geometry_of_512_by_512(image):
    side = F.lit(512)
    part = F.slice("a", 1, 500 * 512).cast("array<double>")
    two = image.select("sample_id", F.array("a", F.reverse("a")).alias("pred"), F.array(F.transform("a", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)), F.transform("a", lambda x: F.when(x > 0.5, 0.0).otherwise(1.0))).alias("target"))
    work = {
        "cross entropy": metrics.categorical_cross_entropy(two, True, [1.0, 2.0], 0),
        "pad": image.select(raster.pad_square(part, F.lit(500), side).alias("x")),
        "nearest": image.select(raster.resize_nearest(part, F.lit(500), side, 512, 512).alias("x")),
        "resample": image.select(raster.resample_1d(part, 400_000).alias("x")),
        "crop": image.select(raster.crop_or_pad(part, (F.lit(500), F.lit(512), F.lit(1)), (512, 500, 1), (F.lit(-3), F.lit(4), F.lit(0)), 0.0).alias("x")),
        "flip": image.select(raster.flipped(part, side).alias("x")),
    }
    assert {k: s for k, s in ((k, seconds(df)) for k, df in work.items()) if s > 8} == {}  # about 1 s alone


def test_cross_entropy_of_logits(spark):
    pred, target = RNG.normal(size=(3, 40)) * 30, np.eye(3)[RNG.integers(0, 3, 40)].T
    images = spark.createDataFrame([("a", pred.tolist(), target.tolist())], "sample_id string, pred array<array<double>>, target array<array<double>>")
    logs = pred - pred.max(axis=0) - np.log(np.exp(pred - pred.max(axis=0)).sum(axis=0))
    got = lambda **k: metrics.categorical_cross_entropy(images, **k).first()["loss"]
    assert got() == pytest.approx(-(target * logs).sum(axis=0).round(12), abs=1e-9)
    weights = np.array([1.0, 2.0, 0.5])
    assert got(class_weights=[1.0, 2.0, 0.5], ignore_index=1) == pytest.approx(np.where(target[1] > 0, 0, -(target * logs * weights[:, None]).sum(axis=0)), abs=1e-9)
    assert got(from_logits=False) == pytest.approx(-(target * pred).sum(axis=0), abs=1e-9)


@pytest.mark.parametrize(("how", "merge"), [("mean", np.mean), ("max", np.max)])
def test_merged_arrays(spark, monkeypatch, how, merge):
    monkeypatch.setattr(stacks, "HELD", 20)
    data = {g: RNG.random((n, 7)) for g, n in (("a", 1), ("b", 4), ("c", 30))}
    rows = [(g, k % 2, a.tolist()) for g, arrays in data.items() for k, a in enumerate(arrays)] + [("a", 0, None)]
    got = stacks.merged_arrays(spark.createDataFrame(rows, "g string, part int, v array<double>").repartition(3), ["g", "part"], "v", how).collect()
    assert len(got) == 5
    for r in got:
        assert r["v"] == pytest.approx(merge(data[r["g"]][r["part"] :: 2], axis=0))
    with pytest.raises(Exception, match="differ in length"):
        stacks.merged_arrays(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "g string, v array<double>").coalesce(1), ["g"], "v").collect()
    assert stacks.merged_arrays(spark.createDataFrame([], "g string, v array<double>"), ["g"], "v").count() == 0
