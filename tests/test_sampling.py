"""Seeded draws, views, augmentations and settings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from maskframe.functions import config
from maskframe.operators import sampling


def test_draws(spark):
    df = spark.range(4000)
    u = df.select(sampling.uniform(1, "id").alias("u"), sampling.normal(1, "id").alias("n"), sampling.truncated_lognormal(0.5, 0.5, 0.2, 2.0, 1, "id").alias("l"))
    r = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n"), F.min("l"), F.max("l")).first()
    assert 0 <= r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.02 and abs(r[3]) < 0.05 and abs(r[4] - 1) < 0.05 and r[5] >= 0.2 and r[6] <= 2
    again = df.repartition(7).select(F.sum(sampling.uniform(1, "id"))).first()[0]
    assert again == pytest.approx(df.select(F.sum(sampling.uniform(1, "id"))).first()[0])
    shares = {r[0]: r[1] for r in df.groupBy(sampling.branch(0.1, 0.25, 2, "id")).count().collect()}
    assert abs(shares["first"] - 400) < 70 and abs(shares["second"] - 1000) < 100


def test_isocenters(spark):
    c = spark.createDataFrame([("s", k, 0.0, 0.0, float(k)) for k in range(3)], "sample_id string, label int, i double, j double, k double")
    got = sampling.sample_isocenters(c, 5, 1).orderBy("view_idx").collect()
    assert len(got) == 5 and {r["label"] for r in got[:3]} == {0, 1, 2}
    affine = F.array(*map(F.lit, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 2, 5, 0, 0, 0, 1]))
    assert spark.range(1).select(sampling.volume_center(F.lit(3), F.lit(5), F.lit(5), affine)).first()[0] == [1, 2, 9]


@pytest.mark.parametrize("replacement", [False, True])
def test_isocenters_of_many_centroids(spark, replacement):
    """Against a sort of each sample's centroids; without replacement only the first few reach the window."""
    c = spark.range(3000).select((F.col("id") % 3).alias("sample_id"), F.col("id").alias("label"), *(F.lit(0.0).alias(x) for x in "ijk")).where("sample_id < 2 OR label < 9").repartition(5)
    u = lambda *keys: int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32
    want = set()
    for s in range(3):
        order = sorted((label for label in range(s, 3000 if s < 2 else 9, 3)), key=lambda label: (u(1, s, label), label))
        for view in range(4):
            again = int(u(1, s, view, "again") * len(order))
            want.add((s, view, order[view if view < len(order) and not replacement else again]))
    got = sampling.sample_isocenters(c, 4, 1, replacement)
    assert {(r["sample_id"], r["view_idx"], r["label"]) for r in got.collect()} == want and got.count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("WindowGroupLimit" in plan) == (not replacement) and "count(1) windowspecdefinition" not in plan


def test_presets(spark):
    views = spark.createDataFrame([(k,) for k in range(5)], "view_idx int")
    presets = spark.createDataFrame([(0, "ap"), (1, "lateral")], "preset_idx int, name string")
    assert [r["name"] for r in sampling.cycled_presets(views, presets, 2).orderBy("view_idx").collect()] == ["ap", "lateral", "ap", "lateral", "ap"]


def test_augmentations(spark):
    df = spark.createDataFrame([([0.0, 0.25, 1.0, 0.5],)], "a array<double>")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(sampling.flip("a", F.lit(2))) == [0.25, 0, 0.5, 1]
    assert one(sampling.gamma("a", 2.0, 2.0, 1.0, 1, F.lit(0))) == [0, 0.0625, 1, 0.25]
    assert one(sampling.stamp("a", F.lit(2), [[1.0]], F.lit(0), F.lit(1), F.lit(0.75))) == [0, 0.75, 1, 0.5]
    assert one(sampling.intensity_scale("a", 1.0, 1.0, 1.0, 1, F.lit(0))) == [0, 0.5, 2, 1]
    box = one(sampling.zoom_box(F.lit(0), F.lit(9), F.lit(10), F.lit(10), F.lit(2.0)))
    assert tuple(box) == (0, 5, 5, 10)
    soft = spark.createDataFrame([([[0.2, 0.9], [0.6, 0.1]],)], "c array<array<double>>")
    assert soft.select(sampling.restore_hard("c")).first()[0] == [[0, 1], [1, 0]]


def test_collapse(spark):
    pixels = spark.createDataFrame([("v", c, 0, float(c)) for c in range(4)], "view string, channel int, pixel int, value double")
    targets = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "channel int, target int")
    assert sorted(tuple(r) for r in sampling.collapse_channels(pixels, targets).collect()) == [("v", 0, 0, 2.0), ("v", 1, 0, 3.0)]


def test_settings(spark):
    base = {"a": {"b": 1, "c": [1]}, "d": "?"}
    assert config.get(base, "a.b") == 1 and config.flatten(base) == {"a.b": 1, "a.c": [1], "d": "?"} and config.missing(base) == ["d"]
    with pytest.raises(KeyError, match="a.x"):
        config.get(base, "a.x.y")
    assert config.merge(base, {"a": {"c": [2]}, "d": {"e": 1}}) == {"a": {"b": 1, "c": [2]}, "d": {"e": 1}} == config.override(base, {"a.c": [2], "d.e": 1})
    with pytest.raises(ValueError):
        config.override(base, {"a..b": 1})
    assert config.digest({"a": 1, "b": 2}) == config.digest({"b": 2, "a": 1})
    assert config.integer_weights(["a", "b", "c"], {"a": "0.375", "b": 0.01}) == {"a": 75, "b": 2, "c": 200}
    ids = spark.createDataFrame([("20240101_000000-AB-x",), ("a-b",), ("a--b",), ("a-b-c/d",)], "r string")
    assert [r[0] for r in ids.select(config.valid_run_id("r")).collect()] == [True, False, False, False]
