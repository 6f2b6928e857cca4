"""Metrics, losses and reports on literal cases."""

import math

import pytest

from maskframe.operators import metrics, reporting


def images(spark, *pairs):
    double = lambda a: [[float(x) for x in c] for c in a]
    return spark.createDataFrame([(f"s{k}", double(p), double(t)) for k, (p, t) in enumerate(pairs)], "sample_id string, pred array<array<double>>, target array<array<double>>")


def one(df):
    return df.first()["score"]


def test_overlapping_channels(spark):
    df = images(spark, ([[1.0, 1, 0, 0], [0.0, 1, 0, 0]], [[1.0, 1, 0, 0], [0.0, 1, 0, 1]]))
    got = metrics.dice(metrics.channels(df)).orderBy("class_id").collect()
    assert [r["score"] for r in got] == pytest.approx([1, 2 / 3])


def test_weighted_and_ignored(spark):
    df = images(spark, ([[1.0, 0], [1.0, 0], [1.0, 0]], [[1.0, 0], [1.0, 0], [1.0, 1]]))
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "class_id int, weight double")
    scores = metrics.weigh(metrics.dice(metrics.channels(df)), weights, ignore_index=[1])
    assert [r["score"] for r in metrics.reduce_classes(scores, "none").orderBy("class_id").collect()] == pytest.approx([1, 0, 2])


def test_empty_and_background(spark):
    empty = metrics.dice(metrics.channels(images(spark, ([[1.0, 0], [1.0, 0]], [[1.0, 0], [0.0, 0]]))))
    assert one(metrics.reduce_batch(metrics.reduce_classes(metrics.weigh(empty)))) == pytest.approx(0.5)
    assert one(metrics.reduce_batch(metrics.reduce_classes(metrics.weigh(empty, ignore_empty=True)))) == 1
    background = metrics.dice(metrics.channels(images(spark, ([[1.0, 0], [0.0, 1]], [[0.0, 1], [0.0, 1]]))))
    assert one(metrics.reduce_batch(metrics.reduce_classes(metrics.weigh(background)))) == pytest.approx(0.5)
    assert one(metrics.reduce_batch(metrics.reduce_classes(metrics.weigh(background, ignore_background=True)))) == 1


def test_samples_without_weight_leave_the_mean(spark):
    scores = spark.createDataFrame([("a", 0, 0.5, 1.0), ("b", 0, 0.1, 0.0)], "sample_id string, class_id int, score double, amount double")
    weighed = metrics.weigh(scores, ignore_empty=True)
    assert one(metrics.reduce_batch(metrics.reduce_classes(weighed))) == 0.5
    assert one(metrics.reduce_batch(metrics.reduce_classes(weighed, "sum"))) == 0.25
    assert one(metrics.reduce_batch(metrics.reduce_classes(weighed.where("sample_id = 'b'")))) == 0


def square(h, w, y0, x0, n=3):
    return [1.0 if y0 <= k // w < y0 + n and x0 <= k % w < x0 + n else 0.0 for k in range(h * w)]


@pytest.mark.parametrize(("p", "t", "w", "want"), [(square(5, 5, 1, 1), square(5, 5, 1, 1), 5, 0), ([0.0] * 20, [0.0] * 20, 4, 0), ([0.0] * 20, [1.0] + [0.0] * 19, 4, 5), (square(5, 5, 1, 0), square(5, 5, 1, 1), 5, 1), ([float(k in (1, 5, 9, 19)) for k in range(20)], [float(k in (1, 5, 9)) for k in range(20)], 20, 8.5)])
def test_hd95(spark, p, t, w, want):
    df = spark.createDataFrame([("s", 0, p, t, w)], "sample_id string, class_id int, p array<double>, t array<double>, width int")
    assert one(metrics.hd95(df)) == pytest.approx(want)


def test_thresholds(spark):
    categorical = images(spark, ([[0.4], [0.6]], [[0.0], [1.0]]))
    assert [r["score"] for r in metrics.dice(metrics.channels(categorical, "onehot", 0.9)).where("class_id = 1").collect()] == [1]
    binary = images(spark, ([[0.6] * 4], [[1.0] * 4]))
    assert one(metrics.dice(metrics.channels(binary, threshold=0.5))) == 1
    assert one(metrics.dice(metrics.channels(binary, threshold=0.9), smooth=0.0)) == 0
    assert one(metrics.dice(metrics.channels(images(spark, ([[0.0, 1.0], [1.0, 0.0]], [[1.0, 0.0]])), "multiclass"))) == 1
    with pytest.raises(Exception, match="not finite"):
        metrics.channels(images(spark, ([[math.nan]], [[1.0]]))).collect()


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 2.0], [1.0, 0.0], [0.5, 0.0])], "p array<double>, t array<double>, w array<double>")
    got = df.select(metrics.reduce_pixels(metrics.bce("p", "t")).alias("mean"), metrics.reduce_pixels(metrics.bce("p", "t"), "w").alias("weighted")).first()
    assert got["mean"] == pytest.approx((math.log(2) + 2 + math.log1p(math.exp(-2))) / 2)
    assert got["weighted"] == pytest.approx(0.5 * math.log(2))  # a sum of weights below 1 is not normalised
    kept = spark.createDataFrame([(2.0, 1.0), (4.0, 0.0)], "loss double, keep double")
    assert metrics.reduce_kept(kept).first()["loss"] == 2 and metrics.reduce_kept(kept.where("keep = 0")).first()["loss"] == 0


def test_phase_means(spark):
    records = spark.createDataFrame([("A", "dice", 1.0, 1), ("B", "dice", 0.0, 1), ("A", "loss", 2.0, 2), ("B", "loss", 6.0, 1), ("B", "hd", 1.0, 0)], "dataset string, metric string, value double, weight int")
    got = {r["key"]: r["value"] for r in reporting.phase_means(records).collect()}
    assert got == pytest.approx({"dice": 0.5, "A/dice": 1, "B/dice": 0, "loss": 10 / 3, "A/loss": 2, "B/loss": 6})


def test_evaluation_means(spark):
    rows = spark.createDataFrame([("e", "a", 1.0, True), ("e", "a", 0.0, True), ("e", "a", 9.0, False), ("e", "b", 5.0, False)], "eval_set string, dataset string, score double, eligible boolean")
    by_dataset, by_set = reporting.evaluation_means(rows)
    assert {r["dataset"]: r["dice"] for r in by_dataset.collect()} == {"a": 0.5, "b": 0.0} and by_set.first()["dice"] == 0.25


def test_metrics_table(spark):
    rows = [(1, "train", "", "loss", 1.23456, 0), (1, "train", "", "dice", 0.5, 1), (1, "val", "HipRay", "loss", 0.98765, 2), (1, "val", "HipRay", "loss", None, 9), (1, "val", "JRST", "dice", 0.7, 4)]
    records = spark.createDataFrame(rows, "epoch int, phase string, dataset string, metric string, value double, pos int")
    table = reporting.metrics_table(records)
    assert table.columns == ["epoch", "metric", "train", "val/HipRay", "val/JRST"]
    assert {r["metric"]: r["val/HipRay"] for r in table.collect()} == {"loss": 0.98765, "dice": None}
    assert [r["metric"] for r in reporting.metric_order(records).orderBy("first").collect()] == ["loss", "dice"]


def test_progress_and_average(spark):
    batches = spark.createDataFrame([(k, k == 4) for k in range(5)], "idx int, is_last boolean")
    assert [r["idx"] + 1 for r in batches.where(reporting.every_nth(3)).orderBy("idx").collect()] == [1, 3, 5]
    for decay, n in ((0.9, 50), (0.001, 300)):
        values = spark.createDataFrame([("w", k, math.sin(k)) for k in range(n)], "name string, step int, value double")
        shadow = None
        for k in range(n):
            shadow = math.sin(k) if shadow is None else decay * shadow + (1 - decay) * math.sin(k)
        got = {r["step"]: r["shadow"] for r in reporting.moving_average(values, decay, start_after=-1).collect()}
        assert got[n - 1] == pytest.approx(shadow)


def test_dice_of_nothing_is_one_by_default(spark):
    nothing = metrics.channels(images(spark, ([[0.0, 0.0]], [[0.0, 0.0]])))
    assert one(metrics.dice(nothing)) == 1 and one(metrics.soft_dice(nothing)) == 1
    assert one(metrics.dice(nothing, smooth=0.0)) == 0
