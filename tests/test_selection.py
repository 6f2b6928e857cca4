"""Selection, splits, schedules and weights on literal cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from maskframe.operators import selection
from maskframe.plans import catalog


def test_filter_records(spark):
    rows = [("xray", "HipRay", "train", "a.png", "", "image_001", 1), ("xray", "HipRay", "train", "b.png", None, "image_002", 2), ("xray", "HipRay", "train", None, None, "image_003", 3), ("ct", "HipRay", "train", "c", None, "v", 4)]
    records = spark.createDataFrame(rows, "modality string, dataset_name string, split string, label string, subject_id string, data_id string, pos int")
    excluded = spark.createDataFrame([("image_001",)], "subject string")
    kept = lambda n: [r["data_id"] for r in selection.filter_records(records, "xray", ["HipRay"], "train", True, excluded, n).collect()]
    assert kept(1) == kept(0) == kept(None) == ["image_002"]
    assert selection.label_missing(records.where("data_id = 'image_003'")).count() == 1
    with pytest.raises(ValueError):
        kept(-1)


@pytest.mark.parametrize(("depth", "crop", "overlap", "starts"), [(20, 8, 0, [0, 6, 12]), (20, 8, 0.5, [0, 4, 8, 12]), (20, 8, 0.75, [0, 2, 4, 6, 8, 10, 12]), (16, 5, 0.5, [0, 3, 6, 8, 11]), (8, 3, 0.99, [0, 1, 2, 3, 4, 5]), (9, 8, 0.5, [0, 1]), (12, 8, 0.5, [0, 4]), (300, 256, 0.9, [0, 22, 44]), (700, 256, 0, [0, 222, 444])])
def test_crop_starts(spark, depth, crop, overlap, starts):
    plan = spark.createDataFrame([(depth,)], "depth int").select(selection.crop_plan("depth", crop, overlap).alias("p")).first()["p"]
    assert [c["z_start"] for c in plan] == starts
    assert all(c["z_stop"] - c["z_start"] == crop for c in plan)


def test_crop_padding(spark):
    pads = [(r["p"][0]["pad_before"], r["p"][0]["pad_after"]) for r in spark.createDataFrame([(3,), (8,)], "depth int").select(selection.crop_plan("depth", 8).alias("p")).collect()]
    assert pads == [(2, 3), (0, 0)]


@pytest.mark.parametrize(("how", "tau", "ratio"), [("mean", 1.0, 2.5), ("max", 1.0, 4.0), ("max", 0.5, 2.0)])
def test_inverse_frequency(spark, how, tau, ratio):
    classes = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1), (3, 2), (3, 2)], "crop int, class int")
    w = {r["crop"]: r["weight"] for r in selection.inverse_frequency_weights(classes, spark.range(5).select(F.col("id").cast("int").alias("crop")), tau, how).collect()}
    assert w[3] / w[0] == pytest.approx(ratio)
    assert w[4] == 0 and sum(w.values()) / 5 == pytest.approx(1)


@pytest.mark.parametrize(("weights", "steps", "shares"), [({"xray": 2, "ct": 1}, 7, {"xray": 5, "ct": 2}), ({"a": 16, "b": 16, "c": 2, "d": 1}, 37, {"a": 17, "b": 17, "c": 2, "d": 1})])
def test_apportion(spark, weights, steps, shares):
    got = selection.apportion(spark.createDataFrame(list(weights.items()), "source string, weight long"), steps)
    assert {r["source"]: r["n"] for r in got.collect()} == shares


def test_schedule_is_even_and_seeded(spark):
    counts = spark.createDataFrame([("a", 16), ("b", 12), ("c", 4)], "source string, n long")
    order = lambda epoch, df=counts: [r["source"] for r in selection.stratified_schedule(df, 1, epoch).orderBy("position", "source").collect()]
    assert order(0) == order(0, counts.orderBy(F.desc("source"))) != order(1)
    assert sum(x != y for x, y in zip(order(0), order(0)[1:])) > 2


def test_splits_by_subject(spark):
    subjects = spark.createDataFrame([(f"P{k:02d}",) for k in range(1003)], "subject string")
    got = selection.subject_splits(subjects.union(subjects), {"train": 60, "val": 20, "test": 20})
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 602, "val": 201, "test": 200}
    with pytest.raises(ValueError):
        selection.subject_splits(subjects, {"train": 50, "val": 20, "test": 20})


def test_stems_pair(spark):
    images = spark.createDataFrame([("p1.PNG",), ("p2.png",), ("notes.txt",)], "name string")
    masks = spark.createDataFrame([("p1.nii.gz",), ("p3.nii",)], "name string")
    pairs = selection.pair_by_stem(images, masks, (".nii.gz", ".nii", ".png"))
    assert [tuple(r) for r in pairs.collect()] == [("p1", "p1.PNG", "p1.nii.gz")]


def test_draws_follow_weights(spark):
    items = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "item string, weight double")
    got = {r["item"]: r["count"] for r in selection.weighted_draws(items, 4000, 1).groupBy("item").count().collect()}
    assert sum(got.values()) == 4000 and set(got) == {"a", "b"} and 2850 < got["a"] < 3150


@pytest.mark.parametrize("keys", ["k", "nullif(k, 7)"])
def test_draws_equal_their_sql_on_halves_and_a_null_key(spark, tmp_path, keys):
    source = f"SELECT {keys} AS s_suppkey, k - 2 + 0.5::DOUBLE AS s_acctbal FROM range(40) t(k)"
    duckdb.sql(f"COPY ({source}) TO '{tmp_path}/supplier.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = {tuple(r) for r in con.sql(catalog.oracle_sql()["weighted_draws"]).fetchall()}
    got = {tuple(r) for r in catalog.queries()["weighted_draws"](spark, str(tmp_path)).collect()}
    assert got == want and sum(n for _, n in got) == 2000 and 2 not in dict(got)  # 0.5 counts as 0


def test_index_of_concatenated_sources(spark):
    offsets = selection.composite_offsets(spark.createDataFrame([("a", 0, 3), ("b", 1, 2)], "source string, pos int, n long"))
    got = selection.locate_index(spark.createDataFrame([(0,), (4,), (-1,), (5,), (-6,)], "index long"), offsets)
    assert {r["index"]: (r["source"], r["local"]) for r in got.collect()} == {0: ("a", 0), 4: ("b", 1), -1: ("b", 1)}


def test_active_sources(spark):
    configured = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    proportions = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, proportion double")
    names = lambda **k: sorted(r[0] for r in selection.active_sources(configured, proportions, **k).collect())
    assert names() == ["a"] and names(omitted_active=True) == ["a", "c"]


def test_batches_and_stems(spark):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "source string, k int")
    assert selection.homogeneous_batches(rows, "source", ["k"], 2, True).count() == 4
    stems = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "idx int, stem string")
    assert [r["unique_stem"] for r in selection.unique_stems(stems).orderBy("idx").collect()] == ["x", "x_2", "y"]
