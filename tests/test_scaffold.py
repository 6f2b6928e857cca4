"""Manifests from folders and rendered views, camera requests, and settings of submissions."""

import pytest
from pyspark.sql import functions as F

from maskframe.functions import config
from maskframe.operators import sampling
from maskframe.sources import package_sink, packages, scaffold


def paths(spark, folder, names):
    return spark.createDataFrame([(f"/{folder}/{n}",) for n in names], "path string")


def test_pairs_subjects_and_splits(spark, tmp_path):
    stems = [f"P{p:02d}_v{v}" for p in range(5) for v in range(2)]
    images, masks = paths(spark, "i", [*(f"{s}.PNG" for s in stems), "notes.txt", "alone.png"]), paths(spark, "m", [f"{s}.npy" for s in stems])
    got = scaffold.scaffold(images, masks, "xray-seg", {"train": 60, "val": 20, "test": 20}, r"^(P\d+)").collect()
    assert len(got) == 10 and {r["sample_id"] for r in got} == set(stems) and all(r["image"] == f"/i/{r['sample_id']}.PNG" and r["label"] == f"/m/{r['sample_id']}.npy" for r in got)
    by_subject = {}
    for r in got:
        by_subject.setdefault(r["subject_id"], set()).add(r["split"])
    assert len(by_subject) == 5 and all(len(s) == 1 for s in by_subject.values())
    assert sorted(sum(r["split"] == s for r in got) for s in ("train", "val", "test")) == [2, 2, 6]
    with pytest.raises(Exception, match="no subject in"):
        scaffold.scaffold(images, masks, "xray-seg", None, r"^(Q\d+)").collect()
    with pytest.raises(ValueError, match="none of"):
        scaffold.scaffold(images, masks, "mr")
    labels = scaffold.observed_labels(spark.createDataFrame([([0.0, 2.0],), ([0.0, 1.0, 1.0],)], "data array<double>"))
    assert sorted(map(tuple, labels.collect())) == [(0, "background"), (1, "label_1"), (2, "label_2")]
    with pytest.raises(Exception, match="not whole"):
        scaffold.observed_labels(spark.createDataFrame([([0.5],)], "data array<double>")).collect()
    samples = scaffold.scaffold(images, masks, "xray-seg")
    scaffold.write_manifest(samples, str(tmp_path / "m"), {"dataset_name": "D", "stored_labels": {"0": "background"}})
    assert scaffold.read_head(spark, str(tmp_path / "m"))["dataset_name"] == "D" and spark.read.json(str(tmp_path / "m" / "samples")).count() == 10


def test_requests_and_rendered_samples(spark, tmp_path):
    views = spark.createDataFrame([(s, v) for s in ("a", "b") for v in range(3)], "sample_id string, view_idx int")
    got = sampling.camera_requests(views, {"sdd": (900.0, 1000.0), "delx": (0.5, 0.7), "x0": 3.0}, [(-10, 10)] * 3, [(-5, 5), (600, 800), (-5, 5)], 4, 0.5)
    rows = got.collect()
    assert all(900 <= r["sdd"] <= 1000 and 0.5 <= r["delx"] < 0.7 and r["dely"] == r["delx"] and (r["x0"], r["y0"]) == (3, 0) and 600 <= r["xyz"][1] <= r["sdd"] for r in rows)
    assert len({r["delx"] for r in rows}) == 6 and all(len({r["orthographic"] for r in rows if r["sample_id"] == s}) == 1 for s in "ab")
    assert sorted(map(str, got.repartition(5).collect())) == sorted(map(str, rows))
    assert {r["orthographic"] for r in sampling.camera_requests(views, {"sdd": 1000, "delx": 1, "dely": 2}, [(0, 0)] * 3, [(0, 0)] * 3, 4).collect()} == {False}
    with pytest.raises(ValueError, match="delx"):
        sampling.camera_requests(views, {"sdd": 1}, [], [], 1)
    soft = F.when(F.col("view_idx") == 2, 0.25).otherwise(1.0)
    rendered = got.select("*", F.col("sample_id").alias("subject_id"), F.lit(7).alias("render_index"), F.col("view_idx").alias("view_index"), F.lit(1).alias("height"), F.lit(2).alias("width"), F.array(F.lit(0.5), F.lit(1.0)).alias("image"), F.array(F.array(F.lit(0.0), soft), F.array(F.lit(1.0), F.lit(0.0))).alias("mask"))
    samples = scaffold.rendered_samples(rendered, "D", ["background", "hip"])
    found = {r["sample_id"]: r for r in samples.collect()}
    assert sorted(found) == [f"{s}__r007_v{v:02d}" for s in "ab" for v in range(3)]
    assert {k[-1]: r["label"]["dtype"] for k, r in found.items()} == {"0": "uint8", "1": "uint8", "2": "float16"} and found["a__r007_v00"]["label"]["shape"] == [2, 1, 2]
    meta = found["a__r007_v01"]["metadata"]
    assert meta["source_sample_id"] == "a" and meta["view_index"] == "1" and meta["xyz"].startswith("[") and float(meta["sdd"]) > 0
    package_sink.write_payload_package(samples, str(tmp_path / "p"), "D", payloads=("image", "label"))
    assert packages.read_package(spark, str(tmp_path / "p")).count() == 6 and package_sink.payload_issues(spark, str(tmp_path / "p"), ("image", "label")).count() == 0


def test_datasets_and_profiles():
    assert config.dataset_modalities({"xray": {"A": {}}, "ct": {"B": None}, "mr": None}) == {"A": "xray", "B": "ct"}
    with pytest.raises(ValueError, match="'A' stands under 'xray' and 'ct'"):
        config.dataset_modalities({"xray": {"A": {}}, "ct": {"A": {}}})
    default = {"intrinsics_cfg": {"height": 256, "sdd": 1000}, "num_views": 2}
    profiles = config.camera_profiles({"A", "B"}, {"default": default, "datasets": {"A": None, "B": {"intrinsics_cfg": {"sdd": 900}}}})
    assert profiles["A"] == default and profiles["B"]["intrinsics_cfg"] == {"height": 256, "sdd": 900} and config.camera_profiles({"A"}, None) is None
    for datasets, match in (({"A": {}}, "miss"), ({"A": {}, "B": {}, "C": {}}, "not configured"), ({"A": {}, "B": {"intrinsics_cfg": {"width": 128}}}, "height and width"), ({"A": {}, "B": {"num_views": 3}}, "num_views")):
        with pytest.raises(ValueError, match=match):
            config.camera_profiles({"A", "B"}, {"default": default, "datasets": datasets})
    with pytest.raises(ValueError, match="intrinsics_cfg.height"):
        config.camera_profiles({"A"}, {"default": {}, "datasets": {"A": {}}})


def test_submissions():
    base = {"experiment": {"seed": 40}, "lr": 1, "opt": {"a": 1, "b": 2}, "data": {"xray": {"A": {}, "B": {}}}, "dataloader": {"proportions": {"A": 1, "B": 0}}}
    run = lambda experiment, cluster=None, **k: config.submissions([base], experiment, cluster or {}, "/runs/g", **k)
    one = run({"group": "g", "lr": 2})
    assert len(one) == 1 and one[0]["lr"] == 2 and one[0]["log"]["root"] == "/runs/g" and one[0]["data"] == {"xray": {"A": {}}}
    swept = run({"sweep": {"lr": [1, 2], "opt": {"a": [5, 6]}}}, {"opt": {"b": 9}})
    assert [(c["lr"], c["opt"]) for c in swept] == [(lr, {"a": a, "b": 9}) for lr in (1, 2) for a in (5, 6)]
    assert [c["experiment"]["seed"] for c in run({"experiment": {"seed_range": 3}})] == [40, 41, 42]
    assert [c["experiment"]["seed"] for c in run({"experiment": {"seed_range": 3}}, explicit={"experiment.seed": 7})] == [7]
    assert [c["lr"] for c in run({"sweep": {"lr": [1, 2]}}, {"lr": 3}, explicit={"lr": 8})] == [8]
    assert [c["lr"] for c in run({"lr": 5}, sweep={"lr": [6, 7]})] == [6, 7] and run({"log": {"root": "/own"}})[0]["log"]["root"] == "/own"
    with pytest.raises(ValueError, match="missing"):
        run({"lr": "?"})
    assert run({"lr": "?"}, validate=False)[0]["lr"] == "?"
    with pytest.raises(ValueError, match="positive"):
        run({"experiment": {"seed_range": 0}})
