"""Manifests, array files and packages."""

import gzip
import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import config
from maskframe.sources import packages, payloads, records


def nifti(data, affine):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 2, 3, 4, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 0, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype("<i2").tobytes(order="F")


def test_array_files(spark, tmp_path):
    volume, affine = np.arange(24).reshape(2, 3, 4), np.array([[2.0, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]])
    (tmp_path / "v.nii.gz").write_bytes(gzip.compress(nifti(volume, affine)))
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, 4]], np.uint8))
    np.savez(tmp_path / "b.npz", x=np.ones(3, np.float32), y=np.zeros((1, 2)))
    np.save(tmp_path / "bad.npy", np.array([{}], object))
    (tmp_path / "n.txt").write_text("x")
    got = {(r["path"].rsplit("/", 1)[1], r["field"]): r for r in payloads.read_arrays(spark, str(tmp_path)).collect()}
    assert got["v.nii.gz", ""]["data"] == volume.astype(float).ravel().tolist() and got["v.nii.gz", ""]["affine"] == affine.ravel().tolist() and got["v.nii.gz", ""]["spacing"] == [2, 3, 4]
    assert (got["a.npy", ""]["source_dtype"], got["a.npy", ""]["shape"], got["a.npy", ""]["data"]) == ("uint8", [2, 2], [1, 2, 3, 4])
    assert got["b.npz", "x"]["shape"] == [3] and got["b.npz", "y"]["shape"] == [1, 2]
    assert got["bad.npy", None]["error"] and got["n.txt", None]["error"]


def test_image_listing(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "d").write_bytes(bytes(128) + b"DICM" + bytes(8))
    (tmp_path / "e").write_bytes(bytes(140))
    (tmp_path / "t.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["is_dicom"] for r in payloads.list_images(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": False, "d": True}
    df = spark.createDataFrame([([0.0, 1.0, 3.0], None, None, "MONOCHROME1")], "d array<double>, s double, i double, p string")
    assert df.select(payloads.rescale_dicom("d", "s", "i", "p")).first()[0] == pytest.approx([1, 2 / 3, 0])


def test_manifest(spark, tmp_path):
    body = {"dataset_name": "D", "modality": "xray", "records": [{"data_id": " a ", "image": "x/a.png", "label": "/abs/a.png", "subject_id": "", "metadata": {"labels": "hip, femur"}}, {"dataset_name": "E", "data_id": "b", "image": "b.png", "split": "val"}]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    got = records.normalise_records(records.read_manifest(spark, str(tmp_path / "m.json"), "/root/")).orderBy("pos").collect()
    assert [(r["dataset_name"], r["data_id"], r["image"], r["label"], r["subject_id"], r["label_names"]) for r in got] == [("D", "a", "/root/x/a.png", "/abs/a.png", None, ["hip", "femur"]), ("E", "b", "/root/b.png", None, None, None)]


def test_payload_checks(spark):
    df = spark.createDataFrame([("float32", [1, 1, 2], [0.0, 1.0]), ("float64", [1, 1, 2], [0.0]), ("float32", [1, 2], [0.0]), ("float32", [1, 1, 1], [2.0]), ("float32", [1, 1, 1], [float("nan")])], "source_dtype string, shape array<int>, data array<double>")
    assert [r[0] is None for r in df.select(records.image_issue()).collect()] == [True, False, False, False, False]
    stored = spark.createDataFrame([({0: "background", 1: "hip"},), ({1: "hip"},), ({0: "x"},), ({0: "background", 1: "background"},)], "stored_labels map<int,string>")
    assert [r[0] is None for r in stored.select(records.stored_label_issue()).collect()] == [True, False, False, False]
    dense = spark.createDataFrame([([0.0, 1.0], {0: "background", 1: "a"}), ([2.0], {0: "background"}), ([-1.0], {0: "background"})], "data array<double>, stored_labels map<int,string>")
    assert [r[0] is None for r in dense.select(records.dense_label_issue()).collect()] == [True, False, False]
    eye = np.eye(4).ravel().tolist()
    volumes = spark.createDataFrame([([1, 2, 2, 1], [2, 2, 1], [0.0, 1.0], eye, [1.0] * 3), ([2, 2, 1], [2, 2, 1], [0.0], eye, [1.0] * 3), ([2, 2, 1], [2, 2, 1], [1.0], [0.0] * 16, [1.0] * 3), ([2, 2, 1], [2, 2, 1], [1.0], eye, [1.0, 0.0, 1.0])], "s array<int>, ls array<int>, l array<double>, a array<double>, sp array<double>")
    assert [r[0] is None for r in volumes.select(records.volume_issue("s", "ls", "l", "a", "sp")).collect()] == [True, False, False, False]


SAMPLE = "sample_id string, subject_id string, split string, dataset_name string, modality string, image string, label_names array<string>"


def samples(spark, *rows):
    return spark.createDataFrame([(i, s, split, "D", "xray", "x", ["hip"]) for i, s, split in rows], SAMPLE)


def test_packages(spark, tmp_path):
    path = str(tmp_path / "p")
    good = samples(spark, ("a", "s1", "train"), ("b", "s1", "train"), ("c", None, "val"))
    packages.write_package(good, path, "D")
    assert {r["split"]: (r["n_samples"], r["n_subjects"]) for r in packages.inspect_package(spark, path).collect()} == {"train": (2, 1), "val": (1, 1)}
    assert packages.read_package(spark, path, "val").count() == 1 and packages.read_attributes(spark, path).first()["n_subjects"] == 2
    with pytest.raises(FileExistsError):
        packages.write_package(good, path, "D")
    with pytest.raises(ValueError, match="several splits"):
        packages.write_package(samples(spark, ("a", "s1", "train"), ("b", "s1", "val")), path, "D", overwrite=True)
    packages.write_package(good.where("sample_id = 'a'"), path, "D", overwrite=True)
    assert packages.read_package(spark, path).count() == 1 and packages.package_issues(spark, path).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p"]
    assert [r[0] for r in records.missing_splits(good, ["train", "test"]).collect()] == ["test"]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("s", "masks", [1, 1], [1.0])], "stem string, kind string, shape array<int>, data array<double>")
    path = str(tmp_path / "out")
    packages.write_artifacts(rows, path, ["hip"])
    packages.write_artifacts(rows.withColumn("stem", F.lit("t")), path, ["hip"])
    assert spark.read.parquet(f"{path}/arrays").count() == 2
    with pytest.raises(ValueError):
        packages.write_artifacts(rows, path, ["femur"])


def test_object_arrays_are_refused():
    out = io.BytesIO()
    np.save(out, np.array([None], object))
    with pytest.raises(ValueError):
        payloads.decode_npy(out.getvalue())


def test_package_attributes(spark):
    def one(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if k == 'names' else 'array<int>' if k == 'ids' else 'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items()))
        return row.select(column).first()[0]

    identity = records.identity_issue("a", F.lit("D"))
    assert [one(identity, a=a) for a in ({"dataset_name": "D"}, {"dataset": "D", "clean_dataset": "true"}, {"dataset_name": None, "dataset": "D"}, {}, {"dataset": "D", "clean_dataset": None})] == [None, None, "another dataset", "another dataset", "not a clean dataset"]
    kind = lambda modality: records.modality_issue("a", F.lit(modality), "training")
    stored = {"schema_name": "training", "modality": "ct", "dataset_type": "ct-seg"}
    assert [one(kind("ct"), a=stored), one(kind("xray"), a=stored), one(kind("mr"), a=stored), one(kind("mr"), a={})] == [None, "another modality or type", "modality unknown", None]
    assert [one(records.label_storage_issue("a"), a=a) for a in ({}, {"seg_storage": "indexed_label_mask"}, {"seg_storage": "x"})] == [None, None, "unknown label storage"]
    mask = records.mask_label_issue("names", "ids")
    assert [one(mask, names=["a", "b"], ids=i) for i in (None, [0, 1], [1, 0], [0], [0, None])] == [None, None] + ["mask ids are not 0, 1, 2, ..."] * 3
    key = lambda k, a: one(records.payload_key("label", ["k"], "a", ("seg",), "mask"), k=k, a=a)
    assert [key({"seg": "s", "label_field": "f"}, {}), key({"seg": "s"}, {"label_key": "t"}), key({}, {"label": "bare", "seg_field": "t"}), key({}, {"label": "bare"})] == ["f", "s", "t", "mask"]
    subject = lambda m, how="subject": one(records.subject_of(F.lit("key"), "m", how), m=m)
    assert [subject({"subject": "p", "subject_key": "q"}), subject({"subject_id": " r "}), subject({}), subject({"subject": "p"}, "sample")] == ["p", "r", "key", "key"]


def test_settings_files():
    assert config.load_unique('{"a": {"b": 1}, "c": {"b": 2}}') == {"a": {"b": 1}, "c": {"b": 2}}
    with pytest.raises(ValueError, match="twice"):
        config.load_unique('{"a": {"b": 1, "b": 2}}')
    assert config.parse_overrides(["a.b=1", "c=x=y", "d=[1, true]", "e=", "a.b=2", "lr=1e-3", "k=yes", "f=[a, b]", "g={h: 1.5}"]) == {"a.b": 2, "c": "x=y", "d": [1, True], "e": None, "lr": "1e-3", "k": True, "f": ["a", "b"], "g": {"h": 1.5}}
    for bad in ("a", "=1"):
        with pytest.raises(ValueError, match="KEY=VALUE"):
            config.parse_overrides([bad])
    files = {"x": {"_base_": "y", "a": {"b": 1}}, "y": {"_base_": ["z"], "a": {"b": 0, "c": 2}}, "z": {"d": 3}, "p": {"_base_": "q"}, "q": {"_base_": "p"}}
    assert config.inherit("x", files.get) == {"a": {"b": 1, "c": 2}, "d": 3}
    with pytest.raises(ValueError, match="p -> q -> p"):
        config.inherit("p", files.get)
    assert config.threshold(0.5) == 0.5
    for bad in (-0.1, 1.1, float("nan"), True, "1"):
        with pytest.raises(ValueError):
            config.threshold(bad)
