"""Packages with payloads: what changes, breaks or is lost on the way leaves nothing behind."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskframe.sources import package_sink, packages

SAMPLE = "sample_id string, subject_id string, split string, label_names array<string>, image struct<dtype:string,shape:array<int>,data:array<double>>"


def sample(name, split="train", value=0.5, dtype="float32", shape=(1, 2, 2)):
    return (name, name, split, ["hip"], (dtype, list(shape), [value] * int(np.prod(shape))))


def frame(spark, *rows):
    return spark.createDataFrame(rows, SAMPLE)


def left(folder):
    return sorted(p.name for p in folder.iterdir())


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [sample(f"s{k}", "val" if k % 3 == 0 else "train", k / 50) for k in range(40)]
    package_sink.write_payload_package(frame(spark, *rows).repartition(5), path, "D")
    stored = packages.read_package(spark, path).collect()
    assert {r["sample_id"]: (r["split"], list(r["image"]["data"])) for r in stored} == {r[0]: (r[2], r[4][2]) for r in rows}
    assert left(tmp_path) == ["p"] and packages.package_issues(spark, path).count() == 0 and package_sink.payload_issues(spark, path).count() == 0
    assert packages.read_attributes(spark, path).first()["n_samples"] == 40
    with pytest.raises(FileExistsError):
        package_sink.write_payload_package(frame(spark, rows[0]), path, "D")
    package_sink.write_payload_package(frame(spark, rows[0]), path, "D", overwrite=True)
    assert packages.read_package(spark, path).count() == 1
    # a payload that is changed in place is found when the package is read
    file = next((tmp_path / "p" / "samples").rglob("*.parquet"))
    stored = pd.read_parquet(file)
    stored["image"] = [{"dtype": "float32", "shape": [1, 2, 2], "data": [0.1, 0.0, 0.0, 0.0]}]
    stored.to_parquet(file)
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert [tuple(r) for r in package_sink.payload_issues(spark, path).collect()] == [("s0", "payload image differs from its checksum")]


def test_payload_that_changes_between_check_and_write(spark, tmp_path):
    """The source is read anew by the writing pass: a file that changed meanwhile must not get in."""
    source = tmp_path / "source.json"
    source.write_text(json.dumps({"v": 0.25}))
    passes = []

    def changing(batches):
        for batch in batches:
            value = json.loads(source.read_text())["v"]
            source.write_text(json.dumps({"v": value + 0.5}))
            passes.append(value)
            yield batch.assign(image=[{"dtype": "float32", "shape": [1], "data": [value]}] * len(batch))

    ids = spark.createDataFrame([("a", "a", "train", ["hip"])], "sample_id string, subject_id string, split string, label_names array<string>").coalesce(1)
    samples = ids.mapInPandas(changing, SAMPLE)
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="payload image of sample a is not what was checked"):
        package_sink.write_payload_package(samples, str(tmp_path / "out" / "p"), "D")
    assert left(tmp_path / "out") == []


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([sample("a"), sample("b", shape=(1, 3, 2))], "several types or shapes"), ([sample("a"), sample("b", dtype="float64")], "several types or shapes"),
        ([sample("a"), sample("a", "val")], "stands twice"), ([sample("a"), ("b", "a", *sample("b", "val")[2:])], "several splits"),
    ],
)
def test_refused_packages_leave_nothing(spark, tmp_path, rows, message):
    with pytest.raises(Exception, match=message):
        package_sink.write_payload_package(frame(spark, *rows).repartition(2), str(tmp_path / "p"), "D")
    assert left(tmp_path) == []


def test_failing_task_leaves_nothing_and_the_old_package_stays(spark, tmp_path):
    path = str(tmp_path / "p")
    package_sink.write_payload_package(frame(spark, sample("old")), path, "D")
    rows = frame(spark, *(sample(f"s{k}") for k in range(30))).repartition(3)
    broken = rows.withColumn("split", F.when((F.col("sample_id") == "s29"), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("split")))
    with pytest.raises(Exception, match="lost"):
        package_sink.write_payload_package(broken, path, "D", overwrite=True)
    assert left(tmp_path) == ["p"] and [r[0] for r in packages.read_package(spark, path).select("sample_id").collect()] == ["old"]


def batch(*rows):
    names = ["sample_id", "split", "image", "image_checksum"]
    sums = [package_sink.checksum_of(r[4][0], r[4][1], r[4][2]) for r in rows]
    image = pa.array([{"dtype": r[4][0], "shape": r[4][1], "data": r[4][2]} for r in rows], pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64()))]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), image, pa.array(sums)], names=names)


def test_reconciliation(tmp_path):
    """Reports against the plan and the files, without Spark: an attempt that was lost, a part that changed, a task too few."""
    writer = lambda rows: package_sink.PackageWriter({"path": str(tmp_path / "w"), "rows": str(rows), "payloads": '["image"]', "uniform": '["image"]'})
    first = writer(3).write(iter([batch(sample("a"), sample("b", "val"))]))
    lost = writer(3).write(iter([batch(sample("c"))]))
    second = writer(3).write(iter([batch(sample("c"))]))
    files = lambda: sorted(str(p) for p in (tmp_path / "w").rglob("*.parquet"))
    assert len(files()) == 4 and [p[1] for p in first.parts] == [1, 1]
    with pytest.raises(ValueError, match="2 samples written of 3"):
        writer(3).commit([first, None])
    writer(3).commit([first, second, None])
    assert files() == sorted(p[0] for m in (first, second) for p in m.parts) and lost.parts[0][0] not in files()
    with open(second.parts[0][0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="not as it was written"):
        writer(3).commit([first, second])
    writer(3).abort([first])
    assert not (tmp_path / "w").exists()
    writer(3).abort([])
