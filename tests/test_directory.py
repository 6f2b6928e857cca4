"""A directory job that is stopped, resumed and run again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.sources import payloads
from maskframe.streaming import directory


def save(folder, **arrays):
    folder.mkdir(exist_ok=True)
    for name, a in arrays.items():
        np.save(folder / f"{name}.npy", a)


def names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())


def test_only_new_files_are_taken(spark, tmp_path):
    source, output = tmp_path / "in", str(tmp_path / "out")
    save(source, a=np.zeros((1, 2)), b=np.ones(3))
    (source / "bad.npy").write_bytes(b"no array")
    worked = []

    def work(files):
        worked.extend(r[0].rsplit("/", 1)[1] for r in files.select("path").collect())
        return payloads.decoded_arrays(files)

    assert directory.run_directory(spark, str(source), output, work, {"threshold": "0.5"}, files_per_batch=2) == 2
    assert names(directory.results(spark, output)) == ["a.npy", "b.npy"] and names(directory.results(spark, output, failed=True)) == ["bad.npy"]
    assert directory.run_directory(spark, str(source), output, work, {"threshold": "0.5"}) == 0
    save(source, c=np.full(2, 7.0))
    assert directory.run_directory(spark, str(source), output, work, {"threshold": "0.5"}) == 1
    assert sorted(worked) == ["a.npy", "b.npy", "bad.npy", "c.npy"]
    assert names(directory.results(spark, output)) == ["a.npy", "b.npy", "c.npy"] and directory.results(spark, output, failed=True).first()["error"]
    assert directory.results(spark, output).where("path LIKE '%c.npy'").first()["data"] == [7, 7]
    with pytest.raises(ValueError, match="other settings"):
        directory.run_directory(spark, str(source), output, work, {"threshold": "0.6"})


def test_stopped_in_the_middle_of_a_batch(spark, tmp_path):
    """The batch is lost after its rows are written and before it counts as done: it is done again, over its own rows."""
    source, output = tmp_path / "in", str(tmp_path / "out")
    save(source, **{f"f{k}": np.full(2, float(k)) for k in range(6)})
    calls = []

    def work(files):
        calls.append(files.count())
        return payloads.decoded_arrays(files)

    def lost(files):
        out = work(files)
        if len(calls) == 2:
            out.withColumn("failed", F.lit(False)).write.mode("overwrite").partitionBy("failed").parquet(f"{output}/rows/batch=1")
            raise RuntimeError("executor lost")
        return out

    with pytest.raises(Exception, match="executor lost"):
        directory.run_directory(spark, str(source), output, lost, files_per_batch=2)
    assert directory.run_directory(spark, str(source), output, work, files_per_batch=2) == 2
    assert calls == [2, 2, 2, 2] and names(directory.results(spark, output)) == [f"f{k}.npy" for k in range(6)]


def test_output_that_is_not_a_jobs(spark, tmp_path):
    save(tmp_path / "in", a=np.ones(1))
    (tmp_path / "out").mkdir()
    with pytest.raises(ValueError, match="something else"):
        directory.run_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), payloads.decoded_arrays)
