"""Slices of volumes: filters reach the reader, and only the bytes of wanted slices are read."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.sources import volumes

AFFINE = np.array([[2.0, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]])


def nifti(data, slope=0.0, inter=0.0, order="<"):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into(order + "h", head, 70, 4)
    struct.pack_into(order + "8f", head, 76, 1, 2, 3, 4, 0, 0, 0, 0)
    struct.pack_into(order + "3f", head, 108, 352, slope, inter)
    struct.pack_into(order + "2h", head, 252, 0, 1)
    struct.pack_into(order + "12f", head, 280, *AFFINE[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype(order + "i2").tobytes(order="F")


VOLUME = np.arange(5 * 4 * 9).reshape(5, 4, 9)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.nii").write_bytes(nifti(VOLUME, 2.0, -1.0))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti(VOLUME, order=">")))
    np.save(tmp_path / "c.npy", VOLUME.astype("f4"))
    np.save(tmp_path / "d.npy", np.asfortranarray(VOLUME))
    (tmp_path / "n.txt").write_text("no volume")
    return str(tmp_path)


def want(name, k):
    return {"a.nii": VOLUME[:, :, k] * 2.0 - 1, "b.nii.gz": VOLUME[:, :, k], "c.npy": VOLUME[k % 5], "d.npy": VOLUME[:, :, k]}[name]


@pytest.mark.parametrize("slab", [1, 4, 100])
def test_all_slices(spark, folder, slab):
    rows = volumes.with_voxels(volumes.read_volumes(spark, folder), slab).collect()
    assert len(rows) == 9 * 3 + 5
    for r in rows:
        name = r["path"].rsplit("/", 1)[1]
        slice_ = want(name, r["slice"])
        assert r["data"] == slice_.ravel().tolist() and tuple(r["shape"]) == slice_.shape and r["n_slices"] == (5 if name == "c.npy" else 9)
        assert (r["affine"] == AFFINE.ravel().tolist() and r["spacing"] == [2, 3, 4]) if ".nii" in name else r["affine"] is None
    assert {r["source_dtype"] for r in rows} == {"int16", "float32", "int64"}


def test_filters_of_one_index(spark, folder):
    """Filters stand before the read in the plan, and differently filtered uses of one index do not mix."""
    index = volumes.read_volumes(spark, folder)
    third, rest = index.where("slice = 3"), index.where("slice > 6 AND path LIKE '%.nii'").withColumn("data", F.lit("clash")).drop("data")
    both = volumes.with_voxels(third).unionByName(volumes.with_voxels(rest))
    got = sorted((r["path"].rsplit("/", 1)[1], r["slice"], r["data"]) for r in both.collect())
    assert got == sorted((p, k, want(p, k).ravel().tolist()) for p, k in [*((p, 3) for p in ("a.nii", "b.nii.gz", "c.npy", "d.npy")), ("a.nii", 7), ("a.nii", 8)])
    assert index.count() == 32 and third.count() == 4 and volumes.with_voxels(index.where("slice < 0")).count() == 0
    plan = volumes.with_voxels(third)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("= 3)")


class Counted:
    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, n):
        out = self.file.read(n)
        self.bytes += len(out)
        return out

    def seek(self, at):
        self.file.seek(at)


def test_bytes_of_wanted_slices_only(spark, folder, tmp_path):
    with open(f"{folder}/a.nii", "rb") as f:
        counted = Counted(f)
        v = volumes.volume_of("a.nii", counted)
        assert (volumes.read_slice(v, counted, 8) == want("a.nii", 8)).all()
        assert counted.bytes == 352 + 5 * 4 * 2
        with pytest.raises(ValueError, match="slice 9 of 9"):
            volumes.read_slice(v, counted, 9)
    # the rest of the file is not even there
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.nii").write_bytes(nifti(VOLUME)[: 352 + 3 * 40])
    cut = volumes.read_volumes(spark, str(tmp_path / "cut"))
    assert cut.count() == 9 and volumes.with_voxels(cut.where("slice < 3")).count() == 3
    with pytest.raises(Exception, match="cut off"):
        volumes.with_voxels(cut.where("slice = 3")).collect()


def test_refused(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert volumes.read_volumes(spark, str(tmp_path / "none")).count() == 0
    np.save(tmp_path / "o.npy", np.array([[[None]]], object))
    with pytest.raises(Exception, match="object arrays"):
        volumes.read_volumes(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        volumes.read_volumes(spark, str(tmp_path / "missing")).collect()
