"""Volumes (.nii, .nii.gz, .npy) as slices, of which only the wanted ones are read.

``read_volumes`` lists the slices of all volumes from their headers, one row each.  Filters on this
index are Spark's own, and ``with_voxels`` then reads the bytes of the slices that are left.  (The
filters that Spark 4.1 pushes into a Python source are shared by all scans of one DataFrame, so that
two differently filtered uses of it, in a union for instance, give wrong rows: none is pushed here.)

A slice lies along the outermost stored axis: the third of a NIfTI file, the first of a .npy file in
row order, the last of one in column order.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from maskframe.sources.files import file_system, list_files
from maskframe.sources.payloads import nifti_header

SUFFIXES = (".nii", ".nii.gz", ".npy")
INDEX = "path string, slice int, n_slices int, shape array<int>, source_dtype string, affine array<double>, spacing array<double>"
#: Files whose headers one task reads.
HEADERS = 64


class Volume(NamedTuple):
    """Where the slices of a file lie: each has ``stride`` bytes, the first starts at ``offset``."""

    shape: tuple[int, ...]
    axis: int
    dtype: np.dtype
    offset: int
    slope: float
    intercept: float
    affine: np.ndarray | None
    spacing: np.ndarray | None
    columns_first: bool

    @property
    def n_slices(self) -> int:
        return self.shape[self.axis]

    @property
    def slice_shape(self) -> tuple[int, ...]:
        return self.shape[: self.axis] + self.shape[self.axis + 1 :]

    @property
    def stride(self) -> int:
        return int(np.prod(self.slice_shape)) * self.dtype.itemsize


def volume_of(path: str, file: BinaryIO) -> Volume:
    """The header of a file; at most a few hundred bytes are read."""
    if path.lower().endswith(".npy"):
        version = np.lib.format.read_magic(file)
        shape, columns_first, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        if dtype.hasobject:
            raise ValueError("object arrays are refused")
        if len(shape) != 3:
            raise ValueError(f"shape {shape} has no three axes")
        return Volume(shape, 2 if columns_first else 0, dtype, file.tell(), 1.0, 0.0, None, None, columns_first)
    h = nifti_header(file.read(352))
    return Volume(h["shape"], 2, h["dtype"], h["offset"], h["slope"], h["intercept"], h["affine"], h["spacing"], True)


def open_volume(path: str) -> BinaryIO:
    """A file to read from; of a gzipped one only what lies before the last slice wanted is unpacked."""
    system, inside = file_system(path)
    raw = system.open_input_file(inside)
    return gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else raw


def read_slice(volume: Volume, file: BinaryIO, place: int) -> np.ndarray:
    """One slice; files are read forwards, so a gzipped one is unpacked once for slices in order."""
    if not 0 <= place < volume.n_slices:
        raise ValueError(f"slice {place} of {volume.n_slices}")
    file.seek(volume.offset + place * volume.stride)
    raw = file.read(volume.stride)
    if len(raw) < volume.stride:
        raise ValueError(f"slice {place} is cut off")
    data = np.frombuffer(raw, volume.dtype).reshape(volume.slice_shape, order="F" if volume.columns_first else "C")
    return data.astype(float) * volume.slope + volume.intercept


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class VolumeReader(DataSourceReader):
    """Headers of volumes; each task reads those of some files."""

    def __init__(self, options: dict[str, str]):
        self.path, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"

    def partitions(self) -> Sequence[Files]:
        found = list_files(self.path, SUFFIXES, self.recursive)
        return [Files(found[k : k + HEADERS]) for k in range(0, len(found), HEADERS)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition else ():  # no partitions: Spark reads one without a value
            with open_volume(path) as f:
                v = volume_of(path, f)
            n = v.n_slices
            fixed = [[list(v.slice_shape)] * n, [str(v.dtype.newbyteorder("="))] * n, [None if v.affine is None else v.affine.ravel()] * n, [v.spacing] * n]
            kinds = [pa.list_(pa.int32()), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = [pa.array([path] * n), pa.array(np.arange(n), pa.int32()), pa.array([n] * n, pa.int32()), *(pa.array(x, kind) for x, kind in zip(fixed, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


class VolumeSource(DataSource):
    """Options: path, recursive."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(dict(self.options))


def read_volumes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The slices of the volumes under a path, by their headers: path, slice, n_slices, shape (of a slice), source_dtype, affine, spacing.

    A damaged header fails the query; ``payloads.read_arrays`` gives rows with errors instead.
    """
    spark.dataSource.register(VolumeSource)
    return spark.read.format("volumes").option("recursive", recursive).load(path)


def with_voxels(slices: DataFrame, slab: int = 16) -> DataFrame:
    """``slices`` (path, slice and any other columns) with ``data``, row-major over a slice and rescaled as its file says.

    Slices of one file that lie within ``slab`` places go to one task, which opens the file once and
    reads them in order; nothing else of it is read, but for what lies before them in a gzipped file.
    """
    near = F.floor(F.col("slice") / slab)
    schema = T.StructType([*slices.schema.fields, T.StructField("data", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, volume = None, None, None
        for batch in batches:
            for k, (path, place) in enumerate(zip(batch.column("path").to_pylist(), batch.column("slice").to_pylist())):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, open_volume(path)
                    volume = volume_of(path, file)
                data = read_slice(volume, file, place)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([data.ravel()], pa.list_(pa.float64()))], names=[*batch.schema.names, "data"])
        if file is not None:
            file.close()

    return slices.repartition("path", near).sortWithinPartitions("path", "slice").mapInArrow(run, schema)
