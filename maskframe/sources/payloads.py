"""Array files (.npy, .npz, NIfTI, DICOM headers) as rows, decoded where Spark reads them."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.arrays import bind, bind_fields
from maskframe.functions.normalise import unit_range

#: NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".dcm", ".dicom")
_DECODED = "path string, field string, source_dtype string, shape array<int>, data array<double>, affine array<double>, spacing array<double>, error string"


def decode_npy(content: bytes) -> dict[str, np.ndarray]:
    """Arrays of a .npy ("" is its name) or .npz file; object arrays are refused."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    return {"": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}


def nifti_header(raw: bytes) -> dict[str, Any]:
    """shape (squeezed to three axes), dtype, offset, slope, intercept, affine (4 x 4) and spacing from the start of a NIfTI-1 file."""
    if len(raw) < 348:
        raise ValueError("not a NIfTI-1 file")
    order = "<" if int.from_bytes(raw[:4], "little") == 348 else ">"
    if int(np.frombuffer(raw, order + "i4", 1)[0]) != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = np.frombuffer(raw, order + "i2", 8, 40)
    code = int(np.frombuffer(raw, order + "i2", 1, 70)[0])
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {code}")
    pix = np.frombuffer(raw, order + "f4", 8, 76).astype(float)
    offset, slope, inter = np.frombuffer(raw, order + "f4", 3, 108)
    shape = tuple(int(n) for n in dim[1 : 1 + dim[0]])
    while len(shape) > 3 and shape[-1] == 1:
        shape = shape[:-1]
    if len(shape) != 3:
        raise ValueError(f"shape {shape} has no three axes")
    qform, sform = np.frombuffer(raw, order + "i2", 2, 252)
    if sform > 0:
        affine = np.vstack([np.frombuffer(raw, order + "f4", 12, 280).reshape(3, 4), [0, 0, 0, 1]]).astype(float)
    elif qform > 0:
        b, c, d, x, y, z = np.frombuffer(raw, order + "f4", 6, 256).astype(float)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.eye(4)
        affine[:3, :3] = r * (pix[1:4] * [1, 1, -1 if pix[0] < 0 else 1])
        affine[:3, 3] = x, y, z
    else:
        affine = np.diag([*pix[1:4], 1.0])
    return {"shape": shape, "dtype": np.dtype(order + NIFTI_TYPES[code]), "offset": int(offset), "slope": float(slope) or 1.0, "intercept": float(inter), "affine": affine, "spacing": pix[1:4]}


def decode_nifti(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Array squeezed to three axes, affine (4 x 4) and spacing of a NIfTI-1 file, gzipped or not."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    h = nifti_header(raw)
    data = np.frombuffer(raw, h["dtype"], int(np.prod(h["shape"])), h["offset"]).reshape(h["shape"], order="F")
    if h["slope"] != 1 or h["intercept"]:
        data = data.astype(float) * h["slope"] + h["intercept"]
    return data, h["affine"], h["spacing"]


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    low = path.lower()
    if low.endswith((".nii", ".nii.gz")):
        data, affine, spacing = decode_nifti(content)
        yield path, "", str(data.dtype.newbyteorder("=")), list(data.shape), data.astype(float).ravel(), affine.ravel(), spacing, None
    elif low.endswith((".npy", ".npz")):
        for field, data in decode_npy(content).items():
            yield path, field, str(data.dtype.newbyteorder("=")), list(data.shape), data.astype(float).ravel(), None, None, None
    else:
        raise ValueError("no decoder for this suffix")


def read_arrays(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row an array: path, field, source_dtype, shape, data (row-major), affine, spacing, error.

    Files that can't be decoded are rows with an error and no data.
    """
    return decoded_arrays(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path))


def decoded_arrays(files: DataFrame) -> DataFrame:
    """``read_arrays`` of files (path, content) that are rows already, of a stream for instance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DECODED.split(", ")]
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    found = list(_rows(p, content))
                except (ValueError, OSError, EOFError, IndexError) as e:
                    found = [(p, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(found, columns=names)

    return files.select("path", "content").mapInPandas(run, _DECODED)


def is_dicom(path: str = "path", content: str = "content") -> Column:
    """By suffix, or without one by the mark at byte 128."""
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    mark = F.hex(F.substring(content, 129, 4)) == "4449434D"
    return name.endswith(".dcm") | name.endswith(".dicom") | (~name.contains(".") & mark)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of one folder (not below), by suffix or DICOM mark: path, is_dicom, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path)
    dicom = is_dicom()
    named = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")
    return files.where(named | dicom).select("path", dicom.alias("is_dicom"), "length")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG, JPEG, BMP and GIF files as path, height, width and grey data in [0, 255], by Spark's image source."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    sized = image.select(F.col("origin").alias("path"), "height", "width", "nChannels", "data")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def grey(data: pd.Series, h: pd.Series, w: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for d, a, b, c in zip(data, h, w, n):
            x = np.frombuffer(d, np.uint8).reshape(a, b, c).astype(float)
            out.append((x[..., 0] if c == 1 else 0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]).ravel())
        return pd.Series(out)

    return sized.select("path", "height", "width", grey("data", "height", "width", "nChannels").alias("data"))


def rescale_dicom(data: str, slope: str, intercept: str, photometric: str) -> Column:
    """Stored values to [0, 1]: slope (0 or null: 1) and intercept, MONOCHROME1 turned over, min-max."""
    k = F.when(F.coalesce(F.col(slope), F.lit(0.0)) == 0, 1.0).otherwise(F.col(slope))
    values = F.transform(data, lambda x: x * k + F.coalesce(F.col(intercept), F.lit(0.0)))
    over = lambda v: bind_fields(lambda s: F.transform(s["v"], lambda x: s["top"] - x), v=v, top=F.array_max(v))
    return unit_range(bind(values, lambda v: F.when(F.col(photometric) == "MONOCHROME1", over(v)).otherwise(v)))
