"""A sink for packages with payloads: tasks check and write parts, the driver reconciles what they report.

A payload is a struct (dtype, shape, data).  A first pass over the samples stores the checksum of
every payload; the writing pass reads the payloads again, and each task compares them with the
stored checksums before it writes.  A task reports its parts, their rows and sizes, and the kinds
of payloads it saw; the driver compares these with the plan and with the files before the package
is moved in.  Whatever fails, nothing is left beside the target.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from maskframe.sources import packages
from maskframe.sources.files import file_system

PAYLOAD = T.StructType([T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType()))])
#: Different kinds (dtype, shape) of one payload that a task reports; more are one too many anyway.
KINDS = 8


def checksum_of(dtype: str, shape: np.ndarray, data: np.ndarray) -> str:
    """SHA-256 of a payload's type, shape and values; equal values have one sum, whatever they are stored as."""
    head = json.dumps([str(dtype), [int(n) for n in shape]])
    return hashlib.sha256(head.encode() + b"\0" + np.ascontiguousarray(data, "<f8").tobytes()).hexdigest()


@F.pandas_udf(T.StringType())
def _checksums(payloads: pd.DataFrame) -> pd.Series:
    rows = zip(payloads["dtype"], payloads["shape"], payloads["data"])
    return pd.Series([None if d is None or s is None else checksum_of(t, s, d) for t, s, d in rows], dtype=object)


def payload_checksum(payload: str) -> Column:
    """Checksum of a payload column; null for a null payload."""
    return _checksums(F.struct(*(F.col(f"{payload}.{f.name}").cast(f.dataType).alias(f.name) for f in PAYLOAD.fields)))


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: (file, rows, bytes) each, and the kinds of each payload."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)
    kinds: dict[str, list[tuple[str, tuple[int, ...]]]] = field(default_factory=dict)


class PackageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options["rows"])
        self.payloads, self.uniform = json.loads(options["payloads"]), json.loads(options["uniform"])

    def _planned(self, batch: pa.RecordBatch, found: Parts) -> None:
        ids = batch.column("sample_id").to_pylist()
        for name in self.payloads:
            column, planned = batch.column(name), batch.column(f"{name}_checksum").to_pylist()
            types, shapes, values = (column.field(k) for k in range(3))
            for k, want in enumerate(planned):
                present = column[k].is_valid and values[k].is_valid and shapes[k].is_valid
                got = checksum_of(types[k].as_py(), shapes[k].as_py(), values[k].values.to_numpy(zero_copy_only=False)) if present else None
                if got != want:
                    raise ValueError(f"payload {name} of sample {ids[k]} is not what was checked")
                if present:
                    kind = (types[k].as_py(), tuple(shapes[k].as_py()))
                    kinds = found.kinds.setdefault(name, [])
                    if kind not in kinds and len(kinds) < KINDS:
                        kinds.append(kind)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        system, inside = file_system(self.path)
        found, open_, name = Parts(), {}, uuid.uuid4().hex
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                self._planned(batch, found)
                splits = batch.column("split")
                rest = batch.drop_columns(["split"])
                for split in splits.unique().to_pylist():
                    if split not in open_:
                        folder = f"{inside}/samples/split={split}"
                        system.create_dir(folder, recursive=True)
                        file = f"{folder}/part-{name}.parquet"
                        sink = system.open_output_stream(file)
                        open_[split] = [file, 0, sink, pq.ParquetWriter(sink, rest.schema)]
                    rows = rest.filter(pa.array([s == split for s in splits.to_pylist()]))
                    open_[split][1] += rows.num_rows
                    open_[split][3].write_batch(rows)
        finally:
            for *_, sink, writer in open_.values():
                writer.close()
                sink.close()
        found.parts = [(file, rows, system.get_file_info(file).size) for file, rows, *_ in open_.values()]
        return found

    def commit(self, messages: list[Parts | None]) -> None:
        """Compare the tasks' reports with the plan and the files, and remove files that no report names."""
        system, inside = file_system(self.path)
        reports = [m for m in messages if m is not None]
        parts = {file: (rows, size) for m in reports for file, rows, size in m.parts}
        if sum(rows for rows, _ in parts.values()) != self.rows:
            raise ValueError(f"{sum(rows for rows, _ in parts.values())} samples written of {self.rows}")
        for name in self.uniform:
            kinds = {(dtype, tuple(shape)) for m in reports for dtype, shape in m.kinds.get(name, ())}
            if len(kinds) > 1:
                raise ValueError(f"payload {name} has several types or shapes: {sorted(kinds)[:4]}")
        for file, (_, size) in parts.items():
            if system.get_file_info(file).size != size:
                raise ValueError(f"{file} is not as it was written")
        selector = fs.FileSelector(f"{inside}/samples", allow_not_found=True, recursive=True)
        for info in system.get_file_info(selector):
            if info.type == fs.FileType.File and info.path not in parts:
                system.delete_file(info.path)  # of an attempt that was lost

    def abort(self, messages: list[Parts | None]) -> None:
        system, inside = file_system(self.path)
        if system.get_file_info(inside).type != fs.FileType.NotFound:
            system.delete_dir(inside)


class PackageSink(DataSource):
    """Options: path, rows (planned), payloads and uniform (JSON lists of payload columns)."""

    @classmethod
    def name(cls) -> str:
        return "package"

    def writer(self, schema: T.StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(dict(self.options))


def write_payload_package(
    samples: DataFrame, path: str, dataset_name: str, dataset_type: str = "xray", payloads: tuple[str, ...] = ("image",), uniform: tuple[str, ...] = ("image",), overwrite: bool = False
) -> None:
    """Check, write and move in a package of samples (sample_id, subject_id, split, label_names, payloads, ...).

    ``samples`` is worked out twice, so its source must give the same payloads both times: one that
    changed meanwhile fails the write.  Payloads named in ``uniform`` must have one type and shape
    over all samples.  sample_ids must differ.  An existing package is replaced only with
    ``overwrite``, and only once the new one is whole.
    """
    spark = samples.sparkSession
    packages.check_target(spark, path, overwrite)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        sums = {f"{p}_checksum": payload_checksum(p) for p in payloads}
        samples.select("sample_id", *(c.alias(n) for n, c in sums.items())).write.parquet(f"{beside}.plan")
        plan = spark.read.parquet(f"{beside}.plan")
        again = plan.groupBy("sample_id").count().where("count > 1").limit(5).collect()
        if again:
            raise ValueError(f"sample_id stands twice: {', '.join(str(r[0]) for r in again)}")
        spark.dataSource.register(PackageSink)
        typed = samples.withColumns({p: F.when(F.col(p).isNotNull(), F.struct(*(F.col(f"{p}.{f.name}").cast(f.dataType).alias(f.name) for f in PAYLOAD.fields))) for p in payloads})
        typed.join(plan, "sample_id", "left").write.format("package").mode("append").option("rows", plan.count()).option("payloads", json.dumps(payloads)).option("uniform", json.dumps(uniform)).save(beside)
        packages.move_in(spark, beside, path, dataset_name, dataset_type)
    except BaseException:
        packages.remove(spark, beside)
        raise
    finally:
        packages.remove(spark, f"{beside}.plan")


def payload_issues(spark: SparkSession, path: str, payloads: tuple[str, ...] = ("image",)) -> DataFrame:
    """key, issue: payloads of a stored package that are not those that were checked and written."""
    samples = packages.read_package(spark, path)
    out = [samples.where(~payload_checksum(p).eqNullSafe(F.col(f"{p}_checksum"))).select(F.col("sample_id").alias("key"), F.lit(f"payload {p} differs from its checksum").alias("issue")) for p in payloads]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
