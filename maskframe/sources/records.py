"""Sample records: manifests, their schema and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import yamltext
from maskframe.functions.arrays import ColumnLike, col, finite
from maskframe.operators.raster import determinant

RECORD = T.StructType([
    T.StructField("dataset_name", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("data_id", T.StringType()),
    T.StructField("image", T.StringType()), T.StructField("label", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("subject_id", T.StringType()), T.StructField("sample_id", T.StringType()), T.StructField("affine", T.ArrayType(T.DoubleType())),
    T.StructField("spacing", T.ArrayType(T.DoubleType())), T.StructField("label_names", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
MANIFEST = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("records", T.ArrayType(RECORD))])


def read_manifest(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Records of a manifest {dataset_name?, modality?, records: [...]}, or a bare list of records, with ``pos``.

    The file is YAML unless its name ends with .json.  Defaults of the manifest fill records
    without their own; relative payload paths start at ``root``.
    """
    if path.lower().endswith(".json"):
        one = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        one = yaml_documents(spark, path, MANIFEST, "records")
    rows = one.select("dataset_name", "modality", F.posexplode("records").alias("pos", "r"))
    resolved = lambda c: F.when(F.col(c).startswith("/") | F.lit(root == ""), F.col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(c))).alias(c)
    flat = rows.select(*(F.coalesce(f"r.{f.name}", f.name).alias(f.name) if f.name in ("dataset_name", "modality") else F.col(f"r.{f.name}").alias(f.name) for f in RECORD.fields), "pos")
    return flat.select(*(resolved(c) if c in ("image", "label") else F.col(c) for c in flat.columns))


def yaml_documents(spark: SparkSession, path: str, schema: T.StructType, listed: str | None = None) -> DataFrame:
    """The YAML files under a path as rows of a schema; one that can't be read raises, with its line.

    listed: the field that the entries of a file go to which is a list at its top.
    """
    texts = spark.read.text(path, wholetext=True).select(yamltext.to_json("value").alias("y"))
    body = F.when(F.col("y.error").isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: "), F.col("y.error"))).cast("string")).otherwise(F.col("y.json"))
    if listed is not None:
        body = F.when(F.col("y.json").startswith("["), F.concat(F.lit(f'{{"{listed}": '), body, F.lit("}"))).otherwise(body)
    return texts.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def normalise_records(records: DataFrame) -> DataFrame:
    """Strings trimmed, empty optional ones null, label names taken from the metadata where absent."""
    optional = ("label", "split", "subject_id", "sample_id")
    required = ("dataset_name", "modality", "data_id", "image")
    names = F.coalesce("label_names", F.split(F.coalesce(F.try_element_at("metadata", F.lit("label_names")), F.try_element_at("metadata", F.lit("labels"))), r"\s*,\s*"))
    return records.withColumns({c: F.trim(c) for c in required} | {c: F.nullif(F.trim(c), F.lit("")) for c in optional} | {"label_names": names})


def stored_label_issue(names: str = "stored_labels") -> Column:
    """What is wrong with a map of stored labels (id to name): ids 0, 1, 2, ..., 0 is background, names differ; null if nothing."""
    m = F.col(names)
    ids = F.array_sort(F.map_keys(m))
    return (
        F.when(F.size(m) == 0, "no stored labels").when(ids != F.sequence(F.lit(0), F.size(m) - 1), "ids are not 0, 1, 2, ...")
        .when(F.try_element_at(m, F.lit(0)) != "background", "id 0 is not background").when(F.size(F.array_distinct(F.map_values(m))) != F.size(m), "a name stands twice")
    )


# Attributes of an opened package: a map of strings, lists and maps as their own columns.

#: The type of a package of each modality, and the kinds of stored labels.
PACKAGE_TYPES = {"ct": "ct-seg", "xray": "xray-seg"}
LABEL_STORAGE = ("indexed_label_mask", "overlapping_channel_mask")


def _attribute(attrs: ColumnLike, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(col(attrs), F.lit(n)) for n in names))


def identity_issue(attrs: ColumnLike, requested: ColumnLike) -> Column:
    """dataset_name, or where that key is absent dataset, must be the requested name; clean_dataset must be true if set. Null if nothing is wrong."""
    a = col(attrs)
    name = F.when(F.map_contains_key(a, "dataset_name"), _attribute(a, "dataset_name")).otherwise(_attribute(a, "dataset"))
    unclean = F.map_contains_key(a, "clean_dataset") & ~_attribute(a, "clean_dataset").eqNullSafe(F.lit("true"))
    return F.when(~name.eqNullSafe(col(requested)), "another dataset").when(unclean, "not a clean dataset")


def modality_issue(attrs: ColumnLike, modality: ColumnLike, schema_name: str) -> Column:
    """Packages whose schema_name is the given one must have the modality, and its type; others are not checked."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in PACKAGE_TYPES.items() for x in kv)), col(modality))
    differs = ~_attribute(attrs, "modality").eqNullSafe(col(modality)) | ~_attribute(attrs, "dataset_type").eqNullSafe(kind)
    return F.when(_attribute(attrs, "schema_name") == schema_name, F.when(kind.isNull(), "modality unknown").when(differs, "another modality or type"))


def label_storage_issue(attrs: ColumnLike) -> Column:
    """seg_storage, if set, must be one of LABEL_STORAGE."""
    return F.when(~_attribute(attrs, "seg_storage").isin(*LABEL_STORAGE), "unknown label storage")


def mask_label_issue(names: ColumnLike, ids: ColumnLike) -> Column:
    """The ids of channel masks, if set, must be 0, 1, 2, ... beside their names."""
    identity = F.transform(col(names), lambda _, k: k.cast("long"))
    return F.when(col(ids).isNotNull() & ~col(ids).cast("array<long>").eqNullSafe(identity), "mask ids are not 0, 1, 2, ...")


def payload_key(name: str, containers: list[ColumnLike], attrs: ColumnLike, aliases: tuple[str, ...] = (), fallback: str | None = None) -> Column:
    """Field of a payload such as ``image``, null if nothing names it.

    ``containers`` are maps (payload_keys, payload_fields, keys) looked up in order by ``name_key``
    and ``name_field``, those of the aliases, and the bare names; ``attrs`` only by the names with
    an ending; then comes the fallback.
    """
    keyed = [n + end for n in (name, *aliases) for end in ("_key", "_field")]
    return F.coalesce(*(_attribute(c, *keyed, name, *aliases) for c in containers), _attribute(attrs, *keyed), F.lit(fallback).cast("string"))


def subject_of(sample_key: ColumnLike, metadata: ColumnLike, grouping: str) -> Column:
    """The sample itself, or with grouping ``subject`` what its metadata say: subject_id, subject or subject_key."""
    if grouping not in ("sample", "subject"):
        raise ValueError(grouping)
    return col(sample_key) if grouping == "sample" else F.coalesce(F.trim(_attribute(metadata, "subject_id", "subject", "subject_key")), col(sample_key))


def _issues(df: DataFrame, condition: Column, issue: str, key: str = "sample_id") -> DataFrame:
    return df.where(condition).select(F.col(key).cast("string").alias("key"), F.lit(issue).alias("issue"))


def record_issues(samples: DataFrame) -> DataFrame:
    """key, issue of a manifest's samples: required fields, repeated ids, subjects in several splits, repeated label names."""
    out = _issues(samples, F.greatest(*(F.coalesce(F.trim(c) == "", F.lit(True)) for c in ("dataset_name", "modality", "image"))), "a required field is empty")
    repeated = samples.groupBy("sample_id").count()
    leaks = samples.where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.count_distinct("split").alias("n"))
    return (
        out.unionByName(_issues(repeated, F.col("count") > 1, "sample_id stands twice"))
        .unionByName(_issues(leaks, F.col("n") > 1, "subject in several splits", "subject_id"))
        .unionByName(_issues(samples, F.size(F.array_distinct("label_names")) != F.size("label_names"), "a label name stands twice"))
    )


def image_issue(dtype: str = "source_dtype", shape: str = "shape", data: str = "data") -> Column:
    """A stored image is float32, of shape (1, height, width), in [0, 1]; null if so."""
    return (
        F.when(F.col(dtype) != "float32", "image is not float32").when((F.size(shape) != 3) | (F.get(shape, F.lit(0)) != 1), "image is not (1, height, width)")
        .when(~finite(data), "image is empty or not finite").when(F.exists(data, lambda x: (x < 0) | (x > 1)), "image is outside [0, 1]")
    )


def dense_label_issue(data: str = "data", stored: str = "stored_labels") -> Column:
    """Dense labels are whole, not negative, and declared; null if so."""
    ids = F.array_distinct(F.transform(data, lambda x: x.cast("int")))
    return (
        F.when(F.exists(data, lambda x: (x < 0) | (x != F.floor(x))), "label ids are negative or not whole")
        .when(F.size(F.array_except(ids, F.map_keys(stored))) > 0, "label ids are not declared")
    )


def channel_label_issue(data: str = "data", shape: str = "shape", names: str = "label_names") -> Column:
    """Channel labels are finite, in [0, 1], one channel a name; null if so."""
    return (
        F.when(~finite(data), "mask is empty or not finite").when(F.exists(data, lambda x: (x < 0) | (x > 1)), "mask is outside [0, 1]")
        .when(F.get(shape, F.lit(0)) != F.size(names), "channels and names differ in number")
    )


def volume_issue(shape: str, label_shape: str, label: str, affine: str, spacing: str) -> Column:
    """CT payloads: equal 3-D shapes, some foreground, an invertible affine, three positive spacings; null if so."""
    plain = lambda s: F.when((F.size(s) == 4) & (F.get(s, F.lit(0)) == 1), F.slice(s, 2, 3)).otherwise(F.col(s))
    return (
        F.when(F.size(plain(shape)) != 3, "volume is not 3-D").when(plain(shape) != plain(label_shape), "image and label shapes differ")
        .when(~F.exists(label, lambda x: x > 0), "no foreground").when(~finite(affine) | (F.size(affine) != 16), "affine is not 4 x 4")
        .when(F.abs(determinant(affine)) == 0, "affine is not invertible")
        .when((F.size(spacing) != 3) | ~finite(spacing) | F.exists(spacing, lambda x: x <= 0), "spacing is not three positive numbers")
    )


def crop_metadata_issue(ids: str = "fg_label_ids", centroids: str = "fg_centroids") -> Column:
    return F.when(F.size(ids) != F.size(centroids), "labels and centroids differ in number").when(F.size(ids) == 0, "no labels").when(F.exists(centroids, lambda c: F.size(c) != 3), "a centroid is not a triple")


def label_encoding(dataset_type: str = "dataset_type", shape: str = "shape") -> Column:
    return F.when((F.col(dataset_type) == "ct") | (F.size(shape) == 2), "dense").otherwise("channels")


def missing_splits(samples: DataFrame, required: list[str]) -> DataFrame:
    """Required splits that have no sample."""
    wanted = samples.sparkSession.createDataFrame([(s,) for s in required], "split string")
    return wanted.join(samples.select("split").distinct(), "split", "left_anti")
