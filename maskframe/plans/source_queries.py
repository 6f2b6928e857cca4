"""Queries over stored samples and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.plans.catalog import query
from maskframe.plans.tables import table
from maskframe.sources import packages, records
from maskframe.streaming import events


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, or a temporary one where the session runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskframe-")
    return f"{base}/{uuid.uuid4().hex}"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: the customer decides the split, so subjects don't leak."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("subject_id"), F.when(F.col("o_custkey") % 5 == 0, "val").otherwise("train").alias("split"),
        F.lit("orders").alias("dataset_name"), F.lit("xray").alias("modality"), F.concat(F.lit("image_"), F.col("o_orderkey")).alias("image"), F.array(F.col("o_orderstatus")).alias("label_names"),
    )


@query("package_roundtrip", "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n_samples, count(DISTINCT o_custkey) AS n_subjects FROM orders GROUP BY ALL")
def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed, checked, moved in and inspected."""
    path = f"{_folder(spark)}/package"
    packages.write_package(_samples(spark, sf_dir), path, "orders")
    return packages.inspect_package(spark, path)


@query("record_issues", """SELECT o_custkey::VARCHAR AS key, 'subject in several splits' AS issue FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1
UNION ALL SELECT o_orderkey::VARCHAR, 'a required field is empty' FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT (o_orderkey // 2)::VARCHAR, 'sample_id stands twice' FROM orders GROUP BY o_orderkey // 2 HAVING count(*) > 1""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty samples: priorities as splits leak, halved keys repeat, every hundredth has no image."""
    faulty = _samples(spark, sf_dir).withColumn("image", F.when(F.col("sample_id").cast("long") % 100 == 0, "").otherwise(F.col("image")))
    splits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("priority"))
    faulty = faulty.join(splits, "sample_id").withColumn("split", F.col("priority")).drop("priority")
    missing = records.record_issues(faulty).where("issue <> 'sample_id stands twice'")
    halved = faulty.withColumn("sample_id", F.floor(F.col("sample_id").cast("long") / 2).cast("string"))
    return missing.unionByName(records.record_issues(halved).where("issue = 'sample_id stands twice'"))


@query("opened_packages", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_custkey::VARCHAR ELSE c_name END AS subject,
CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'stored' ELSE 'image' END AS image_key,
CASE WHEN c_mktsegment <> 'BUILDING' THEN 'another dataset' WHEN c_custkey % 7 = 0 THEN 'not a clean dataset' END AS identity,
CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 2 = 0 THEN 'another modality or type' END AS modality,
CASE WHEN c_nationkey % 3 = 1 THEN 'unknown label storage' END AS storage FROM customer""")
def opened_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as attributes of packages: the checks on opening one, its image field and its subject."""
    key, nation, name = (F.col(c) for c in ("c_custkey", "c_nationkey", "c_name"))
    text = lambda *pairs: F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    subject = text(*(x for k, n in enumerate(("subject_id", "subject", "subject_key")) for x in (F.lit(n), F.when(key % 4 == k, name))))
    attrs = text(
        F.lit("dataset_name"), F.col("c_mktsegment"), F.lit("clean_dataset"), F.when(key % 7 == 0, "false").otherwise("true"), F.lit("image_key"), F.when(key % 3 == 1, "stored"),
        F.lit("schema_name"), F.when(key % 2 == 0, "training"), F.lit("modality"), F.when(nation % 2 == 0, "ct").otherwise("xray"), F.lit("dataset_type"), F.lit("xray-seg"),
        F.lit("seg_storage"), F.element_at(F.array(F.lit("indexed_label_mask"), F.lit("other"), F.lit("overlapping_channel_mask")), (nation % 3 + 1).cast("int")),
    )
    read = table(spark, sf_dir, "customer").select("c_custkey", subject.alias("metadata"), attrs.alias("attrs"), text(F.lit("image"), F.when(key % 3 == 0, name)).alias("payload_keys"))
    return read.select(
        "c_custkey", records.subject_of(F.col("c_custkey").cast("string"), "metadata", "subject").alias("subject"), records.payload_key("image", ["payload_keys"], "attrs", fallback="image").alias("image_key"),
        records.identity_issue("attrs", F.lit("BUILDING")).alias("identity"), records.modality_issue("attrs", F.lit("xray"), "training").alias("modality"), records.label_storage_issue("attrs").alias("storage"),
    )


@query("crop_metadata", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS q, embedding FROM embeddings), v AS (SELECT vec_id, CASE WHEN embedding[q + 1] > 0.15 THEN 2 WHEN embedding[q + 1] > 0.1 THEN 1 ELSE 0 END AS label FROM e)
SELECT vec_id, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) FILTER (label > 0) AS ids, CASE WHEN max(label) = 0 THEN 'no labels' END AS issue FROM v GROUP BY ALL""")
def crop_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted foreground ids of each volume, and what is wrong with its metadata."""
    label = lambda x: F.when(x > 0.15, 2).when(x > 0.1, 1).otherwise(0)
    ids = F.array_sort(F.filter(F.array_distinct(F.transform(F.col("embedding").cast("array<double>"), label)), lambda x: x > 0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("fg_label_ids"), F.transform(ids, lambda x: F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("fg_centroids"))
    return out.select("vec_id", F.nullif(F.array_join(F.transform("fg_label_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("ids"), records.crop_metadata_issue().alias("issue"))


@query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of event types, computed as a stream and read back."""
    # complete mode: the last windows are written without waiting for a later event
    out = events.drain(events.windowed_means(events.read_events(spark, sf_dir)), _folder(spark), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("stream_average", """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(sum(value * power(0.98::DOUBLE, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.02 END), 6) AS shadow FROM v GROUP BY ALL""")
def stream_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed averages of event types as streaming state."""
    # one trigger: part files hold ids in any order
    updates = events.drain(events.decayed_average(events.read_events(spark, sf_dir, None), 0.98), _folder(spark), "update")
    return updates.groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.max_by("shadow", "n"), 6).alias("shadow"))
