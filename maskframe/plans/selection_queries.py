"""Selection, splitting, scheduling and weighting queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import selection
from maskframe.plans.catalog import query
from maskframe.plans.tables import rows, table


@query("record_filter", """WITH k AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 50000 AND o_custkey % 7 <> 0),
s AS (SELECT o_custkey, min(o_orderkey) AS f FROM k GROUP BY ALL ORDER BY f, o_custkey LIMIT 50)
SELECT o_orderkey AS data_id, o_custkey AS subject FROM k WHERE o_custkey IN (SELECT o_custkey FROM s)""")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: status is the modality, priority the split, a total above 50000 the label, the customer the subject."""
    records = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("modality"), F.lit("orders").alias("dataset_name"), F.col("o_orderpriority").alias("split"),
        F.when(F.col("o_totalprice") > 50000, "label").alias("label"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderkey").alias("data_id"), F.col("o_orderkey").alias("pos"),
    )
    excluded = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("subject"))
    kept = selection.filter_records(records, "O", ["orders"], "1-URGENT", True, excluded, 50)
    return kept.select("data_id", F.col("subject").cast("long").alias("subject"))


@query("pair_by_stem", "SELECT 'doc_' || doc_id AS stem, 'doc_' || doc_id || '.PNG' AS image, 'doc_' || doc_id || '.nii.gz' AS mask FROM documents WHERE doc_id % 6 = 0")
def pair_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda s: F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(s)).alias("name")
    images = docs.where("doc_id % 2 = 0").select(name(".PNG")).unionByName(docs.where("doc_id % 10 = 0").select(name(".txt")))
    return selection.pair_by_stem(images, docs.where("doc_id % 3 = 0").select(name(".nii.gz")), (".nii.gz", ".nii", ".png", ".jpg"))


_SPLITS_SQL = """p AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey::VARCHAR) - 1 AS place, count(*) OVER () AS n FROM customer),
z AS (SELECT *, n * 60 // 100 AS a, n * 25 // 100 AS b, n * 15 // 100 AS c, n * 60 % 100 AS ra, n * 25 % 100 AS rb, n * 15 % 100 AS rc FROM p),
q AS (SELECT *, n - a - b - c AS spare, (rb > ra)::INT + (rc > ra)::INT AS ka, (ra >= rb)::INT + (rc > rb)::INT AS kb FROM z),
bounds AS (SELECT *, a + (ka < spare)::INT AS ea, b + (kb < spare)::INT AS eb FROM q),
splits AS (SELECT c_custkey, CASE WHEN place < ea THEN 'train' WHEN place < ea + eb THEN 'val' ELSE 'test' END AS split FROM bounds)"""


@query("subject_splits", f"WITH {_SPLITS_SQL} SELECT split, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_subjects, sum(o_custkey)::BIGINT AS keys FROM orders JOIN splits ON c_custkey = o_custkey GROUP BY ALL")
def subject_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers split 60/25/15 by hash order; orders inherit the split."""
    splits = selection.subject_splits(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")), {"train": 60, "val": 25, "test": 15})
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_custkey").cast("string").alias("subject"))
    return orders.join(splits, "subject").groupBy("split").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_subjects"), F.sum("o_custkey").alias("keys"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("split"))


@query("split_leakage", "SELECT o_custkey AS subject, count(DISTINCT o_orderpriority) AS n_splits FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split_leaks(_samples(spark, sf_dir))


@query("split_counts", "SELECT o_orderpriority AS split, count(*) AS n_samples, count(DISTINCT o_custkey) AS n_subjects FROM orders GROUP BY ALL")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split_counts(_samples(spark, sf_dir))


def _event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


@query("apportion_steps", """WITH w AS (SELECT event_type AS source, count(*) AS weight FROM events GROUP BY ALL), t AS (SELECT *, sum(weight) OVER () AS total FROM w),
s AS (SELECT source, weight * 500 // total AS base, weight * 500 % total AS rest FROM t)
SELECT source, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 500 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM s""")
def apportion_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.apportion(_event_counts(spark, sf_dir).withColumnRenamed("n", "weight"), 500)


_JITTER = "('0x' || substr(md5('3:1:' || source || ':' || occurrence), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("stratified_schedule", f"""WITH c AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT source, n, unnest(range(0, n)) AS occurrence FROM c)
SELECT source, occurrence::INT AS occurrence, round((occurrence + {_JITTER}) / n, 9) AS position FROM r""")
def stratified_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stratified_schedule(_event_counts(spark, sf_dir), 3, 1).withColumn("position", F.round("position", 9))


@query("interleaved_batches", f"""WITH c AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT source, n, unnest(range(0, n)) AS occurrence FROM c),
b AS (SELECT event_type AS source, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 512 AS batch, event_id FROM events),
k AS (SELECT source, batch, min(event_id) AS first_id FROM b GROUP BY ALL), z AS (SELECT source, count(*) AS n_batches FROM k GROUP BY ALL)
SELECT source, occurrence::INT AS occurrence, first_id FROM r JOIN z USING (source) JOIN k USING (source) WHERE batch = occurrence % n_batches""")
def interleaved_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 512 events of one type, in schedule order; short sources start over."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id")
    batches = selection.homogeneous_batches(events, "source", ["event_id"], 512).groupBy("source", "batch").agg(F.min("event_id").alias("first_id"))
    return selection.interleave(selection.stratified_schedule(_event_counts(spark, sf_dir), 3, 1), batches).select("source", "occurrence", "first_id")


@query("homogeneous_batches", """WITH b AS (SELECT event_type AS source, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32 AS batch FROM events)
SELECT source, batch::BIGINT AS batch, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY ALL HAVING count(*) = 32""")
def homogeneous_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id")
    return selection.homogeneous_batches(events, "source", ["event_id"], 32, drop_last=True).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_OFFSETS_SQL = "o AS (SELECT c_nationkey AS source, (sum(count(*)) OVER (ORDER BY c_nationkey) - count(*))::BIGINT AS start, (sum(count(*)) OVER (ORDER BY c_nationkey))::BIGINT AS stop FROM customer GROUP BY c_nationkey)"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.composite_offsets(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.count("*").alias("n")).withColumn("pos", F.col("source")))


@query("composite_offsets", f"WITH {_OFFSETS_SQL} SELECT source, start, stop FROM o")
def composite_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).drop("pos")


@query("composite_index", f"WITH {_OFFSETS_SQL}, i AS (SELECT unnest(range(-20, 150)) AS index), e AS (SELECT max(stop) AS e FROM o), a AS (SELECT index, CASE WHEN index < 0 THEN index + e ELSE index END AS j FROM i, e) SELECT index, source, j - start AS local FROM a JOIN o ON j >= start AND j < stop")
def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.locate_index(spark.range(-20, 150).withColumnRenamed("id", "index"), _offsets(spark, sf_dir))


@query("inverse_freq_weights", """WITH d AS (SELECT DISTINCT l_orderkey AS crop, l_linenumber AS class FROM lineitem), a AS (SELECT o_orderkey AS crop FROM orders), n AS (SELECT count(*) AS n FROM a),
c AS (SELECT class, sqrt(any_value(n)::DOUBLE / count(*)) AS r FROM d, n GROUP BY class), w AS (SELECT crop, max(r) AS raw FROM d JOIN c USING (class) GROUP BY ALL),
f AS (SELECT crop, coalesce(raw, 0) AS raw FROM a LEFT JOIN w USING (crop)) SELECT crop, round(raw / avg(raw) OVER (), 6) AS weight FROM f""")
def inverse_freq_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crops, their line numbers as classes."""
    classes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("crop"), F.col("l_linenumber").alias("class"))
    return selection.inverse_frequency_weights(classes, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("crop")), 0.5, "max").withColumn("weight", F.round("weight", 6))


@query("weighted_draws", """WITH i AS (SELECT s_suppkey AS item, s_acctbal::BIGINT AS weight FROM supplier WHERE s_acctbal::BIGINT > 0),
c AS (SELECT item, sum(weight) OVER (ORDER BY substr(md5(item::VARCHAR), 1, 3), item) AS hi, weight, sum(weight) OVER () AS total FROM i),
d AS (SELECT unnest(range(0, 2000)) AS draw), x AS (SELECT draw, ('0x' || substr(md5('5:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (SELECT any_value(total) FROM c) AS x FROM d)
SELECT item, count(*) AS n FROM x JOIN c ON x < hi AND x >= hi - weight GROUP BY ALL""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their balances, rounded as DuckDB casts doubles: halves to even."""
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.rint("s_acctbal").cast("long").alias("weight"))
    return selection.weighted_draws(items, 2000, 5).groupBy("item").agg(F.count("*").alias("n"))


@query("active_sources", "SELECT r_name AS source FROM region WHERE r_regionkey IN (0, 2)")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions 0 to 2 have proportions, that of region 1 is 0; the others are omitted."""
    region = table(spark, sf_dir, "region")
    proportions = region.where("r_regionkey < 3").select(F.col("r_name").alias("source"), F.when(F.col("r_regionkey") == 1, 0.0).otherwise(0.5).alias("proportion"))
    return selection.active_sources(region.select(F.col("r_name").alias("source")), proportions)


@query("unique_stems", "WITH s AS (SELECT p_brand AS stem, p_partkey AS idx, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT idx, CASE WHEN k > 1 THEN stem || '_' || k ELSE stem END AS unique_stem FROM s")
def unique_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.unique_stems(table(spark, sf_dir, "part").select(F.col("p_brand").alias("stem"), F.col("p_partkey").alias("idx"))).select("idx", "unique_stem")


@query("crop_plan", """WITH d AS (SELECT doc_id, n_chars AS depth, n_chars - 256 AS last FROM documents),
m AS (SELECT *, CASE WHEN depth <= 256 THEN 0 WHEN last < 192 THEN 1 ELSE ceil(last / 192.0)::BIGINT END AS k FROM d), r AS (SELECT *, unnest(range(0, k + 1)) AS i FROM m),
s AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 1 AND last < 192 THEN i * last ELSE round_even(i * last / k::DOUBLE, 0)::BIGINT END AS z FROM r)
SELECT doc_id, i::INT AS crop_index, z::BIGINT AS z_start, least(z + 256, depth)::BIGINT AS z_stop, (greatest(256 - depth, 0) // 2)::BIGINT AS pad_before, (greatest(256 - depth, 0) - greatest(256 - depth, 0) // 2)::BIGINT AS pad_after FROM s""")
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 256 along documents' lengths, a quarter overlapping."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("depth"))
    return docs.select("doc_id", F.inline(selection.crop_plan("depth", 256, 0.25)))


@query("crop_ids", "SELECT doc_id, 'doc' || doc_id || '__crop' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS crop_id FROM documents")
def crop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("s"), (F.col("doc_id") % 7).alias("k"))
    return docs.select("doc_id", selection.crop_sample_id("s", "k").alias("crop_id"))


@query("sweep_product", """WITH a AS (SELECT l_returnflag AS flag, row_number() OVER (ORDER BY l_returnflag) AS i FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
b AS (SELECT r_name AS region, r_regionkey AS j FROM region), s AS (SELECT seed, k FROM (VALUES (40, 0), (41, 1), (42, 2)) t(seed, k))
SELECT flag, region, seed::INT AS seed, (row_number() OVER (ORDER BY i, j, k) - 1)::INT AS config_idx FROM a, b, s""")
def sweep_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag")).distinct().withColumn("flag_ord", F.col("flag"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("region_ord"))
    seeds = rows(spark, [(40, 0), (41, 1), (42, 2)], "seed int, seed_ord int")
    return selection.sweep([flags, regions, seeds]).withColumn("config_idx", F.col("config_idx").cast("int"))
