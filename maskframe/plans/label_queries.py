"""Label space queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.operators import labels
from maskframe.plans.catalog import query
from maskframe.plans.tables import rows, table

ALIASES = [("parts", "ECONOMY", "STANDARD"), ("parts", "PROMO", "LARGE")]
DROPS = [("parts", "SMALL")]
PROTOCOL = [(0, "background"), (1, "STANDARD"), (2, "LARGE"), (3, "MEDIUM")]
MODEL = [(0, "background"), (1, "STANDARD"), (2, "MEDIUM")]

_STORED_SQL = "stored AS (SELECT 0 AS native_id, 'background' AS native_label UNION ALL SELECT row_number() OVER (ORDER BY p_type), p_type FROM (SELECT DISTINCT p_type FROM part))"
_EXPLAIN_SQL = (
    _STORED_SQL
    + """, explained AS (
  SELECT native_id, native_label,
    CASE WHEN native_label = 'background' THEN 'background' WHEN native_label = 'SMALL' THEN 'drop' WHEN native_label IN ('ECONOMY', 'PROMO') THEN 'alias' ELSE 'identity' END AS rule,
    CASE WHEN native_label IN ('background', 'SMALL') THEN 'background' WHEN native_label = 'ECONOMY' THEN 'STANDARD' WHEN native_label = 'PROMO' THEN 'LARGE' ELSE native_label END AS label
  FROM stored),
protocol AS (SELECT * FROM (VALUES (0, 'background'), (1, 'STANDARD'), (2, 'LARGE'), (3, 'MEDIUM')) t(channel, label)),
model AS (SELECT * FROM (VALUES (0, 'background'), (1, 'STANDARD'), (2, 'MEDIUM')) t(model_id, label))"""
)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("native_label")).distinct()
    ids = kinds.select(F.lit("parts").alias("dataset"), F.row_number().over(Window.orderBy("native_label")).cast("int").alias("native_id"), "native_label")  # a handful of types
    return rows(spark, [("parts", 0, labels.BACKGROUND)], "dataset string, native_id int, native_label string").unionByName(ids)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.explain_labels(
        _stored(spark, sf_dir), rows(spark, ALIASES, "dataset string, native_label string, label string"),
        rows(spark, DROPS, "dataset string, native_label string"), rows(spark, PROTOCOL, "channel int, label string"),
    )


@query("lut_explain", f"WITH {_EXPLAIN_SQL} SELECT native_id::INT AS native_id, native_label, rule, channel::INT AS channel, label FROM explained LEFT JOIN protocol USING (label)")
def lut_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).drop("dataset")


@query("lut_project_agg", f"WITH {_EXPLAIN_SQL} SELECT channel::INT AS channel, label, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN explained ON p_type = native_label LEFT JOIN protocol USING (label) GROUP BY ALL")
def lut_project_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by harmonised label: the lookup is small, lineitem joins part once."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("native_label")).join(_explained(spark, sf_dir), "native_label")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return facts.join(part, "p_partkey").groupBy("channel", "label").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("lut_dense", f"WITH {_EXPLAIN_SQL} SELECT 'parts' AS dataset, string_agg(channel::VARCHAR, ',' ORDER BY native_id) AS lut FROM explained LEFT JOIN protocol USING (label)")
def lut_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.compile_luts(_explained(spark, sf_dir)).select("dataset", F.array_join(F.transform("lut", lambda x: x.cast("string")), ",").alias("lut"))


@query("lut_apply", f"WITH {_EXPLAIN_SQL} SELECT l_orderkey, count(*) AS n, sum(channel)::BIGINT AS channels, count(*) FILTER (channel = 0) AS n_background FROM lineitem JOIN part ON l_partkey = p_partkey JOIN explained ON p_type = native_label LEFT JOIN protocol USING (label) GROUP BY ALL")
def lut_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts as an image of native ids, gathered through the dense table in the row."""
    ids = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("native_label")).join(_stored(spark, sf_dir), "native_label")
    images = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(ids, "p_partkey").groupBy("l_orderkey", "dataset").agg(F.collect_list("native_id").alias("ids"))
    out = images.join(labels.compile_luts(_explained(spark, sf_dir)), "dataset").withColumn("c", labels.apply_lut("ids", "lut"))
    return out.select("l_orderkey", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("channels"), F.size(F.filter("c", lambda x: x == 0)).cast("long").alias("n_background"))


@query("model_remap", f"WITH {_EXPLAIN_SQL} SELECT native_id::INT AS native_id, label, channel::INT AS channel, coalesce(model_id, 0)::INT AS model_id FROM explained LEFT JOIN protocol USING (label) LEFT JOIN model USING (label)")
def model_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.remap_to_model(_explained(spark, sf_dir), rows(spark, MODEL, "model_id int, label string")).select("native_id", "label", "channel", "model_id")


@query("supervised_ids", f"WITH {_EXPLAIN_SQL} SELECT 'parts' AS dataset, native_id::INT AS native_id, channel::INT AS channel FROM explained JOIN protocol USING (label) WHERE native_id > 0 AND channel > 0")
def supervised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.supervised_ids(_explained(spark, sf_dir))


@query("known_negatives", f"WITH {_EXPLAIN_SQL} SELECT DISTINCT p_brand AS dataset, model_id::INT AS model_id FROM (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING max(p_size) < 50) JOIN model ON label = p_type")
def known_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as datasets: types without a part of the largest size are known to be absent; two of them are in the model."""
    absent = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("label")).agg(F.max("p_size").alias("largest")).where("largest < 50")
    return labels.known_negatives(absent, rows(spark, MODEL, "model_id int, label string"))


CANDIDATES = [
    ("parts", "first", 0, 0, "Brand#11"), ("parts", "first", 0, 1, "Brand#99"), ("parts", "first", 1, 0, "Brand#12"), ("parts", "first", 1, 1, "Brand#13"),
    ("parts", "second", 0, 0, "Brand#21"), ("parts", "second", 1, 0, "Brand#22"), ("parts", "third", 0, 0, "Brand#98"),
]
_CANDIDATES_SQL = "candidates AS (SELECT * FROM (VALUES " + ", ".join(map(str, CANDIDATES)) + ") t(eval_set, eval_label, cand_idx, pos, model_label))"


@query("eval_candidates", f"""WITH {_CANDIDATES_SQL},
model AS (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS model_id FROM (SELECT DISTINCT p_brand FROM part)),
g AS (SELECT eval_set, eval_label, cand_idx, bool_and(model_id IS NOT NULL) AS ok, string_agg(model_label, ',' ORDER BY pos) AS model_labels, string_agg(model_id::VARCHAR, ',' ORDER BY pos) AS model_ids FROM candidates LEFT JOIN model ON label = model_label GROUP BY ALL)
SELECT eval_set, eval_label, cand_idx::INT AS cand_idx, model_labels, model_ids FROM g WHERE ok QUALIFY row_number() OVER (PARTITION BY eval_set, eval_label ORDER BY cand_idx) = 1""")
def eval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")).distinct()
    model = brands.withColumn("model_id", F.row_number().over(Window.orderBy("label")) - 1)  # 25 brands
    found = labels.select_candidates(rows(spark, CANDIDATES, "eval_set string, eval_label string, cand_idx int, pos int, model_label string"), model, policy="drop")
    return found.select("eval_set", "eval_label", "cand_idx", F.array_join("model_labels", ",").alias("model_labels"), F.array_join(F.transform("model_ids", lambda x: x.cast("string")), ",").alias("model_ids"))


@query("rule_violations", """WITH n AS (SELECT r_name AS dataset, n_name AS name, n_nationkey AS k, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT dataset, CASE WHEN k % 4 = 1 THEN name || ' II' ELSE name END AS name, CASE k % 4 WHEN 2 THEN name WHEN 3 THEN 'background' ELSE 'land' END AS label FROM n), d AS (SELECT dataset, CASE WHEN k % 6 = 5 THEN name || ' III' ELSE name END AS name FROM n WHERE k % 6 IN (0, 5))
SELECT dataset, 'alias of an unknown label' AS issue, name AS detail FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.dataset = a.dataset AND n.name = a.name)
UNION ALL SELECT dataset, 'drop of an unknown label', name FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.dataset = d.dataset AND n.name = d.name)
UNION ALL SELECT dataset, 'alias of or to background', name FROM a WHERE label = 'background' UNION ALL SELECT dataset, 'identity alias', name FROM a WHERE label = name
UNION ALL SELECT dataset, 'aliased and dropped', name FROM a WHERE EXISTS (SELECT 1 FROM d WHERE d.dataset = a.dataset AND d.name = a.name)
UNION ALL SELECT dataset, 'known negative is stored', name FROM n WHERE k % 5 = 0""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as datasets with their nations as stored labels; rules made of the nations' keys break in every way."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = nations.select(F.col("r_name").alias("dataset"), F.col("n_name").alias("native_label"), F.col("n_nationkey").alias("k"))
    ids = n.select("dataset", F.row_number().over(Window.partitionBy("dataset").orderBy("k")).alias("native_id"), "native_label")
    stored = ids.unionByName(n.select("dataset").distinct().select("dataset", F.lit(0).alias("native_id"), F.lit(labels.BACKGROUND).alias("native_label")))
    name, kind = F.col("native_label"), F.col("k") % 4
    target = F.when(kind == 2, name).when(kind == 3, labels.BACKGROUND).otherwise("land")
    aliases = n.select("dataset", F.when(kind == 1, F.concat(name, F.lit(" II"))).otherwise(name).alias("native_label"), target.alias("label"))
    drops = n.where("k % 6 IN (0, 5)").select("dataset", F.when(F.col("k") % 6 == 5, F.concat(name, F.lit(" III"))).otherwise(name).alias("native_label"))
    return labels.rule_violations(stored, aliases, drops, n.where("k % 5 = 0").select("dataset", name.alias("label")))


@query("channel_projection", """WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS k, embedding FROM embeddings),
px AS (SELECT vec_id, (k - 1) // 16 AS c, (k - 1) % 16 AS pixel, embedding[k]::DOUBLE AS p FROM e),
m AS (SELECT vec_id, CASE WHEN c IN (0, 1) THEN 1 ELSE 2 END AS channel, pixel, max(p) AS p FROM px WHERE c < 3 GROUP BY ALL)
SELECT vec_id AS sample_id, channel::INT AS channel, count(*) AS n_pixels, round(sum(p), 6) AS total FROM m GROUP BY ALL""")
def channel_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four named channels of an embedding onto two targets: a and b merge, d has no target."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.slice("embedding", 16 * k + 1, 16).cast("array<double>").alias("data")) for k, n in enumerate("abcd")))).alias("x"))
    out = labels.project_channels(e.select("sample_id", "x.label", "x.data"), rows(spark, [("a", "ab"), ("b", "ab")], "label string, target_label string"), rows(spark, [(1, "ab"), (2, "c")], "channel int, label string"))
    return out.select("sample_id", "channel", F.size("data").cast("long").alias("n_pixels"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("background_complement", """WITH e AS (SELECT vec_id, unnest(range(1, 17)) AS i, embedding FROM embeddings)
SELECT vec_id AS sample_id, count(*) FILTER (NOT (embedding[16 + i] > 0 OR embedding[32 + i] > 0 OR embedding[48 + i] > 0)) AS n_background FROM e GROUP BY ALL""")
def background_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.array(*(F.slice("embedding", 16 * k + 1, 16).cast("array<double>") for k in range(4)))
    out = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), labels.background_complement(blocks).alias("c"))
    return out.select("sample_id", F.size(F.filter(F.get("c", F.lit(0)), lambda x: x > 0)).cast("long").alias("n_background"))
