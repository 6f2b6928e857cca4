"""Normalisation, geometry and post-processing queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import normalise, yamltext
from maskframe.functions.arrays import doubles, total
from maskframe.operators import augment, postprocess, preprocess, raster, sampling, volume_labels
from maskframe.plans.catalog import query
from maskframe.plans.tables import table


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"))


def _summed(df: DataFrame, a) -> DataFrame:
    return df.select("l_orderkey", F.size("v").cast("long").alias("n"), F.round(total(a), 6).alias("total"))


@query("percentile_minmax", """WITH q AS (SELECT l_orderkey, quantile_cont(l_extendedprice, 0.005) AS a, quantile_cont(l_extendedprice, 0.995) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n, round(sum((least(greatest(l_extendedprice, a), b) - a) / greatest(b - a, 1e-8)), 6) AS total FROM lineitem JOIN q USING (l_orderkey) GROUP BY ALL""")
def percentile_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's prices as an image, clipped to percentiles 0.5 and 99.5 and scaled."""
    return _summed(_prices(spark, sf_dir), normalise.percentile_minmax("v"))


@query("minmax_norm", """WITH q AS (SELECT l_orderkey, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n, round(sum((l_extendedprice - a) / greatest(b - a, 1e-8)), 6) AS total FROM lineitem JOIN q USING (l_orderkey) GROUP BY ALL""")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_prices(spark, sf_dir), normalise.minmax("v"))


@query("unit_range", """WITH q AS (SELECT l_orderkey, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN b > a THEN (l_extendedprice - a) / (b - a) ELSE 0 END), 6) AS total FROM lineitem JOIN q USING (l_orderkey) GROUP BY ALL""")
def unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_prices(spark, sf_dir), normalise.unit_range("v"))


@query("standardize", """WITH q AS (SELECT l_orderkey, avg(l_extendedprice) AS m, coalesce(stddev_samp(l_extendedprice), 0) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n, round(sum(abs((l_extendedprice - m) / (s + 1e-8))), 5) AS total FROM lineitem JOIN q USING (l_orderkey) GROUP BY ALL""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's prices, 0 where there is no deviation."""
    v = normalise.scaled_in_group("l_extendedprice", ["l_orderkey"], "standardize")
    scaled = table(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("x"))
    return scaled.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("x")), 5).alias("total"))


_PER_IMAGE = 65_536  # order keys of one image


@query("image_scalings", f"""WITH v AS (SELECT l_orderkey // {_PER_IMAGE} AS image, l_extendedprice AS x FROM lineitem),
q AS (SELECT image, min(x) AS low, max(x) AS high, quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s FROM v GROUP BY ALL)
SELECT image, count(*) AS n, round(sum(CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0 END), 4) AS unit_range, round(sum((x - low) / greatest(high - low, 1e-8)), 4) AS minmax,
round(sum((least(greatest(x, a), b) - a) / greatest(b - a, 1e-8)), 4) AS percentile, round(sum(abs((x - m) / (s + 1e-8))), 4) AS standardized FROM v JOIN q USING (image) GROUP BY ALL""")
def image_scalings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array scalings over images of real size: the prices of 65,536 order keys."""
    values = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / _PER_IMAGE).alias("image"), F.col("l_extendedprice").cast("double").alias("x"))
    images = values.groupBy("image").agg(F.collect_list("x").alias("v"))
    summed = lambda a, name: F.round(total(a), 4).alias(name)
    absolute = F.transform(normalise.standardize("v"), F.abs)
    return images.select("image", F.size("v").cast("long").alias("n"), summed(normalise.unit_range("v"), "unit_range"), summed(normalise.minmax("v"), "minmax"), summed(normalise.percentile_minmax("v"), "percentile"), summed(absolute, "standardized"))


@query("integer_scale", "SELECT p_partkey, round(p_size / 255.0::DOUBLE, 9) AS as_uint8, round((p_size + 128) / 255.0::DOUBLE, 9) AS as_int8 FROM part")
def integer_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(normalise.integer_scale("p_size", "uint8"), 9).alias("as_uint8"), F.round(normalise.integer_scale("p_size", "int8"), 9).alias("as_int8"))


@query("prob_quantize", "SELECT l_discount, least(greatest(round_even(l_discount * 255, 0), 0), 255)::SMALLINT AS q, count(*) AS n FROM lineitem GROUP BY ALL")
def prob_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).withColumn("q", normalise.quantize_probability("l_discount"))


@query("prob_dequantize", "WITH a AS (SELECT l_orderkey, max(l_linenumber) AS m, sum(l_linenumber) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(CASE WHEN m <= 1 THEN s ELSE s / 255.0::DOUBLE END, 8) AS as_int, round(s / 255.0::DOUBLE, 8) AS as_uint8 FROM a")
def prob_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("v"))
    return saved.select("l_orderkey", F.round(total(normalise.dequantize_probabilities("v", F.lit("int16"))), 8).alias("as_int"), F.round(total(normalise.dequantize_probabilities("v", F.lit("uint8"))), 8).alias("as_uint8"))


@query("logit_roundtrip", "WITH p AS (SELECT DISTINCT l_discount AS p, least(greatest(l_discount, 1e-6), 1 - 1e-6) AS c FROM lineitem) SELECT p, round(ln(c) - ln(1 - c), 6) AS logit, round(ln(c), 6) AS log_p FROM p")
def logit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("p")).distinct()
    return p.select("p", F.round(normalise.probability_logit("p"), 6).alias("logit"), F.round(normalise.probability_logit("p", True), 6).alias("log_p"))


@query("softmax", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(max(exp(x)) / sum(exp(x)), 6) AS top FROM e GROUP BY ALL")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(normalise.softmax("embedding")), 6).alias("top"))


@query("hounsfield", "SELECT o_orderkey, CASE WHEN x <= -900 THEN -1000.0 ELSE greatest(x, -500) END AS bounded, least(greatest(x, -200), 300) AS windowed FROM (SELECT o_orderkey, o_totalprice / 128 - 1000 AS x FROM orders)")
def hounsfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 128 - 1000).alias("x"))
    return o.select("o_orderkey", normalise.hu_bounds("x", -500, -900).alias("bounded"), normalise.hu_window("x", -200, 300).alias("windowed"))


@query("luminance", "SELECT p_partkey, round((0.299 * p_size + 0.587 * (p_partkey % 256) + 0.114 * (p_partkey % 7)) * least(greatest(p_size / 40.0::DOUBLE, 0), 1), 6) AS y FROM part")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(normalise.luminance(F.col("p_size"), F.col("p_partkey") % 256, F.col("p_partkey") % 7, F.col("p_size") / 40), 6).alias("y"))


@query("mask_suppression", "WITH e AS (SELECT vec_id, unnest(range(1, 33)) AS i, embedding FROM embeddings) SELECT vec_id, round(sum(CASE WHEN embedding[32 + i] > 0.05 THEN 0 ELSE embedding[i]::DOUBLE END), 6) AS total FROM e GROUP BY ALL")
def mask_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a vector, zeroed where the second is above 0.05."""
    kept = raster.suppress(doubles(F.slice("embedding", 1, 32)), F.slice("embedding", 33, 32), 0.05)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(kept), 6).alias("total"))


@query("hip_cleanup", """WITH e AS (SELECT vec_id, unnest(range(0, 32)) AS i, embedding FROM embeddings), p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1] > 0 AS a, embedding[33 + i] > 0.2 AS b FROM e)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.vec_id = v.vec_id AND a AND NOT EXISTS (SELECT 1 FROM p q WHERE q.vec_id = p.vec_id AND q.b AND (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= 4)) AS n FROM embeddings v""")
def hip_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pixels of a 4 x 8 mask farther than 2 from every pixel of another."""
    second = F.transform(F.slice("embedding", 33, 32), lambda x: F.when(x > 0.2, 1.0).otherwise(0.0))
    kept = raster.remove_near(doubles(F.slice("embedding", 1, 32)), second, F.lit(8), 0.0, 2.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(kept).cast("long").alias("n"))


_RULED = "CASE vec_id % 5 WHEN 0 THEN 'HipRay' WHEN 1 THEN 'MendeleyCXR' WHEN 2 THEN 'HipRay' WHEN 3 THEN 'Other' ELSE 'MendeleyCXR' END"


@query("postprocess_rules", f"""WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), px AS (SELECT vec_id, vec_id % 5 AS k, i // 16 AS c, i % 16 // 4 AS y, i % 4 AS x, embedding[i + 1]::DOUBLE AS p FROM e),
n AS (SELECT *, CASE WHEN k = 0 AND c = 0 THEN (p > 0.15 AND NOT EXISTS (SELECT 1 FROM px f WHERE f.vec_id = px.vec_id AND f.c = 1 AND f.p > 0.15 AND (f.y - px.y) ** 2 + (f.x - px.x) ** 2 <= 16))::INT::DOUBLE
  WHEN k IN (1, 4) AND c = 1 AND EXISTS (SELECT 1 FROM px f WHERE f.vec_id = px.vec_id AND f.c = 0 AND f.y = px.y AND f.x = px.x AND f.p > 0.15) THEN 0 ELSE p END AS q FROM px)
SELECT vec_id, {_RULED} AS dataset, CASE k WHEN 2 THEN 'missing_labels' WHEN 3 THEN 'no_rule' ELSE 'applied' END AS status, round(sum(q), 6) AS total, round(sum(q) FILTER (c = 0), 6) AS first_channel FROM n GROUP BY ALL""")
def postprocess_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of four channels of 4 x 4 pixels, each with the rule of its dataset."""
    names = F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in (["hips", "femurs"], ["liver", "lungs"], ["hips", "lungs"], ["hips", "femurs"], ["liver", "lungs"]))), (F.col("vec_id") % 5 + 1).cast("int"))
    prob = F.array(*(F.slice("embedding", 16 * k + 1, 16).cast("array<double>") for k in range(4)))
    images = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(_RULED).alias("dataset"), names.alias("label_names"), prob.alias("prob"), F.lit(4).alias("height"), F.lit(4).alias("width"))
    out = postprocess.postprocess(images, threshold=0.15)
    return out.select("vec_id", "dataset", "status", F.round(total(F.flatten("prob")), 6).alias("total"), F.round(total(F.get("prob", F.lit(0))), 6).alias("first_channel"))


@query("prepared_images", """WITH o AS (SELECT o_orderkey // 64000 AS image, o_orderkey % 64000 AS px, o_totalprice / 500000 AS v FROM orders), p AS (SELECT image, px // 320 AS y, px % 320 AS x, v, (v > 0.5)::INT AS m FROM o),
c AS (SELECT image, (y + 60) // 2 AS r, x // 2 AS c, sum(v) / 4 AS v FROM p GROUP BY ALL), s AS (SELECT image, round(sum(v), 4) AS total, round(sum(v * v), 4) AS squares FROM c GROUP BY ALL),
k AS (SELECT image, count(*) FILTER (m = 1 AND y % 2 = 0 AND x % 2 = 0) AS canvas_mask, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 AND m = 1 THEN 4 ELSE 0 END)::BIGINT AS image_mask FROM p GROUP BY ALL)
SELECT image, 60 AS pad_top, 0.5::DOUBLE AS scale, total, squares, canvas_mask, image_mask FROM s JOIN k USING (image)""")
def prepared_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 200 x 320 order keys padded to a square, averaged to 160 x 160, their masks taken along and brought back."""
    o = table(spark, sf_dir, "orders")
    place = (F.col("o_orderkey") % 64000).cast("int").alias("px")
    sparse = o.groupBy(F.floor(F.col("o_orderkey") / 64000).alias("image")).agg(F.collect_list(F.struct(place, (F.col("o_totalprice") / 500000).alias("v"))).alias("cells"))
    images = sparse.select("image", raster.from_places("cells.px", F.lit(64000), "cells.v").alias("data"), F.lit(200).alias("height"), F.lit(320).alias("width"))
    images = images.withColumn("mask", F.transform("data", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)))
    chain = preprocess.PackagePreprocessing.from_manifest({"intensity": "dtype_range", "pad_to_square": True, "output_size": [160, 160]})
    out = chain.apply(images, "data", "mask").withColumn("back", preprocess.to_image("mask", "geometry"))
    squares = F.aggregate("data", F.lit(0.0), lambda a, x: a + x * x)
    return out.select(
        "image", F.get("geometry.pad_before", F.lit(0)).alias("pad_top"), F.get("geometry.resize_scale", F.lit(0)).alias("scale"), F.round(total("data"), 4).alias("total"), F.round(squares, 4).alias("squares"),
        total("mask").cast("long").alias("canvas_mask"), total("back").cast("long").alias("image_mask"),
    )


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey")
    dear = F.collect_list(F.when(F.col("o_totalprice") > 450000, at % 4096))
    strips = table(spark, sf_dir, "orders").groupBy(F.floor(at / 65536).alias("volume"), F.floor(at % 65536 / 4096).alias("slab")).agg(dear.alias("places"))
    return strips.select("volume", "slab", F.lit(16).alias("depth"), F.lit(1).alias("height"), F.lit(256).alias("width"), raster.from_places("places", F.lit(4096)).alias("mask"))


@query("image_components", """WITH RECURSIVE o AS (SELECT o_orderkey // 65536 AS image, o_orderkey % 65536 // 256 AS y, o_orderkey % 256 AS x FROM orders WHERE o_totalprice > 450000),
n AS (SELECT a.image, a.y * 256 + a.x AS a, b.y * 256 + b.x AS b FROM o a JOIN o b ON a.image = b.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
r(image, px, root) AS (SELECT image, y * 256 + x, y * 256 + x FROM o UNION SELECT r.image, n.b, r.root FROM r JOIN n ON n.image = r.image AND n.a = r.px),
c AS (SELECT image, px, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT image, root, count(*) AS size FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY root) AS label FROM s)
SELECT image, count(*) AS n, max(size) AS largest, sum(size * label)::BIGINT AS weighted FROM k GROUP BY ALL""")
def image_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the dearest orders in images of 256 x 256 order keys, cut into strips of 16 rows."""
    labels, sizes = volume_labels.label_volumes(_strips(spark, sf_dir))
    drawn = labels.select("volume", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted")).groupBy("volume").agg(F.sum("weighted").alias("weighted"))
    return sizes.groupBy("volume").agg(F.count("*").alias("n"), F.max("size").alias("largest")).join(drawn, "volume").withColumnRenamed("volume", "image")


@query("largest_image_components", """WITH RECURSIVE o AS (SELECT o_orderkey // 65536 AS image, o_orderkey % 65536 // 256 AS y, o_orderkey % 256 AS x FROM orders WHERE o_totalprice > 450000),
n AS (SELECT a.image, a.y * 256 + a.x AS a, b.y * 256 + b.x AS b FROM o a JOIN o b ON a.image = b.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
r(image, px, root) AS (SELECT image, y * 256 + x, y * 256 + x FROM o UNION SELECT r.image, n.b, r.root FROM r JOIN n ON n.image = r.image AND n.a = r.px),
c AS (SELECT image, px, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT image, root, count(*) AS size, row_number() OVER (PARTITION BY image ORDER BY root) AS label FROM c GROUP BY image, root),
k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY size DESC, label) AS rank, max(size) OVER (PARTITION BY image) AS top FROM s)
SELECT image, label, size, rank::INT AS rank FROM k WHERE size >= greatest(1, ceil(top * 0.5)) AND rank <= 3""")
def largest_image_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the components of ``image_components`` the three largest of each image that reach half of its largest."""
    sizes = volume_labels.label_volumes(_strips(spark, sf_dir))[1]
    return raster.top_components(sizes, "volume", "size", "label", 3, 0.5).select(F.col("volume").alias("image"), "label", "size", "rank")


@query("equalized_images", """WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), p AS (SELECT vec_id, least(greatest(floor(least(greatest(x, 0), 1)::FLOAT * 255::FLOAT), 0), 255)::INT AS bin FROM e),
h AS (SELECT vec_id, bin, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT vec_id, bin, coalesce(n, 0) AS n FROM (SELECT vec_id, unnest(range(0, 256))::INT AS bin FROM embeddings) LEFT JOIN h USING (vec_id, bin)),
o AS (SELECT *, sum(greatest(n - 10, 0)) OVER (PARTITION BY vec_id) AS over FROM b), c AS (SELECT vec_id, bin, n, sum(least(n, 10) + over // 256 + (bin < over % 256)::INT) OVER (PARTITION BY vec_id ORDER BY bin) AS c FROM o)
SELECT vec_id, round(sum(n * least(greatest(floor(c * 3.984375), 0), 255) / 255.0::DOUBLE), 4) AS total FROM c GROUP BY ALL""")
def equalized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images, equalised in one tile whose bins are clipped at 10 pixels."""
    x = raster.equalize(doubles("embedding"), F.lit(8), F.lit(8), 40.0, (1, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(x), 4).alias("total"))


@query("normalised_prices", """WITH q AS (SELECT l_orderkey, quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.8) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n, round(sum((least(greatest(l_extendedprice, a), b) - a) / greatest(b - a, 0.5)), 6) AS total FROM lineitem JOIN q USING (l_orderkey) GROUP BY ALL""")
def normalised_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's prices normalised as settings in YAML say."""
    settings = yamltext.load("train:\n  normalization: {scheme: percentile_minmax, percentiles: [10, 80], eps: 0.5}\n")
    return _summed(_prices(spark, sf_dir), normalise.normalised("v", settings))


@query("top_components", """WITH m AS (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM m WHERE s_acctbal >= greatest(1, ceil(top * 0.05)))
SELECT s_nationkey, s_suppkey, rank::INT AS rank FROM k WHERE rank <= 2""")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest suppliers of each nation that reach 5 % of its largest."""
    return raster.top_components(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey", 2, 0.05).select("s_nationkey", "s_suppkey", "rank")


@query("nearest_resize", """WITH e AS (SELECT vec_id, unnest(range(0, 15)) AS i, embedding FROM embeddings) SELECT vec_id, round(sum(embedding[(((i // 5) * 8 // 3) * 8 + (i % 5) * 8 // 5)::INT + 1]::DOUBLE), 6) AS total FROM e GROUP BY ALL""")
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images resized to 3 x 5."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(raster.resize_nearest(doubles("embedding"), F.lit(8), F.lit(8), 3, 5)), 6).alias("total"))


@query("resample_1d", "WITH e AS (SELECT vec_id, unnest(range(0, 24)) AS i, embedding FROM embeddings) SELECT vec_id, round(sum(embedding[i * 64 // 24 + 1]::DOUBLE), 6) AS total FROM e GROUP BY ALL")
def resample_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(raster.resample_1d(doubles("embedding"), 24)), 6).alias("total"))


@query("area_resize", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), b AS (SELECT vec_id, (i // 8) // 2 AS y, (i % 8) // 2 AS x, avg(embedding[i + 1]::DOUBLE) AS m FROM e GROUP BY ALL)
SELECT vec_id, round(sum(least(greatest(m, 0), 1)), 6) AS total FROM b GROUP BY ALL""")
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images averaged to 4 x 4, clipped to [0, 1]."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(raster.resize_area(doubles("embedding"), F.lit(8), F.lit(8), 4, 4)), 6).alias("total"))


@query("pad_square", "SELECT vec_id, 64::BIGINT AS n, round(list_sum(embedding[1:40])::DOUBLE, 4) AS total, round(embedding[1]::DOUBLE, 6) AS first_pixel FROM embeddings")
def pad_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 components as a 5 x 8 image on its 8 x 8 square: one row above, two below."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", raster.pad_square(doubles(F.slice("embedding", 1, 40)), F.lit(5), F.lit(8)).alias("p"))
    return e.select("vec_id", F.size("p").cast("long").alias("n"), F.round(total("p"), 4).alias("total"), F.round(F.get("p", F.lit(8)), 6).alias("first_pixel"))


@query("content_box", """WITH p AS (SELECT p_partkey, p_size AS h, (p_partkey % 50 + 1) AS w FROM part), s AS (SELECT *, greatest(h, w) AS side FROM p), b AS (SELECT *, (side - h) // 2 AS pady, (side - w) // 2 AS padx FROM s),
r AS (SELECT *, least(round_even(pady * 256 / side::DOUBLE, 0), 255) AS y0, least(round_even(padx * 256 / side::DOUBLE, 0), 255) AS x0 FROM b)
SELECT p_partkey, y0::INT AS y0, x0::INT AS x0, least(greatest(round_even((pady + h) * 256 / side::DOUBLE, 0), y0 + 1), 256)::INT AS y1, least(greatest(round_even((padx + w) * 256 / side::DOUBLE, 0), x0 + 1), 256)::INT AS x1 FROM r""")
def content_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", raster.content_box(F.col("p_size"), F.col("p_partkey") % 50 + 1).alias("b")).select("p_partkey", "b.*")


@query("crop_volume", """WITH e AS (SELECT vec_id, unnest(range(0, 60)) AS q, vec_id % 3 - 1 AS o, embedding FROM embeddings), v AS (SELECT vec_id, q // 12 + o AS x, q // 4 % 3 + 1 AS y, q % 4 - 1 AS z, embedding FROM e)
SELECT vec_id, count(*) FILTER (x >= 0 AND x < 4 AND y >= 0 AND y < 4 AND z >= 0 AND z < 4) AS n_inside, round(sum(CASE WHEN x >= 0 AND x < 4 AND y >= 0 AND y < 4 AND z >= 0 AND z < 4 THEN embedding[(x * 16 + y * 4 + z)::INT + 1]::DOUBLE ELSE -1000 END), 4) AS total FROM v GROUP BY ALL""")
def crop_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 4 x 4 x 4 volumes: a window of 5 x 3 x 4 from a shifted corner, -1000 outside."""
    four = F.lit(4)
    window = raster.crop_or_pad(doubles("embedding"), (four, four, four), (5, 3, 4), ((F.col("vec_id") % 3 - 1).cast("int"), F.lit(1), F.lit(-1)), -1000.0)
    out = table(spark, sf_dir, "embeddings").select("vec_id", window.alias("w"))
    return out.select("vec_id", F.size(F.filter("w", lambda x: x > -999)).cast("long").alias("n_inside"), F.round(total("w"), 4).alias("total"))


@query("intrinsics", """WITH c AS (SELECT o_orderkey, o_totalprice AS sdd, 0.5 + o_custkey % 5 AS d, o_orderkey % 11 AS x0 FROM orders)
SELECT o_orderkey, round(d / sdd, 9) AS a, round(-(x0 / d + 128) * d / sdd, 6) AS b, round(-(0 + 100.0) * 0.7 / sdd, 9) AS c FROM c""")
def intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = raster.intrinsics(F.col("o_totalprice"), 0.5 + F.col("o_custkey") % 5, F.lit(0.7), F.col("o_orderkey") % 11, F.lit(0.0), 200, 256)
    return o.select("o_orderkey", k.alias("k")).select("o_orderkey", F.round(F.get("k", F.lit(0)), 9).alias("a"), F.round(F.get("k", F.lit(2)), 6).alias("b"), F.round(F.get("k", F.lit(5)), 9).alias("c"))


@query("voxel_world", """SELECT p_partkey, 2.0 * p_size + 10 AS x, 3.0 * (p_partkey % 9) - 5 AS y, 0.5 * (p_partkey % 4 + 2) + 1 AS z FROM part""")
def voxel_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places through an affine whose origin has moved two slices along."""
    affine = F.array(*map(F.lit, [2.0, 0.0, 0.0, 10.0, 0.0, 3.0, 0.0, -5.0, 0.0, 0.0, 0.5, 1.0, 0.0, 0.0, 0.0, 1.0]))
    world = raster.voxel_to_world(raster.offset_affine(affine, F.lit(2)), F.col("p_size"), F.col("p_partkey") % 9, F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", world.alias("w")).select("p_partkey", *(F.get("w", F.lit(k)).alias(n) for k, n in enumerate("xyz")))


@query("merge_views", """WITH e AS (SELECT label, vec_id % 2 = 1 AS flipped, unnest(range(0, 64)) AS i, embedding FROM embeddings), v AS (SELECT label, CASE WHEN flipped THEN i // 8 * 8 + 7 - i % 8 ELSE i END AS pixel, embedding[i + 1]::DOUBLE AS p FROM e)
SELECT label AS image, pixel::INT AS pixel, round(avg(p), 6) AS p FROM v GROUP BY ALL""")
def merge_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label as views of one image, those with odd ids flipped."""
    views = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.lit(0).alias("channel"), (F.col("vec_id") % 2 == 1).alias("flipped"), F.lit(8).alias("width"), doubles("embedding").alias("p"))
    return raster.merge_views(views).select("image", F.posexplode("p").alias("pixel", "p")).withColumn("p", F.round("p", 6))


_U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("camera_poses", f"""WITH v AS (SELECT vec_id, unnest(range(0, 3)) AS k FROM embeddings),
d AS (SELECT vec_id, k, -10 + 20 * ({_U.format("'7:' || vec_id || ':' || k || ':r0'")}) AS r0, 700 + 300 * ({_U.format("'7:' || vec_id || ':' || k || ':y'")}) AS y, 800 + 400 * ({_U.format("'7:' || vec_id || ':' || k || ':sdd'")}) AS s FROM v)
SELECT vec_id AS sample_id, k::INT AS view_idx, round(r0, 6) AS rot0, round(least(y, s), 6) AS y, round(greatest(y, s), 6) AS sdd FROM d""")
def camera_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded views of each embedding; source distance and sdd sorted."""
    views = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("view_idx"))
    out = sampling.poses(views, [(-10.0, 10.0)] * 3, [(-5.0, 5.0), (700.0, 1000.0), (-5.0, 5.0)], (800.0, 1200.0), 7)
    return out.select("sample_id", "view_idx", F.round(F.get("rot", F.lit(0)), 6).alias("rot0"), F.round(F.get("xyz", F.lit(1)), 6).alias("y"), F.round("sdd", 6).alias("sdd"))


@query("isocenters", f"""WITH c AS (SELECT c_nationkey AS s, c_custkey AS l FROM customer), o AS (SELECT s, l, row_number() OVER (PARTITION BY s ORDER BY {_U.format("'3:' || s || ':' || l")}, l) - 1 AS rank, count(*) OVER (PARTITION BY s) AS n FROM c),
v AS (SELECT DISTINCT s, n, unnest(range(0, 4)) AS k FROM o), w AS (SELECT s, k, CASE WHEN k < n THEN k ELSE floor(({_U.format("'3:' || s || ':' || k || ':again'")}) * n)::INT END AS rank FROM v)
SELECT s::INT AS sample_id, k::INT AS view_idx, l AS label FROM w JOIN o USING (s, rank)""")
def isocenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of each nation, looking at its customers without replacement first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sample_id"), F.col("c_custkey").alias("label"), *(F.lit(0.0).alias(x) for x in "ijk"))
    return sampling.sample_isocenters(c, 4, 3).select("sample_id", "view_idx", "label")


@query("intensity_scale", f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, CASE WHEN ({_U.format("'9:' || vec_id || ':on'")}) < 0.5 THEN 1 - 0.2 + 0.4 * ({_U.format("'9:' || vec_id")}) ELSE 1 END AS f FROM embeddings) SELECT vec_id, round(sum(x * f), 6) AS total FROM e GROUP BY ALL""")
def intensity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(sampling.intensity_scale("embedding", -0.2, 0.2, 0.5, 9, "vec_id")), 6).alias("total"))


_DRAW = lambda k, name, d: _U.format(f"'4:' || vec_id || ':{k}.{name}.{d}'")


@query("augmented_images", f"""WITH d AS (SELECT vec_id, embedding, ({_DRAW(0, "RandomHorizontalFlip", "on")}) < 0.5 AS flip, ({_DRAW(1, "RandomIntensityScale", "on")}) < 0.5 AS scaled, -0.2 + 0.4 * ({_DRAW(1, "RandomIntensityScale", "factor")}) AS f,
({_DRAW(2, "RandomInvert", "on")}) < 0.5 AS inverted, ({_DRAW(3, "RandomAspectCrop", "on")}) < 0.5 AS cropped, ({_DRAW(3, "RandomAspectCrop", "landscape")}) < 0.5 AS landscape, least(floor(2 * ({_DRAW(3, "RandomAspectCrop", "size")}))::INT, 1) AS u FROM embeddings),
p AS (SELECT *, i // 8 AS y, CASE WHEN flip THEN 7 - i % 8 ELSE i % 8 END AS x, embedding[i + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM d)),
q AS (SELECT vec_id, y, x, v > 0 AS lit, CASE WHEN inverted THEN 1 - w ELSE w END AS w, cropped AND CASE WHEN landscape THEN y < 2 - u OR y >= 6 + u ELSE x < 2 - u OR x >= 6 + u END AS cut FROM (SELECT *, CASE WHEN scaled THEN v * (1 + f) ELSE v END AS w FROM p))
SELECT vec_id, round(sum(CASE WHEN cut THEN 0 ELSE w * (8 * y + x + 1) END), 5) AS image, sum(CASE WHEN lit AND NOT cut THEN 8 * y + x + 1 ELSE 0 END)::BIGINT AS foreground, count(*) FILTER (cut OR NOT lit) AS background FROM q GROUP BY ALL""")
def augmented_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images with their positive pixels as label: flip, scale, inversion and strip, each by its draws."""
    settings = {"RandomHorizontalFlip": {"p": 0.5}, "RandomIntensityScale": {"factors": 0.2, "prob": 0.5}, "RandomInvert": {"p": 0.5}, "RandomAspectCrop": {"height_range": [4, 6], "width_range": [4, 6], "p": 0.5}}
    lit = lambda inside: F.transform("image", lambda x: F.when((x > 0) == inside, 1.0).otherwise(0.0))
    e = table(spark, sf_dir, "embeddings").select("vec_id", doubles("embedding").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width")).withColumn("label", F.array(lit(F.lit(False)), lit(F.lit(True))))
    placed = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    out = augment.augment(e, settings, 4, ["vec_id"])
    return out.select("vec_id", F.round(placed("image"), 5).alias("image"), placed(F.get("label", F.lit(1))).cast("long").alias("foreground"), total(F.get("label", F.lit(0))).cast("long").alias("background"))


@query("aspect_crop", "WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings) SELECT vec_id, round(sum(embedding[i + 1]::DOUBLE), 6) AS total FROM e WHERE i // 8 >= 2 AND i // 8 < 6 AND i % 8 >= 1 AND i % 8 < 7 GROUP BY ALL")
def aspect_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images, cut to the middle 5 (even: 4) rows and 6 columns."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(sampling.aspect_crop("embedding", F.lit(8), F.lit(8), F.lit(5), F.lit(6))), 6).alias("total"))


@query("projection", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS q, embedding FROM embeddings), p AS (SELECT vec_id, q // 16 AS i, q % 4 AS k, sum(embedding[q + 1]::DOUBLE) AS v FROM e GROUP BY ALL),
r AS (SELECT *, min(v) OVER (PARTITION BY vec_id) AS a, max(v) OVER (PARTITION BY vec_id) AS b FROM p) SELECT vec_id AS view, i::INT AS i, k::INT AS k, round((v - a) / greatest(b - a, 1e-6), 6) AS value FROM r""")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 4 x 4 x 4 volumes, summed along the second axis and scaled."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode(doubles("embedding")).alias("q", "value"))
    voxels = e.select("sample_id", F.floor(F.col("q") / 16).cast("int").alias("i"), (F.floor(F.col("q") / 4) % 4).alias("j"), (F.col("q") % 4).alias("k"), "value")
    return sampling.scale_views(sampling.parallel_projection(voxels).withColumnRenamed("sample_id", "view")).withColumn("value", F.round("value", 6))
