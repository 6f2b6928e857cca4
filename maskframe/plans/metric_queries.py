"""Metric, loss and report queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import metrics, raster, reporting
from maskframe.plans.catalog import query
from maskframe.plans.tables import IMAGES_SQL, embedding_images, rows, table

_HARD = IMAGES_SQL + ", s AS (SELECT vec_id, any_value(label) AS label, c, 2 * sum(((p > 0)::INT) * t) / greatest(sum((p > 0)::INT) + sum(t), 1e-7) AS score, sum(t) AS amount FROM px GROUP BY vec_id, c)"


def _hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dice(metrics.channels(embedding_images(spark, sf_dir), "binary", 0.0), smooth=0.0)


@query("hard_dice", _HARD + " SELECT vec_id AS sample_id, c::INT AS class_id, round(score, 6) AS score, amount::DOUBLE AS amount FROM s")
def hard_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice of positive components against the label's mean vector, in four channels."""
    return _hard(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("dice_weighted_mean", _HARD + """, w AS (SELECT *, CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END AS w0 FROM s),
b AS (SELECT *, CASE WHEN c = 0 AND max(CASE WHEN c > 0 THEN w0 END) OVER (PARTITION BY vec_id) > 0 THEN 0.0 ELSE w0 END AS w FROM w),
k AS (SELECT vec_id, label, CASE WHEN sum(w) > 0 THEN sum(score * w) / sum(w) END AS score FROM b GROUP BY ALL)
SELECT label::INT AS label, round(coalesce(avg(score), 0), 6) AS score FROM k GROUP BY label""")
def dice_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means without empty classes and background, averaged by label."""
    weighed = metrics.weigh(_hard(spark, sf_dir), ignore_empty=True, ignore_background=True)
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    return metrics.reduce_batch(metrics.reduce_classes(weighed).join(ids, "sample_id"), ["label"]).withColumn("score", F.round("score", 6))


@query("dice_onehot", IMAGES_SQL + """, b AS (SELECT vec_id, i, c, p, t, row_number() OVER (PARTITION BY vec_id, i ORDER BY p DESC, c) = 1 AS hp, row_number() OVER (PARTITION BY vec_id, i ORDER BY t DESC, c) = 1 AS ht FROM px)
SELECT vec_id AS sample_id, c::INT AS class_id, round(2 * sum((hp AND ht)::INT) / greatest(sum(hp::INT) + sum(ht::INT), 1e-7), 6) AS score FROM b GROUP BY ALL""")
def dice_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four channels as classes of one pixel: the largest wins, in prediction and target."""
    return metrics.dice(metrics.channels(embedding_images(spark, sf_dir), "onehot", 0.9), smooth=0.0).select("sample_id", "class_id", F.round("score", 6).alias("score"))


@query("dice_default", IMAGES_SQL + """, s AS (SELECT vec_id, c, (2 * sum(((p > 0.15)::INT) * t) + 1e-7) / greatest(sum((p > 0.15)::INT) + sum(t) + 1e-7, 1e-7) AS score FROM (SELECT vec_id, c, p, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE t END AS t FROM px) GROUP BY ALL)
SELECT vec_id AS sample_id, c::INT AS class_id, round(score, 6) AS score FROM s""")
def dice_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice with the default smoothing; every third image has empty targets, so empty predictions of them score 1."""
    images = embedding_images(spark, sf_dir).withColumn("target", F.when(F.col("sample_id") % 3 == 0, F.transform("target", lambda c: F.transform(c, lambda x: F.lit(0.0)))).otherwise(F.col("target")))
    return metrics.dice(metrics.channels(images, "binary", 0.15)).select("sample_id", "class_id", F.round("score", 6).alias("score"))


@query("soft_dice", IMAGES_SQL + """, q AS (SELECT vec_id, c, 1 / (1 + exp(-p)) AS p, t FROM px)
SELECT vec_id AS sample_id, c::INT AS class_id, round((2 * sum(p * t) + 1) / greatest(sum(p * p) + sum(t * t) + 1, 1e-7), 6) AS score FROM q GROUP BY ALL""")
def soft_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = metrics.channels(embedding_images(spark, sf_dir), "binary", None, from_logits=True)
    return metrics.soft_dice(rows_, smooth=1.0).select("sample_id", "class_id", F.round("score", 6).alias("score"))


@query("soft_dice_loss", IMAGES_SQL + """, q AS (SELECT vec_id, c, 1 / (1 + exp(-p)) AS p, t FROM px), s AS (SELECT vec_id, c, (2 * sum(p * t)) / greatest(sum(p) + sum(t), 1e-7) AS s FROM q GROUP BY ALL)
SELECT c::INT AS class_id, round(avg(1 - s), 6) AS loss, round(avg(-ln(greatest(s, 1e-7))), 6) AS log_loss FROM s GROUP BY ALL""")
def soft_dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.soft_dice(metrics.channels(embedding_images(spark, sf_dir), "binary", None, from_logits=True), smooth=0.0, square=False)
    return scores.groupBy("class_id").agg(F.round(F.avg(metrics.soft_dice_loss("score")), 6).alias("loss"), F.round(F.avg(metrics.soft_dice_loss("score", log=True)), 6).alias("log_loss"))


@query("dice_binary_labels", """SELECT lang, count(*) AS n, round(2 * sum(quality * toxic) / greatest(sum(quality) + sum(toxic), 1e-7), 6) AS dice FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def dice_binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    down = F.greatest((F.sum("quality") + F.sum("toxic")).cast("double"), F.lit(metrics.EPS))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.round(2 * F.sum(F.col("quality") * F.col("toxic")) / down, 6).alias("dice"))


@query("hd95", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1] > 0.1 AS lit FROM e),
a AS (SELECT vec_id AS id, y, x FROM p WHERE lit), s AS (SELECT * FROM a WHERE (SELECT count(*) FROM a b WHERE b.id = a.id AND abs(b.y - a.y) + abs(b.x - a.x) = 1) < 4),
ids AS (SELECT vec_id AS id FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)),
d1 AS (SELECT u.id, u.y, u.x, min(sqrt((u.y - v.y) ** 2 + (u.x - v.x) ** 2)) AS d FROM s u JOIN s v ON v.id = u.id + 1 GROUP BY ALL),
d2 AS (SELECT v.id - 1 AS id, v.y, v.x, min(sqrt((u.y - v.y) ** 2 + (u.x - v.x) ** 2)) AS d FROM s v JOIN s u ON u.id = v.id - 1 GROUP BY ALL),
q AS (SELECT id, max(q) AS h FROM (SELECT id, quantile_cont(d, 0.95) AS q FROM d1 GROUP BY ALL UNION ALL SELECT id, quantile_cont(d, 0.95) FROM d2 GROUP BY ALL) GROUP BY ALL)
SELECT id AS sample_id, round(CASE WHEN h IS NOT NULL THEN h WHEN id IN (SELECT id FROM s) OR id + 1 IN (SELECT id FROM s) THEN sqrt(98) ELSE 0 END, 6) AS score FROM ids LEFT JOIN q USING (id)""")
def hd95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface distance of each embedding, as an 8 x 8 mask, to the next one's."""
    mask = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, 1.0).otherwise(0.0))
    e = table(spark, sf_dir, "embeddings").select("vec_id", mask.alias("m"))
    pairs = e.select(F.col("vec_id").alias("sample_id"), F.col("m").alias("p")).join(e.select((F.col("vec_id") - 1).alias("sample_id"), F.col("m").alias("t")), "sample_id")
    return metrics.hd95(pairs.select("sample_id", F.lit(0).alias("class_id"), "p", "t", F.lit(8).alias("width"))).select("sample_id", F.round("score", 6).alias("score"))


_SIDE = 256


@query("hd95_images", f"""WITH o AS (SELECT o_orderkey // {_SIDE * _SIDE} AS image, o_orderkey % {_SIDE * _SIDE} AS px, o_totalprice AS v FROM orders),
m AS (SELECT image, px // {_SIDE} AS y, px % {_SIDE} AS x, v > 485000 AS p FROM o WHERE v > 485000 OR v < 15000),
s AS (SELECT * FROM m WHERE (SELECT count(*) FROM m b WHERE b.image = m.image AND b.p = m.p AND abs(b.y - m.y) + abs(b.x - m.x) = 1) < 4),
d AS (SELECT u.image, u.p, u.y, u.x, min(sqrt((u.y - v.y) ** 2 + (u.x - v.x) ** 2)) AS d FROM s u JOIN s v ON v.image = u.image AND v.p <> u.p GROUP BY ALL),
q AS (SELECT image, p, quantile_cont(d, 0.95) AS q FROM d GROUP BY ALL), n AS (SELECT image, count(DISTINCT p) AS n FROM m GROUP BY ALL)
SELECT image AS sample_id, round(coalesce(max(q), CASE WHEN max(n.n) = 1 THEN sqrt(2.0 * {(_SIDE - 1) ** 2}) ELSE 0 END), 6) AS score FROM (SELECT DISTINCT image FROM o) LEFT JOIN q USING (image) LEFT JOIN n USING (image) GROUP BY ALL""")
def hd95_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface distance on images of real size: 65,536 order keys each, the dearest orders against the cheapest."""
    pixel = (F.col("o_orderkey") % (_SIDE * _SIDE)).cast("int")
    price = F.col("o_totalprice")
    places = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / (_SIDE * _SIDE)).alias("sample_id")).agg(F.collect_list(F.when(price > 485000, pixel)).alias("p"), F.collect_list(F.when(price < 15000, pixel)).alias("t"))
    masks = places.select("sample_id", F.lit(0).alias("class_id"), *(raster.from_places(c, F.lit(_SIDE * _SIDE)).alias(c) for c in "pt"), F.lit(_SIDE).alias("width"))
    return metrics.hd95(masks).select("sample_id", F.round("score", 6).alias("score"))


@query("bce_loss", IMAGES_SQL + """, l AS (SELECT vec_id, c, avg(greatest(p, 0) - p * t + ln(1 + exp(-abs(p)))) AS loss, sum(t) AS amount FROM px GROUP BY ALL),
k AS (SELECT *, CASE WHEN amount > 0 OR c = 3 THEN 1.0 ELSE 0.0 END AS k0, max(CASE WHEN c > 0 THEN amount END) OVER (PARTITION BY vec_id) AS fg FROM l),
j AS (SELECT *, CASE WHEN c = 0 AND fg > 0 THEN 0.0 ELSE k0 END AS keep FROM k)
SELECT c::INT AS class_id, round(sum(loss * keep) / greatest(sum(keep), 1), 6) AS loss FROM j GROUP BY ALL""")
def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary cross-entropy of logits; empty channels count only for known negatives, background only without foreground."""
    images = metrics.channels(embedding_images(spark, sf_dir), "binary", None)
    kept = metrics.channel_keep(images, ignore_empty=True, known_negatives=[3], ignore_background=True)
    losses = kept.select("class_id", "keep", metrics.reduce_pixels(metrics.bce("p", "t")).alias("loss"))
    return metrics.reduce_kept(losses, ["class_id"]).withColumn("loss", F.round("loss", 6))


@query("categorical_loss", IMAGES_SQL + """, z AS (SELECT vec_id, i, ln(sum(exp(p))) AS z FROM px GROUP BY ALL),
l AS (SELECT vec_id, i, CASE WHEN max(CASE WHEN c = 0 THEN t END) > 0 THEN 0 ELSE sum(-t * (p - z) * (1 + c * 0.5)) END AS loss FROM px JOIN z USING (vec_id, i) GROUP BY ALL)
SELECT vec_id AS sample_id, round(avg(loss), 5) AS loss FROM l GROUP BY ALL""")
def categorical_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy over four classes with weights, pixels of class 0 ignored."""
    out = metrics.categorical_cross_entropy(embedding_images(spark, sf_dir), True, [1.0, 1.5, 2.0, 2.5], 0)
    return out.select("sample_id", F.round(metrics.reduce_pixels("loss"), 5).alias("loss"))


@query("pixel_weighted_loss", IMAGES_SQL + """, l AS (SELECT vec_id, c, greatest(p, 0) - p * t + ln(1 + exp(-abs(p))) AS l, i / 16.0 AS w FROM px)
SELECT vec_id AS sample_id, c::INT AS class_id, round(sum(l * w) / greatest(sum(w), 1), 6) AS loss FROM l GROUP BY ALL""")
def pixel_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = metrics.channels(embedding_images(spark, sf_dir), "binary", None)
    weights = F.transform("p", lambda x, i: i / 16.0)
    return images.select("sample_id", "class_id", F.round(metrics.reduce_pixels(metrics.bce("p", "t"), weights), 6).alias("loss"))


@query("area_filtered_dice", _HARD + " SELECT vec_id AS sample_id, round(avg(score), 6) AS score FROM s WHERE c > 0 AND amount > 0 AND amount / 16 >= 0.5 GROUP BY ALL")
def area_filtered_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.area_filtered(_hard(spark, sf_dir), F.lit(16), 0.5).withColumn("score", F.round("score", 6))


@query("eligible_images", IMAGES_SQL + " SELECT count(*) AS n FROM (SELECT vec_id FROM px GROUP BY ALL HAVING max(t) > 0.5)")
def eligible_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.eligible_count(metrics.channels(embedding_images(spark, sf_dir), "binary", None))


_COMPONENTS_SQL = "c AS (SELECT o_orderkey AS batch, o_orderstatus AS dataset, o_orderpriority AS component, o_totalprice / 1000 AS value FROM orders)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("component"), (F.col("o_totalprice") / 1000).alias("value"))


@query("combined_loss", f"WITH {_COMPONENTS_SQL}, w AS (SELECT * FROM (VALUES ('1-URGENT', 2.0), ('2-HIGH', 0.5)) t(component, weight)) SELECT batch, round(sum(value * weight), 8) AS loss FROM c JOIN w USING (component) GROUP BY ALL")
def combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = rows(spark, [("1-URGENT", 2.0), ("2-HIGH", 0.5)], "component string, weight double")
    return metrics.combined_loss(_components(spark, sf_dir), weights).select("batch", F.round("loss", 8).alias("loss"))


@query("routed_loss", f"""WITH {_COMPONENTS_SQL}, r AS (SELECT * FROM (VALUES ('O', 'open'), ('F', 'done')) t(dataset, active)),
w AS (SELECT * FROM (VALUES ('open', '1-URGENT', 2.0), ('open', '2-HIGH', 1.0), ('done', '1-URGENT', 0.5)) t(profile, component, weight)),
a AS (SELECT batch, active, c.component, value, weight FROM c JOIN r USING (dataset) JOIN w ON profile = active AND w.component = c.component),
l AS (SELECT batch, active, sum(value * weight) AS loss FROM a GROUP BY ALL)
SELECT l.batch, l.active, w.profile, w.component, round(coalesce(a.value, 0), 8) AS value, round(l.loss, 8) AS loss FROM l CROSS JOIN w LEFT JOIN a ON a.batch = l.batch AND a.active = w.profile AND a.component = w.component""")
def routed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = rows(spark, [("O", "open"), ("F", "done")], "dataset string, profile string")
    weights = rows(spark, [("open", "1-URGENT", 2.0), ("open", "2-HIGH", 1.0), ("done", "1-URGENT", 0.5)], "profile string, component string, weight double")
    return metrics.routed_loss(_components(spark, sf_dir), routes, weights).withColumns({"value": F.round("value", 8), "loss": F.round("loss", 8)})


@query("routing_issues", "SELECT * FROM (VALUES ('P', 'no route'), ('X', 'inactive dataset'), ('X', 'unknown profile')) t(dataset, issue) WHERE EXISTS (SELECT 1 FROM orders)")
def routing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses as datasets; P has no route, X is routed but no status."""
    datasets = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dataset")).distinct()
    return metrics.routing_issues(datasets, rows(spark, [("O", "open"), ("F", "done"), ("X", "none")], "dataset string, profile string"), rows(spark, [("open",), ("done",)], "profile string"))


@query("phase_metrics", """WITH r AS (SELECT l_returnflag AS dataset, 'discount' AS metric, l_discount AS value, greatest(l_quantity - 10, 0) AS weight FROM lineitem UNION ALL SELECT l_returnflag, 'tax', l_tax, greatest(l_quantity - 10, 0) FROM lineitem)
SELECT CASE WHEN grouping(dataset) = 1 THEN metric ELSE dataset || '/' || metric END AS key, metric, round(sum(value * weight) / sum(weight), 6) AS value FROM r WHERE weight <> 0 GROUP BY GROUPING SETS ((metric), (dataset, metric))""")
def phase_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount and tax as metrics of return flags, weighted by quantity above 10 (none: weight 0)."""
    facts = table(spark, sf_dir, "lineitem")
    pair = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (("discount", "l_discount"), ("tax", "l_tax")))))
    records = facts.select(F.col("l_returnflag").alias("dataset"), F.greatest(F.col("l_quantity") - 10, F.lit(0.0)).alias("weight"), pair.alias("m")).select("dataset", "weight", "m.metric", "m.value")
    return reporting.phase_means(records).withColumn("value", F.round("value", 6))


_EVAL_SQL = "i AS (SELECT l_linestatus AS eval_set, l_returnflag AS dataset, l_discount AS score, l_quantity > 25 AS eligible FROM lineitem), d AS (SELECT eval_set, dataset, coalesce(avg(score) FILTER (eligible), 0) AS dice FROM i GROUP BY ALL)"


def _evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return reporting.evaluation_means(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("eval_set"), F.col("l_returnflag").alias("dataset"), F.col("l_discount").alias("score"), (F.col("l_quantity") > 25).alias("eligible")))


@query("evalset_dataset", f"WITH {_EVAL_SQL} SELECT eval_set, dataset, round(dice, 6) AS dice FROM d")
def evalset_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir)[0].withColumn("dice", F.round("dice", 6))


@query("evalset_macro", f"WITH {_EVAL_SQL} SELECT eval_set, round(avg(dice), 6) AS dice FROM d GROUP BY ALL")
def evalset_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir)[1].withColumn("dice", F.round("dice", 6))


@query("metrics_pivot", """WITH r AS (SELECT year(l_shipdate) AS epoch, CASE WHEN l_returnflag = 'N' THEN 'train' ELSE 'val/' || l_returnflag END AS label, l_discount AS d, l_tax AS t, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS e FROM lineitem),
u AS (SELECT epoch, label, 'discount' AS metric, max(pos) AS p FROM r GROUP BY ALL)
SELECT epoch::BIGINT AS epoch, metric, max(p) FILTER (label = 'train') AS train, max(p) FILTER (label = 'val/A') AS "val/A", max(p) FILTER (label = 'val/R') AS "val/R" FROM u GROUP BY ALL""")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each year and phase as a column; its value is its place, so ties don't matter."""
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    flag = F.col("l_returnflag")
    records = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("epoch"), F.when(flag == "N", "train").otherwise("val").alias("phase"), F.when(flag == "N", "").otherwise(flag).alias("dataset"), F.lit("discount").alias("metric"), pos.alias("value"), pos.alias("pos"))
    return reporting.metrics_table(records, ["train", "val/A", "val/R"])


@query("metric_order", "SELECT event_type AS metric, min(event_id) AS first FROM events GROUP BY ALL")
def metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.metric_order(table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("pos")))


@query("progress_batches", "WITH b AS (SELECT o_orderkey AS idx, o_orderkey = max(o_orderkey) OVER () AS is_last FROM orders) SELECT idx FROM b WHERE idx = 0 OR (idx + 1) % 37 = 0 OR is_last")
def progress_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    last = orders.agg(F.max("idx").alias("_last"))
    return orders.join(F.broadcast(last)).withColumn("is_last", F.col("idx") == F.col("_last")).where(reporting.every_nth(37)).select("idx")  # one row


@query("moving_average", """WITH v AS (SELECT event_type AS name, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id > 100 AND event_id % 2 = 0)
SELECT name, max(step) AS step, round(sum(value * power(0.99::DOUBLE, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.01 END), 6) AS shadow FROM v GROUP BY ALL""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last shadow value of each event type, updated at even ids above 100."""
    values = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")
    shadow = reporting.moving_average(values, 0.99, 100, 2)
    return shadow.groupBy("name").agg(F.max("step").alias("step"), F.round(F.max_by("shadow", "step"), 6).alias("shadow"))


@query("label_stats", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings), p AS (SELECT vec_id AS image, (i // 16) AS label, (i % 16) // 4 AS y, i % 4 AS x, 1 / (1 + exp(-embedding[i + 1]::DOUBLE)) AS p FROM e)
SELECT image, label::INT AS label, count(*) FILTER (p >= 0.5) AS pixel_count, round(count(*) FILTER (p >= 0.5) / count(*), 6) AS pixel_fraction, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p FROM p WHERE y >= 1 AND y < 3 AND x >= 0 AND x < 4 GROUP BY ALL""")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of 4 x 4 pixels, statistics inside rows 1 and 2."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    pixels = e.select("image", F.floor(F.col("i") / 16).cast("int").alias("label"), F.floor((F.col("i") % 16) / 4).alias("y"), (F.col("i") % 4).alias("x"), (1 / (1 + F.exp(-F.col("v").cast("double")))).alias("p"))
    out = reporting.label_statistics(pixels.withColumns({"y0": F.lit(1), "x0": F.lit(0), "y1": F.lit(3), "x1": F.lit(4)}))
    return out.select("image", "label", "pixel_count", *(F.round(c, 6).alias(c) for c in ("pixel_fraction", "mean_p", "max_p")))


@query("centroids", """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS q, embedding FROM embeddings), v AS (SELECT vec_id AS sample_id, CASE WHEN embedding[q + 1] > 0.1 THEN 2 WHEN embedding[q + 1] > 0 THEN 1 ELSE 0 END AS label, q // 16 AS i, q // 4 % 4 AS j, q % 4 AS k FROM e)
SELECT sample_id, label::INT AS label, round(avg(i), 6) AS i, round(avg(j), 6) AS j, round(avg(k), 6) AS k, count(*) AS n FROM v WHERE label > 0 GROUP BY ALL""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as volumes of 4 x 4 x 4 with two labels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("q", "x"))
    label = F.when(F.col("x") > 0.1, 2).when(F.col("x") > 0, 1).otherwise(0)
    voxels = e.select("sample_id", label.alias("label"), F.floor(F.col("q") / 16).alias("i"), (F.floor(F.col("q") / 4) % 4).alias("j"), (F.col("q") % 4).alias("k"))
    return reporting.centroids(voxels).withColumns({c: F.round(c, 6) for c in "ijk"})
