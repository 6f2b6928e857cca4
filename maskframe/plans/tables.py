"""Driver tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.arrays import doubles

BLOCKS = 4
BLOCK = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of four channels of 16 pixels; the target is where the mean of the label's vectors is positive."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("e"))
    means = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    targets = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("m") > 0, 1.0).otherwise(0.0).alias("t")))), lambda s: s["t"]).alias("t"))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK)))
    return e.join(targets, "label").select(F.col("vec_id").alias("sample_id"), "label", blocks(F.col("e")).alias("pred"), blocks(F.col("t")).alias("target"))


#: CTEs for DuckDB with the same rows, one a pixel: px(vec_id, label, c, i, p, t).
IMAGES_SQL = """
WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS k, embedding FROM embeddings),
v AS (SELECT vec_id, label, k - 1 AS g, embedding[k]::DOUBLE AS p FROM e),
m AS (SELECT label, g, avg(p) AS m FROM v GROUP BY ALL),
px AS (SELECT vec_id, label, g // 16 AS c, g % 16 AS i, g, p, CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END AS t FROM v JOIN m USING (label, g))
"""
