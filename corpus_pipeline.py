"""A corpus pipeline over ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.bpe_codec import encode_documents
from maskframe.llm.common import checkpoint_folder, documents, remove_folder
from maskframe.llm.decontaminate import without_contaminated
from maskframe.llm.near_join import one_of_each
from maskframe.llm.quality import cleaned
from maskframe.llm.secrets import find_secrets, masked_text
from maskframe.session import ship_package


def _with_length(docs: DataFrame, changed: Column, like: DataFrame) -> DataFrame:
    """The columns of ``like``; where the text has changed n_chars follows."""
    length = lambda c, t: F.when(changed, F.length("text")).otherwise(F.col(c)).cast(t).alias(c)
    return docs.select(*(length(c, t) if c == "n_chars" else F.col(c) for c, t in like.dtypes))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines; n_chars follows."""
    ship_package(spark)
    return _with_length(cleaned(docs), F.col("__cut"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars follows."""
    masked = F.when(F.col("text").isNotNull(), F.col("__masked"))
    found = find_secrets(docs, keep=docs.columns).withColumn("__masked", masked_text("__text"))
    return found.select(*(masked.alias(c) if c == "text" else F.when(masked == F.col("text"), F.col(c)).otherwise(F.coalesce(F.length(masked), F.col(c))).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    ship_package(spark)
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("bpe_codec", encoding),
]

#: Edit distances, class components and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, with Parquet in the shared checkpoint folder between them.

    What a stage wrote is deleted once the next one is written; the last one is read by the result.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
