"""Importance resampling towards a target distribution, over hashed n-grams, in two Arrow passes.

1. Every partition counts the buckets of all its features with ``np.bincount`` and gives one vector
   of ``BUCKETS`` counts; ``treeReduce`` adds the vectors, for the documents and for the target.
2. The gains of the buckets (scaled log ratios of the two smoothed distributions) are broadcast;
   a document's gains are gathered and summed by ``np.bincount`` with weights.

A Gumbel draw on top of the weight makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.llm import textblocks as tb
from maskframe.llm.common import cut, documents, map_arrow, map_batches

BUCKETS = 10_000
GRAMS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Spans over so many bytes are checksummed one by one.
_LONG = 64

WORD = tb.table(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_TABLE = _crc_table()


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of bytes, byte by byte for all spans at once."""
    size = ends - starts
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[np.count_nonzero(size > _LONG) :]
    ascending = size[order][::-1]
    for k in range(int(size[order].max(initial=0))):
        on = order[: len(order) - np.searchsorted(ascending, k, "right")]
        now = crc[on]
        crc[on] = _TABLE[(now ^ data[starts[on] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    crc = ~crc
    for k in np.flatnonzero(size > _LONG):
        crc[k] = zlib.crc32(data[starts[k] : ends[k]])
    return crc


def features(block: tb.Block, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every run of 1 to ``grams`` words of a block, and each document's number of words."""
    data = tb.fold_case(block.data)
    w = tb.words(block._replace(data=data), WORD)
    starts, ends = w.starts, w.ends
    if grams > 1:  # the words again, one space between them: a run is a span
        size = ends - starts + 1
        at = np.cumsum(size) - size
        joined = np.full(int(size.sum()), 32, np.uint8)
        of = np.repeat(np.arange(len(size)), size - 1)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        joined[at[of] + inner] = data[starts[of] + inner]
        data, starts, ends = joined, at, at + size - 1
    bucket, doc = [], []
    for g in range(1, grams + 1):
        n = max(0, len(starts) - g + 1)
        first = np.flatnonzero(w.doc[:n] == w.doc[g - 1 : g - 1 + n])
        bucket.append(span_crc32(data, starts[first], ends[first + g - 1]) % np.uint32(buckets))
        doc.append(w.doc[first])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(doc), w.counts()


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: a vector from each partition, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                total += np.bincount(features(block, grams, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    sc = docs.sparkSession.sparkContext
    vectors = map_batches(docs.select("text"), run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.union(sc.parallelize([np.zeros(buckets, np.int64)], 1)).treeReduce(np.add)


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of both distributions in each bucket, with one added to every count."""
    s, t, n = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight (floored mean gain, 0 without features) and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = batch.column("h").to_numpy(zero_copy_only=False)
        for block in tb.blocks(batch.column("text")):
            bucket, doc, words = features(block, grams, len(sent.value))
            n = np.bincount(doc, minlength=len(words))
            total = np.bincount(doc, weights=sent.value[bucket], minlength=len(words)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            gumbel = np.floor(-1000 * np.log(-np.log((h[block.lo : block.hi] + 0.5) / 4294967296)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id")[block.lo : block.hi], "n_features": pa.array(n, pa.int64()), "n_words": pa.array(words, pa.int64()),
                "weight": pa.array(weight, pa.int64()), "score": pa.array(weight + gumbel.astype(np.int64), pa.int64()),
            })

    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h")
    return map_arrow(docs.select(doc_id.alias("doc_id"), "text", h), run, "doc_id long, n_features long, n_words long, weight long, score long")


def drawn_ranks(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... by falling score of the drawn rows, null for the others.

    Of the N rows with ``min_words`` words floor(percent N / 100) are drawn, ties to smaller doc_id.
    The driver gets one number for each whole score, of which there are some ten thousand at any
    size of the table (Gumbel draws span 26,000 and gains grow with the logarithm of the counts);
    rows are numbered within their score, and the density of the draws puts under one in 2,000 of
    distinct ids on a score.
    """
    spark = scored.sparkSession
    fits = F.col("n_words") >= min_words
    found = scored.where(fits).groupBy("score").count().collect()
    score, n = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)
    draws = int(n.sum()) * percent // 100
    order = np.argsort(-score)
    before = np.cumsum(n[order]) - n[order]
    offsets = spark.createDataFrame([(int(s), int(b)) for s, b in zip(score[order], before) if b < draws], "score long, before long")
    placed = scored.join(F.broadcast(offsets), "score", "left").withColumn("before", F.when(fits, F.col("before")))
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    rank = placed.where("before IS NOT NULL").withColumn("rank", F.col("before") + within)
    columns = [*scored.columns, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank")]
    return rank.select(*columns).unionByName(placed.where("before IS NULL").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its weight towards ``target`` and its place in the draw.

    Returns doc_id, n_features, n_words, weight, score and rank (null: not drawn).  Words are runs
    of letters and digits with A-Z lower-cased; features all runs of 1 to ``grams`` words, hashed
    to ``buckets`` by CRC-32.  Counts are over all rows and whole texts of ``docs`` and of
    ``target`` (column text).  A null or empty text has no features and weight 0; an empty target
    counts as one without features, an empty table gives no rows.  Draws are SHA-256 of the seed
    and the doc_id (null: as an empty one), so repeated rows tie and take successive ranks.  Other
    columns are not looked at.
    """
    gains = bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    return drawn_ranks(cut(weighted(docs, gains, grams, seed)), percent, min_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH RECURSIVE c(i, v, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
crc AS (SELECT i, v FROM c WHERE k = 8),
a AS (SELECT row_number() OVER () AS row, doc_id, text, 's' AS side FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 't' FROM benchmark),
w AS (SELECT row, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM a),
f AS (SELECT row, side, word, count(*) AS n FROM w GROUP BY ALL),
x(word, hex, v) AS (SELECT word, hex(word), 4294967295::BIGINT FROM (SELECT DISTINCT word FROM f)
  UNION ALL SELECT word, hex[3:], xor(crc.v, x.v >> 8) FROM x JOIN crc ON crc.i = xor(x.v, 16 * (instr('0123456789ABCDEF', hex[1]) - 1) + instr('0123456789ABCDEF', hex[2]) - 1) & 255 WHERE hex <> ''),
b AS (SELECT word, xor(v, 4294967295) % {BUCKETS} AS bucket FROM x WHERE hex = ''),
k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM k),
d AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE side = 's' GROUP BY row),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM a LEFT JOIN d USING (row) WHERE side = 's'),
o AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
p AS (SELECT *, CASE WHEN n_features >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () * {PERCENT} // 100 AS draws FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draws THEN place END AS rank FROM p
"""
