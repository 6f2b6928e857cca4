"""Importance resampling against plain counting."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskframe.llm import resample, textblocks

ODD = [None, "", " ", "!?", "Word", "Ünï ÇÖDÉ 日本語", "x" * 70_000, "long text " * 9_000, "a\x00b c", "kK", *(" ".join(f"w{k * j % 13}" for j in range(25)) for k in range(30))]


def runs(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + g]) for g in range(1, grams + 1) for i in range(len(words) - g + 1)]


def brute(rows, target, percent, min_words, grams, buckets, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (collections.Counter(bucket(x) for text in side for x in runs(text, grams)[1]) for side in ([t for _, t in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = runs(text, grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in found) // len(found) if found else 0
        out.append([i, len(found), len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[2] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = k
    return [tuple(r) for r in out]


def test_checksums_of_spans():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(4000), np.uint8)
    starts = np.array([rng.randrange(3000) for _ in range(500)])
    ends = starts + [rng.choice([0, 1, 2, 7, 63, 64, 65, 900]) for _ in starts]
    assert resample.span_crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert not len(resample.span_crc32(data, starts[:0], ends[:0]))


def test_runs_of_words():
    texts = ["a b  C", None, "", "one", "x-y z\nq r s"]
    for block in textblocks.blocks(pa.array(texts), 8):
        bucket, doc, words = resample.features(block, 3, 997)
        for d, text in enumerate(texts[block.lo : block.hi]):
            plain, found = runs(text, 3)
            assert sorted(bucket[doc == d]) == sorted(zlib.crc32(x.encode()) % 997 for x in found) and words[d] == len(plain)


@pytest.mark.parametrize(("percent", "min_words", "grams", "buckets"), [(10, 20, 1, 10_000), (50, 1, 2, 64), (100, 0, 3, 500)])
def test_draw_with_odd_rows(spark, percent, min_words, grams, buckets):
    rows = [(k * 3, t) for k, t in enumerate(ODD)]
    rows += [*rows[2:6], *rows[-3:], (None, "no id here " * 10)]
    target = ["w1 w2 w3 w1 w1", None, "Long text w5"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "before", "h", "n_words")}).coalesce(3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(docs, bench, percent, min_words, grams, buckets).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, target, percent, min_words, grams, buckets), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    assert resample.resampled(docs.where("doc_id = 9"), docs).count() == 0
    got = resample.resampled(docs, docs.where("doc_id = 9"), 100, 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute([(1, "a few words"), (2, None)], [], 100, 0, 1, 10_000), key=str)
