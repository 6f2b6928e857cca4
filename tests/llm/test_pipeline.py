"""The corpus pipeline, stage by stage, on a small table."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskframe.llm import bpe_codec, decontaminate, near_join, quality, secrets


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "bpe_codec"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert set(rows(kept)) == {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}

    single = stages["ngram_jaccard_join"](spark, kept, sf_dir)
    classes = {r["doc_id"]: r["class_id"] for r in near_join.jaccard_classes(kept).collect()}
    assert set(rows(single)) == set(classes.values()) and single.columns == docs.columns

    clean = stages["benchmark_decontamination"](spark, single, sf_dir)
    leaks = {r["doc_id"] for r in decontaminate.contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(rows(clean)) == set(rows(single)) - leaks and clean.columns == docs.columns

    masked = stages["secret_scans"](spark, clean, sf_dir)
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(clean).collect()}
    before, after = rows(clean), rows(masked)
    assert masked.columns == docs.columns and set(before) == set(after)
    for i, r in after.items():
        if not spans[i]:
            assert r == before[i]
        else:
            want, shift = before[i]["text"], 0
            merged = []
            for a, b in sorted((int(a), int(b)) for a, b in re.findall(r":(\d+):(\d+)", spans[i])):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                want = want[:a] + "[SECRET]" + want[b:]
            assert r["text"] == want and r["n_chars"] == len(want)
    assert shift == 0

    final = stages["bpe_codec"](spark, masked, sf_dir)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, bpe_codec.encode_documents(masked).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, final.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf_dir, name):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "a row without an id that is long enough to stay here", "en", "s", 50), (3, "x " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(1)).withColumn("__x", F.lit(2))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    assert out.count() <= 6
    if name != "bpe_codec":
        assert out.columns == docs.columns
    assert stage(spark, docs.where("doc_id = 99"), sf_dir).count() == 0
