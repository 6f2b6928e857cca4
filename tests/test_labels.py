"""Label spaces on literal cases."""

import pytest
from pyspark.sql import functions as F

from maskframe.operators import labels


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def hips(spark):
    stored = frame(spark, [("H", 0, "background"), ("H", 1, "hip_left"), ("H", 2, "hip_right"), ("H", 3, "femurs"), ("H", 5, "implant")], "dataset string, native_id int, native_label string")
    aliases = frame(spark, [("H", "hip_left", "hips"), ("H", "hip_right", "hips")], "dataset string, native_label string, label string")
    drops = frame(spark, [("H", "implant")], "dataset string, native_label string")
    protocol = frame(spark, [(0, "background"), (11, "femurs"), (54, "hips")], "channel int, label string")
    return stored, aliases, drops, protocol


def test_explain_and_lut(spark, hips):
    explained = labels.explain_labels(*hips)
    assert [tuple(r) for r in explained.orderBy("native_id").select("rule", "channel").collect()] == [("background", 0), ("alias", 54), ("alias", 54), ("identity", 11), ("drop", 0)]
    assert labels.compile_luts(explained).first()["lut"] == [0, 54, 54, 11, -1, 0]


def test_unknown_label_raises(spark, hips):
    stored, aliases, drops, protocol = hips
    with pytest.raises(Exception, match="label not in protocol"):
        labels.compile_luts(labels.explain_labels(stored, aliases, drops, protocol.where("label <> 'femurs'"))).collect()


def test_projection(spark):
    df = frame(spark, [([0, 1, 2, 0], [0, 2, 1])], "l array<int>, lut array<int>")
    got = df.select(labels.project_labels("l", "lut", 3).alias("c")).first()["c"]
    assert got == [[1, 0, 0, 1], [0, 0, 1, 0], [0, 1, 0, 0]]
    for bad in ([99], [-1]):
        with pytest.raises(Exception, match="without a mapping"):
            frame(spark, [(bad, [0, 1])], "l array<int>, lut array<int>").select(labels.apply_lut("l", "lut")).collect()
    assert frame(spark, [([9, 1], [0, 1])], "l array<int>, lut array<int>").select(labels.apply_lut("l", "lut", "background")).first()[0] == [0, 1]


def test_channels_merge_by_maximum(spark):
    channels = frame(spark, [("s", "distal", [0.4, 0.0, 0.0, 0.0]), ("s", "intermediate", [0.9, 0.0, 0.0, 0.0]), ("s", "proximal", [0.0, 0.0, 0.0, 1.0]), ("s", "other", [1.0] * 4)], "sample_id string, label string, data array<double>")
    names = frame(spark, [(n, "phalanges") for n in ("distal", "intermediate", "proximal")], "label string, target_label string")
    got = labels.project_channels(channels, names, frame(spark, [(1, "phalanges")], "channel int, label string")).collect()
    assert [tuple(r) for r in got] == [("s", 1, [0.9, 0.0, 0.0, 1.0])]


def test_first_supported_candidate(spark):
    rows = [("E", "spine", 0, 0, "cervicothoracic_spine", 0), ("E", "spine", 1, 0, "c1", 0), ("E", "spine", 1, 1, "c2", 0)]
    candidates = frame(spark, rows, "eval_set string, eval_label string, cand_idx int, pos int, model_label string, listed int")
    model = frame(spark, [(0, "background"), (1, "c1"), (2, "c2")], "model_id int, label string")
    got = labels.select_candidates(candidates, model).first()
    assert (got["cand_idx"], got["model_labels"], got["model_ids"], got["unsupported_zero"]) == (1, ["c1", "c2"], [1, 2], False)
    only = frame(spark, [("c1",)], "label string")
    assert labels.select_candidates(candidates, model, only, "drop").count() == 0
    assert labels.select_candidates(candidates, model, only, "zero").first()["unsupported_zero"] is True
    with pytest.raises(Exception, match="no supported candidate"):
        labels.select_candidates(candidates, model, only).collect()
    own = frame(spark, [("c1", 1), ("c2", 2), ("rib", 3)], "label string, pos int")
    assert [tuple(r) for r in labels.identity_defaults(own, candidates, model).collect()] == [(1, "spine", True)]
    strict = labels.identity_defaults(own, candidates, model, strict=True).orderBy("pos").collect()
    assert [tuple(r) for r in strict] == [(1, "spine", True), (3, "rib", False)]


def test_aliases_of_datasets(spark):
    got = labels.resolve_datasets(frame(spark, [("x",), ("y",)], "dataset string"), frame(spark, [("x", "X")], "alias string, canonical string")).orderBy("dataset").select("canonical")
    assert [r[0] for r in got.collect()] == ["X", "y"]


def test_rule_violations(spark, hips):
    stored, aliases, drops, _ = hips
    issues = {r["issue"] for r in labels.rule_violations(stored, aliases, drops, frame(spark, [("H", "hips")], "dataset string, label string")).collect()}
    assert issues == {"stored ids are not 0, 1, 2, ...", "known negative is stored"}
    assert labels.supervised_ids(labels.explain_labels(*hips)).agg(F.count("*")).first()[0] == 3
