"""Augmentation plans: the same draws wherever a sample lies, and every transform by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import kernels, yamltext
from maskframe.operators import augment

RNG = np.random.default_rng(12)
SETTINGS = yamltext.load("""
RandomHorizontalFlip: {module: kornia.augmentation, p: 0.5}
RandomLabelZoom: {module: own.transforms, zoom_range: [1.1, 4.0], p: 0.5}
RandomLetterDrop: {p: 0.5, min_size: 0.2, max_size: 0.5}
RandomInvert: {p: 0.5}
RandomClaheOrGamma: {clip_limit: [1.0, 2.0], gamma: [0.9, 1.1], gain: [0.9, 1.1], clahe_prob: 0.3, gamma_prob: 0.4}
RandomContrast: {contrast: [0.7, 1.3], p: 0.5}
RandomGaussianNoise: {std: 0.01, p: 0.5}
RandomIntensityScale: {factors: 0.2, prob: 0.5}
RandomAspectCrop: {height_range: [8, 16], width_range: [8, 20], p: 0.5}
""")


def samples(n=12, h=16, w=20):
    out = []
    for k in range(n):
        t = np.zeros((3, h, w))
        t[1, 3:7, 4:9] = 1
        t[2, 10 : 10 + k % 4, 2:5] = 1
        t[0] = 1 - t[1:].max(axis=0)
        out.append((f"s{k}", RNG.random(h * w).tolist(), t.reshape(3, -1).tolist(), h, w))
    return out


SAMPLE = "sample_id string, image array<double>, label array<array<double>>, height int, width int"


def test_same_draws_for_any_partitions(spark):
    df = spark.createDataFrame(samples(), SAMPLE)
    runs = [{r["sample_id"]: (r["draws"], r["image"], r["label"]) for r in augment.augment(df.repartition(n), SETTINGS, 5, ["sample_id"]).collect()} for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    other = {r["sample_id"]: r["image"] for r in augment.augment(df, SETTINGS, 6, ["sample_id"]).collect()}
    epoch = {r["sample_id"]: r["image"] for r in augment.augment(df.withColumn("epoch", F.lit(1)), SETTINGS, 5, ["sample_id", "epoch"]).collect()}
    assert sum(other[k] != v[1] for k, v in runs[0].items()) > 9 and sum(epoch[k] != v[1] for k, v in runs[0].items()) > 9
    for draws, image, label in runs[0].values():
        t = np.array(label)
        assert len(draws) == sum(len(s.draws) for s in augment.plan(SETTINGS)) and len(image) == 320
        assert np.isin(t, (0, 1)).all() and (t[0] == (t[1:].max(axis=0) == 0)).all()


def test_plan_by_hand(spark):
    """The pass over a row is the steps one after the other, with the row's own draws."""
    rows = samples()
    for r in augment.augment(spark.createDataFrame(rows, SAMPLE), SETTINGS, 5, ["sample_id"], harden=False).collect():
        _, image, label, h, w = next(s for s in rows if s[0] == r["sample_id"])
        x, t, at = np.array(image).reshape(h, w), np.array(label).reshape(3, h, w), 0
        for step in augment.plan(SETTINGS):
            x, t = step.apply(x, t, dict(zip(step.draws, r["draws"][at:])))
            at += len(step.draws)
        assert r["image"] == x.ravel().tolist() and np.array(r["label"]).tolist() == t.reshape(3, -1).tolist()
    assert augment.plan(SETTINGS)[0].name == "RandomLabelZoom"


X = RNG.random((14, 21))
LABELS = np.zeros((3, 14, 21))
LABELS[1, 2:5, 12:18] = 1


def on(**draws):
    return {"on": 0.0} | draws


def test_label_zoom():
    zoom = augment.label_zoom((2, 2), 1.0)
    x, t = zoom.apply(X, LABELS, on(channel=0.9, zoom=0.3))
    # centroid (3, 14.5), box of 7 x 10 (21 / 2 rounds to even): rows 0 to 6, columns 10 to 19
    assert x == pytest.approx(kernels.resize(X[0:7, 10:20], 14, 21, "bilinear")) and t[1].sum() == kernels.resize(LABELS[1, 0:7, 10:20], 14, 21, "nearest").sum() > LABELS.sum()
    assert zoom.apply(X, LABELS * 0, on(channel=0, zoom=0))[0] is X and zoom.apply(X, LABELS[:1], on(channel=0, zoom=0))[0] is X
    assert augment.label_zoom(p=0.5, label_ids=[2, 9]).apply(X, LABELS, on(channel=0, zoom=0))[0] is X and augment.label_zoom(p=0.5).apply(X, LABELS, {"on": 0.5})[0] is X


def test_markers():
    drop = augment.letter_drop(1.0, 0.5, 0.5, (0.9, 0.9))
    for letter, u in (("L", 0.2), ("R", 0.7)):
        x, _ = drop.apply(X * 0.5, LABELS, on(letter=u, size=0.5, top=0.999, left=0, intensity=0.4))
        want = np.array([[c == "1" for c in row] for row in augment.GLYPHS[letter]]) * 0.9
        assert (x[7:14, 0:5] == np.maximum(X[7:14, 0:5] * 0.5, want)).all() and (x[:7] == X[:7] * 0.5).all()


def test_others():
    flip = augment.horizontal_flip(0.5)
    assert (flip.apply(X, LABELS, {"on": 0.49})[0] == X[:, ::-1]).all() and (flip.apply(X, LABELS, {"on": 0.49})[1] == LABELS[:, :, ::-1]).all() and flip.apply(X, LABELS, {"on": 0.5})[0] is X
    assert augment.intensity_scale(0.2, 1.0).apply(X, LABELS, on(factor=0.75))[0] == pytest.approx(X * 1.1)
    assert augment.invert(1.0).apply(X, LABELS, on())[0] == pytest.approx(1 - X)
    assert augment.contrast((2, 2), 1.0).apply(X, LABELS, on(factor=0))[0] == pytest.approx(np.clip(2 * X, 0, 1))
    both = augment.clahe_or_gamma((2, 2), (0.5, 0.5), (1.5, 1.5), 0.1, 0.2)
    assert both.apply(X, LABELS, dict(branch=0.05, clip=0, gamma=0, gain=0))[0] == pytest.approx(kernels.equalize_tiles(X, 2.0, (8, 8)))
    assert both.apply(X, LABELS, dict(branch=0.1, clip=0, gamma=0, gain=0))[0] == pytest.approx(np.clip(1.5 * X**0.5, 0, 1)) and both.apply(X, LABELS, dict(branch=0.31, clip=0, gamma=0, gain=0))[0] is X
    noise = augment.gaussian_noise(std=0.1, p=1.0).apply(X, LABELS, on(noise=0.3))[0] - X
    assert 0.07 < noise.std() < 0.13
    crop = augment.aspect_crop([3, 9], [4, 12], 1.0)
    x, t = crop.apply(X, LABELS + 1, on(landscape=0.1, size=0.999))  # 14 rows: 4, 6 or 8
    assert (x[3:11] == X[3:11]).all() and x[:3].sum() == x[11:].sum() == 0 and (t[:, :3] == 0).all()
    x, _ = crop.apply(X, LABELS, on(landscape=0.9, size=0.0))  # 21 columns: 5 and up
    assert (x[:, 8:13] == X[:, 8:13]).all() and x[:, :8].sum() == x[:, 13:].sum() == 0
    with pytest.raises(ValueError, match="no strip"):
        crop.apply(X[:6], LABELS[:, :6], on(landscape=0, size=0))
    soft = LABELS * 0.7
    assert (augment.hardened(soft, soft) == soft).all() and augment.hardened(LABELS, soft)[0].sum() == 14 * 21 - 18


@pytest.mark.parametrize("settings", [{"RandomElasticTransform": {}}, {"RandomInvert": {"q": 1}}, {"RandomInvert": {"p": 2}}, {"RandomLabelZoom": {"zoom_range": [0.5, 2]}}, {"RandomContrast": {"contrast": [2, 1]}}, {"RandomLetterDrop": {"min_size": 0}}, {"RandomClaheOrGamma": {"clahe_prob": 0.8, "gamma_prob": 0.4}}])
def test_refused_settings(settings):
    with pytest.raises(ValueError):
        augment.plan(settings)


def test_nulls_and_no_plan(spark):
    df = spark.createDataFrame([("a", None, None, 2, 2), ("b", [0.1, 0.2, 0.3, 0.4], [], 2, 2)], SAMPLE)
    got = {r["sample_id"]: r for r in augment.augment(df, {"RandomInvert": {"p": 1.0}, "RandomLabelZoom": None}, 1, ["sample_id"]).collect()}
    assert got["a"]["image"] is None and got["b"]["image"] == pytest.approx([0.9, 0.8, 0.7, 0.6]) and got["b"]["label"] == []
    plain = augment.augment(df, None, 1, ["sample_id"]).where("sample_id = 'b'").first()
    assert plain["image"] == [0.1, 0.2, 0.3, 0.4] and plain["draws"] == []
