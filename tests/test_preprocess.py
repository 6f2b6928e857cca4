"""From images to canvases and back."""

import numpy as np
import pytest

from maskframe.functions import kernels
from maskframe.operators import preprocess

RNG = np.random.default_rng(6)


def plain_weights(how, n_in, n_out):
    """The whole matrix, weight by weight."""
    out = np.zeros((n_out, n_in))
    scale = n_in / n_out
    for i in range(n_out):
        if how == "nearest":
            out[i, i * n_in // n_out] = 1
            continue
        for x in range(n_in):
            away = (x + 0.5 - (i + 0.5) * scale) / max(scale, 1)
            out[i, x] = max(0, 1 - abs(away)) if how == "bilinear" else -0.5 < away <= 0.5
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("how", ["area", "bilinear", "nearest"])
def test_bands_are_the_whole_matrix(how):
    for n_in, n_out in [(1, 1), (1, 5), (5, 1), (7, 3), (3, 7), (8, 4), (9, 10), (64, 64), (100, 31)]:
        image = RNG.random((n_in, 4))
        assert kernels.bands(how, n_in, n_out).along_rows(image) == pytest.approx(plain_weights(how, n_in, n_out) @ image)
        for before in range(0, n_in, 2):
            for content in {1, n_in - before, max(1, (n_in - before) // 2)}:
                part = RNG.random((content, 3))
                padded = np.zeros((n_in, 3))
                padded[before : before + content] = part
                assert kernels.bands(how, n_in, n_out, before, content).along_rows(part) == pytest.approx(plain_weights(how, n_in, n_out) @ padded)


IMAGES = "id int, data array<double>, height int, width int, source_dtype string, label array<double>"


def frame(spark, *images, dtype="float32"):
    return spark.createDataFrame([(k, a.ravel().astype(float).tolist(), *a.shape, dtype, (a > 0.5).ravel().astype(float).tolist()) for k, a in enumerate(images)], IMAGES)


def pad(a):
    side = max(a.shape)
    top, left = (side - a.shape[0]) // 2, (side - a.shape[1]) // 2
    out = np.zeros((side, side))
    out[top : top + a.shape[0], left : left + a.shape[1]] = a
    return out


def test_inference_chain_and_back(spark):
    images = [RNG.random((13, 20)), RNG.random((31, 6)), RNG.random((8, 8)), RNG.random((1, 40))]
    chain = preprocess.InferencePreprocessing.from_metadata({"image_size": [16, 12]})
    df = chain.prepare(frame(spark, *images)).withColumn("back", preprocess.to_image("canvas", "geometry", "bilinear")).withColumn("near", preprocess.to_image("canvas", "geometry"))
    for r in df.collect():
        a = images[r["id"]]
        side = max(a.shape)
        want = plain_weights("bilinear", side, 16) @ pad(a) @ plain_weights("bilinear", side, 12).T
        assert r["canvas"] == pytest.approx(want.ravel())
        g = r["geometry"]
        top, left = (side - a.shape[0]) // 2, (side - a.shape[1]) // 2
        assert (g["original_shape"], g["pad_before"], g["pad_after"], g["padded_shape"], g["processed_shape"]) == (list(a.shape), [top, left], [side - a.shape[0] - top, side - a.shape[1] - left], [side, side], [16, 12])
        assert g["resize_scale"] == pytest.approx([16 / side, 12 / side])
        back = (plain_weights("bilinear", 16, side) @ want @ plain_weights("bilinear", 12, side).T)[top : top + a.shape[0], left : left + a.shape[1]]
        assert r["back"] == pytest.approx(back.ravel())
        near = [want[int((y + top + 0.5) * 16 / side), int((x + left + 0.5) * 12 / side)] for y in range(a.shape[0]) for x in range(a.shape[1])]
        assert r["near"] == pytest.approx(near)


def test_masks_come_back_whole(spark):
    """On a canvas that is larger than the image no label is lost."""
    images = [RNG.random((13, 20)), RNG.random((31, 6))]
    df = frame(spark, *images).withColumn("geometry", preprocess.geometry("height", "width", True, (64, 64)))
    df = df.withColumn("canvas", preprocess.to_canvas("label", "geometry", "nearest")).withColumn("back", preprocess.to_image("canvas", "geometry"))
    for r in df.collect():
        assert set(r["canvas"]) <= {0, 1} and r["back"] == r["label"]


def test_normalisation_of_the_canvas(spark):
    image = RNG.integers(0, 60000, (10, 10)).astype(float)
    one = lambda meta, **k: np.array(preprocess.InferencePreprocessing.from_metadata({"image_size": [10, 10], "pad_to_square": False} | meta).prepare(frame(spark, image, **k)).first()["canvas"])
    x = image.ravel() / 65535
    assert one({}, dtype="uint16") == pytest.approx(x) and one({"scale": "none"}, dtype="uint16") == pytest.approx(image.ravel())
    assert one({"mean": 0.5, "std": 2}, dtype="uint16") == pytest.approx((x - 0.5) / 2)
    assert one({"normalization": {"scheme": "standardize"}}, dtype="uint16") == pytest.approx((x - x.mean()) / (x.std(ddof=1) + 1e-8))
    low, high = np.percentile(x, [1, 99])
    assert one({"normalization": {"scheme": "percentile_minmax", "percentiles": [1, 99]}}, dtype="uint16") == pytest.approx((np.clip(x, low, high) - low) / (high - low))
    bad = image.copy()
    bad[0, :3] = np.nan, np.inf, -np.inf
    got = np.array(preprocess.InferencePreprocessing((10, 10), False).prepare(frame(spark, bad)).first()["canvas"])
    assert (got[:3] == 0).all() and (got[3:] == bad.ravel()[3:]).all()


def test_packaging_chain(spark):
    ramp = np.tile(np.linspace(10, 200, 64), (40, 1)).T.reshape(64, 40).T
    mask = np.zeros((40, 64))
    mask[5:20, 10:30], mask[25:35, 40:60] = 1, 2
    df = spark.createDataFrame([(ramp.ravel().tolist(), mask.ravel().tolist(), [mask.ravel().tolist(), (2 - mask).ravel().tolist()], 40, 64)], "image array<double>, label array<double>, masks array<array<double>>, height int, width int")
    chain = preprocess.PackagePreprocessing.from_manifest({"pad_to_square": True, "output_size": [32, 32]})
    r = chain.apply(df).first()
    g, image, label = r["geometry"], np.array(r["image"]).reshape(32, 32), np.array(r["label"]).reshape(32, 32)
    assert (g["original_shape"], g["pad_before"], g["pad_after"], g["padded_shape"], g["processed_shape"], g["resize_scale"]) == ([40, 64], [12, 0], [12, 0], [64, 64], [32, 32], [0.5, 0.5])
    assert image.min() == 0 and image[0].max() == 0 and set(label.ravel()) == {0, 1, 2} and (label == pad(mask)[::2, ::2]).all()
    scaled = pad((ramp - 10) / 190)
    assert image == pytest.approx(scaled.reshape(32, 2, 32, 2).mean(axis=(1, 3)))
    channels = np.array(chain.apply(df, label="masks").first()["masks"]).reshape(2, 32, 32)
    assert (channels[0] == label).all() and (channels[1] == pad(2 - mask)[::2, ::2]).all()
    plain = preprocess.PackagePreprocessing.from_manifest({"intensity": "dtype_range"}).apply(df).first()
    assert plain["image"] == ramp.ravel().tolist() and plain["label"] == mask.ravel().tolist() and plain["geometry"]["processed_shape"] == [40, 64]
    padded = preprocess.PackagePreprocessing("dtype_range", True).apply(df).first()
    assert padded["image"] == pad(ramp).ravel().tolist() and chain.to_attrs() == {"intensity": "per_image_minmax", "pad_to_square": True, "output_size": [32, 32]}


@pytest.mark.parametrize("metadata", [{"image_size": [0, 4]}, {"image_size": [True, 4]}, {"color_mode": "rgb"}, {"scale": "x"}, {"std": 0}, {"normalization": {"scheme": "odd"}}, {"normalization": {"scheme": "percentile_minmax"}}, {"normalization": {"scheme": "minmax", "percentiles": [1, 2]}}, {"normalization": {"scheme": "minmax"}, "mean": 1}, {"normalization": {"scheme": "minmax", "x": 1}}])
def test_refused_metadata(metadata):
    with pytest.raises(ValueError):
        preprocess.InferencePreprocessing.from_metadata(metadata)


def test_metadata_round_trip():
    for data in (None, {"size": [8, 9]}, {"mean": 1, "std": 2}, {"normalization": {"mean": 0.5}}, {"normalization": {"scheme": "percentile_minmax", "percentiles": [0.5, 99.5]}}, {"normalization": {"scheme": "none"}, "mean": 3}):
        chain = preprocess.InferencePreprocessing.from_metadata(data)
        assert preprocess.InferencePreprocessing.from_metadata(chain.to_metadata()) == chain
    for block in ({"intensity": "x"}, {"pad_to_square": 1}, {"output_size": [1]}, {"other": 1}):
        with pytest.raises(ValueError):
            preprocess.PackagePreprocessing.from_manifest(block)
