"""Dispatch of post-processing, masks and ensembles."""

import pytest

from maskframe.operators import postprocess

IMAGES = "dataset string, label_names array<string>, prob array<array<double>>, height int, width int"


def test_dispatch(spark):
    lungs = [[0.7, 0.6, 0.4, 0.2], [0.8, 0.5, 0.51, 0.49]]
    rows = [("MendeleyCXR", ["lungs", "liver"], lungs, 2, 2), ("MendeleyCXR", ["liver", "lungs"], lungs[::-1], 2, 2), ("MendeleyCXR", ["lungs"], lungs[:1], 2, 2), ("Other", ["lungs", "liver"], lungs, 2, 2), ("HipRay", ["femurs", "hips"], [[0.9, 0.0, 0, 0], [0.8, 0.8, 0.4, 0.8]], 1, 4)]
    rows[-1] = ("HipRay", ["femurs", "hips"], [[0.9] + [0.0] * 9, [0.0] * 4 + [0.8] * 3 + [0.0, 0.3, 0.8]], 1, 10)
    images = spark.createDataFrame(rows, IMAGES)
    got = postprocess.postprocess(images).collect()
    assert [r["status"] for r in got] == ["applied", "applied", "missing_labels", "no_rule", "applied"]
    assert got[0]["prob"] == [[0, 0.6, 0, 0.2], lungs[1]] and got[1]["prob"] == [lungs[1], [0, 0.6, 0, 0.2]] and got[3]["prob"] == lungs
    assert got[4]["prob"][1] == [0] * 5 + [1, 1, 0, 0, 1]
    assert {r["status"] for r in postprocess.postprocess(images, enabled=False).collect()} == {"disabled"}


def test_component_nearest_to_the_truth(spark):
    def image(*boxes):
        grid = [[0.1] * 64 for _ in range(64)]
        for y, x, n in boxes:
            for r in range(y, y + n):
                grid[r][x : x + n] = [0.9] * n
        return [v for row in grid for v in row]

    clavicles, humeri = image((10, 10, 20), (45, 45, 6), (55, 55, 3)), image((0, 0, 2))
    truth = image((54, 54, 4))
    names = ["humeri", "clavicles"]
    rows = [("ShoulderMonch", names, [humeri, clavicles], [truth, clavicles], 64, 64), ("ShoulderMonch", names, [humeri, clavicles], [image(), clavicles], 64, 64), ("ShoulderMonch", names, [humeri, clavicles], None, 64, 64), ("ShoulderMonch", names, [humeri, image()], [truth, truth], 64, 64)]
    images = spark.createDataFrame(rows, "dataset string, label_names array<string>, prob array<array<double>>, label array<array<double>>, height int, width int")
    got = postprocess.postprocess(images).collect()
    assert [r["status"] for r in got] == ["applied", "missing_truth", "missing_truth", "applied"]
    assert got[0]["prob"] == [humeri, [float(v > 0.5) for v in image((45, 45, 6))]]
    assert got[1]["prob"] == [humeri, clavicles] == got[2]["prob"] and not any(got[3]["prob"][1])
    assert {r["status"] for r in postprocess.postprocess(images.drop("label")).collect()} == {"missing_truth"}


def test_masks_and_members(spark):
    images = spark.createDataFrame([("a", 0, [[0.5, 0.2]]), ("a", 1, [[0.7, 0.6]])], "image string, member int, prob array<array<double>>")
    assert images.select(postprocess.predicted_mask()).first()[0] == [[1, 0]]
    row = postprocess.mean_members(images).first()
    assert row["p"] == pytest.approx([0.6, 0.4])
