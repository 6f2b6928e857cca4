"""Components of volumes in slabs against labelling the whole, and that against flooding."""

import numpy as np
import pytest

from maskframe.functions import kernels
from maskframe.functions.storage import Written
from maskframe.operators import volume_labels

RNG = np.random.default_rng(9)


def flooded(mask):
    """Components by flooding from each voxel in order."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            z, y, x = todo.pop()
            for a in range(max(z - 1, 0), min(z + 2, mask.shape[0])):
                for b in range(max(y - 1, 0), min(y + 2, mask.shape[1])):
                    for c in range(max(x - 1, 0), min(x + 2, mask.shape[2])):
                        if mask[a, b, c] and not out[a, b, c]:
                            out[a, b, c] = n
                            todo.append((a, b, c))
    return out


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5, 0.95, 1.0, 0.0])
def test_whole_masks(share):
    for shape in [(1, 1, 1), (1, 9, 7), (6, 1, 8), (4, 5, 6), (7, 3, 2), (3, 8, 1)]:
        mask = RNG.random(shape) < share
        runs = kernels.label_runs(mask)
        want = flooded(mask)
        assert (kernels.drawn(runs, shape) == want).all()
        assert kernels.run_sizes(runs).tolist() == [0, *np.bincount(want.ravel())[1:]]


def cut_up(volume, mask, cuts):
    bounds = [0, *map(int, cuts), len(mask)]
    return [(volume, k, b - a, *mask.shape[1:], mask[a:b].ravel().astype(float).tolist()) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


SLABS = "volume string, slab int, depth int, height int, width int, mask array<double>"


def test_volumes_in_slabs(spark):
    spiral = np.zeros((24, 5, 9), bool)  # one component that goes through all slabs again and again
    spiral[:, 0, ::2] = True
    spiral[0, 0, 1::4], spiral[-1, 0, 3::4] = True, True
    masks = {"sparse": RNG.random((20, 6, 8)) < 0.1, "half": RNG.random((12, 9, 7)) < 0.3, "spiral": spiral, "empty": np.zeros((8, 3, 3), bool), "full": np.ones((8, 3, 3), bool), "one": RNG.random((1, 4, 4)) < 0.5, "strips": RNG.random((40, 1, 50)) < 0.35, "thin": RNG.random((30, 1, 2)) < 0.4}
    rows = [r for name, m in masks.items() for r in cut_up(name, m, sorted(RNG.choice(np.arange(1, len(m)), min(len(m) - 1, 7), replace=False)) if len(m) > 1 else [])]
    written = Written(spark)
    labels, sizes = volume_labels.label_volumes(spark.createDataFrame(rows, SLABS).repartition(5), written)
    got = {name: [] for name in masks}
    for r in sorted(labels.collect(), key=lambda r: r["slab"]):
        got[r["volume"]] += r["labels"]
    found = {(r["volume"], r["label"]): r["size"] for r in sizes.collect()}
    for name, mask in masks.items():
        runs = kernels.label_runs(mask)
        assert got[name] == kernels.drawn(runs, mask.shape).ravel().tolist(), name
        assert {k: n for (v, k), n in found.items() if v == name} == dict(enumerate(kernels.run_sizes(runs)[1:].tolist(), 1))
    written.clear()


def test_no_slabs(spark):
    labels, sizes = volume_labels.label_volumes(spark.createDataFrame([], SLABS))
    assert labels.count() == 0 and sizes.count() == 0
