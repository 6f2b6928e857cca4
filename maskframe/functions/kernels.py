"""Numpy kernels for one raster; pandas UDFs in ``operators.raster`` apply them to columns."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np


class Bands(NamedTuple):
    """Resampling weights of one axis: output cell i is the sum of weights[i, k] * input[first[i] + k]."""

    first: np.ndarray
    weights: np.ndarray

    def along_rows(self, image: np.ndarray) -> np.ndarray:
        """The image with its rows resampled; the work is the output's size times the band's width."""
        out = np.zeros((len(self.first), image.shape[1]))
        for k in range(self.weights.shape[1]):
            out += self.weights[:, k, None] * image[np.minimum(self.first + k, len(image) - 1)]
        return out


@lru_cache(maxsize=256)
def bands(how: str, n_in: int, n_out: int, before: int = 0, content: int | None = None) -> Bands:
    """Weights from an axis of ``n_in`` cells to ``n_out``; of the input only ``content`` cells from ``before`` on are there, the rest is 0.

    area: input cells whose centre lies within an output cell count alike.  bilinear: a triangle
    around the output cell's centre, as wide as the output cells when shrinking.  nearest: input
    cell floor(i n_in / n_out).  Rows of area and bilinear sum to 1 over all ``n_in`` cells.
    """
    content = n_in - before if content is None else content
    scale = n_in / n_out
    cell = np.arange(n_out)
    if how == "nearest":
        first = (cell * n_in) // n_out
        weights = np.ones((n_out, 1))
    else:
        wide = max(scale, 1.0)
        centre = (cell + 0.5) * scale
        reach = wide * (0.5 if how == "area" else 1.0)
        first = np.maximum(np.floor(centre - reach).astype(int), 0)
        x = first[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)[None, :]
        away = (x + 0.5 - centre[:, None]) / wide
        weights = np.clip(1 - np.abs(away), 0, None) if how == "bilinear" else ((away > -0.5) & (away <= 0.5)).astype(float)
        weights[x >= n_in] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    place = first[:, None] + np.arange(weights.shape[1])[None, :] - before
    weights = np.where((place >= 0) & (place < content), weights, 0.0)
    start = np.clip(first - before, 0, max(content - 1, 0))  # weights move with the part that is there
    shift = start - (first - before)
    k = np.arange(weights.shape[1])[None, :] + shift[:, None]
    moved = np.where((k >= 0) & (k < weights.shape[1]), np.take_along_axis(weights, np.clip(k, 0, weights.shape[1] - 1), axis=1), 0.0)
    used = np.flatnonzero(moved.any(axis=0))
    moved = moved[:, : used[-1] + 1 if len(used) else 1]
    return Bands(start, moved)


def resize(image: np.ndarray, height: int, width: int, how: str) -> np.ndarray:
    """area, bilinear (antialiased) or nearest."""
    return resample(image, bands(how, image.shape[0], height), bands(how, image.shape[1], width))


def resample(image: np.ndarray, rows: Bands, columns: Bands) -> np.ndarray:
    """Both axes, columns first."""
    return rows.along_rows(columns.along_rows(image.T).T)


class Runs(NamedTuple):
    """Maximal runs of a 3-D mask along its last axis, in order: the line and the places each has, and its label."""

    z: np.ndarray
    y: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of their component: roots are hooked to smaller ones, then paths halved."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    return parent


def touching(y: np.ndarray, start: np.ndarray, end: np.ndarray, lines: np.ndarray, other: Runs, other_lines: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (run, run of ``other``) in neighbouring lines that touch, corners included; ``lines`` says in which line a partner lies."""
    step = width + 2
    lo = np.searchsorted(other_lines * step + other.end, lines * step + start, "left")
    hi = np.searchsorted(other_lines * step + other.start, lines * step + end, "right")
    many = np.maximum(hi - lo, 0)
    first = np.repeat(np.arange(len(y)), many)
    return first, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


def label_runs(mask: np.ndarray) -> Runs:
    """Runs of a 3-D mask labelled by component (26 neighbours), from 1 by first voxel."""
    depth, height, width = mask.shape
    padded = np.zeros((depth, height, width + 2), np.int8)
    padded[:, :, 1:-1] = mask
    d = np.diff(padded, axis=2)
    z, y, start = np.nonzero(d == 1)
    end = np.nonzero(d == -1)[2]
    runs = Runs(z, y, start, end, np.zeros(len(z), np.int64))
    line = z * (height + 1) + y  # one line that is empty between slices: none wraps around
    pairs = [touching(y, start, end, line - back, runs, line, width) for back in (1, height, height + 1, height + 2)]
    root = connected(len(z), np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))
    return runs._replace(label=np.unique(root, return_inverse=True)[1] + 1)


def drawn(runs: Runs, shape: tuple[int, int, int], labels: np.ndarray | None = None) -> np.ndarray:
    """The labels of runs as an array, 0 outside."""
    edges = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
    value = runs.label if labels is None else labels
    np.add.at(edges, (runs.z, runs.y, runs.start), value)
    np.add.at(edges, (runs.z, runs.y, runs.end), -value)
    return np.cumsum(edges, axis=2)[:, :, :-1]


def run_sizes(runs: Runs) -> np.ndarray:
    """Voxels of each label, from label 0 (0 voxels) on."""
    return np.bincount(runs.label, weights=runs.end - runs.start, minlength=1).astype(np.int64)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected components: labels from 1 by first pixel in row order (0 outside), and their sizes."""
    runs = label_runs(np.asarray(mask, bool)[None])
    return drawn(runs, (1, *mask.shape))[0], run_sizes(runs)


def largest_components(sizes: np.ndarray, limit: int, min_relative: float) -> list[int]:
    """Numbers of the largest components, larger first, then by number; at least max(1, ceil(largest * min_relative)) pixels."""
    order = sorted(range(1, len(sizes)), key=lambda k: (-sizes[k], k))
    if not order:
        return []
    least = max(1, int(np.ceil(sizes[order[0]] * min_relative)))
    return [k for k in order if sizes[k] >= least][:limit]


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """For each line (row) the least of its parabolas heights[q] + (x - q)^2 at every place x.

    One scan keeps each line's stack of parabolas that are lowest somewhere and where each begins,
    another reads them off; all lines go through a scan together, so the work is linear in pixels.
    """
    lines, n = heights.shape
    line = np.arange(lines)
    at = np.zeros((lines, n), np.int64)  # places of the parabolas on the stack
    begin = np.full((lines, n + 1), np.inf)
    begin[:, 0] = -np.inf
    top = np.zeros(lines, np.int64)
    foot = heights + np.arange(n) ** 2
    for q in range(1, n):
        going = line
        while len(going):
            v = at[going, top[going]]
            meet = (foot[going, q] - foot[going, v]) / (2.0 * (q - v))
            hidden = meet <= begin[going, top[going]]
            on, meet = going[~hidden], meet[~hidden]
            top[on] += 1
            at[on, top[on]] = q
            begin[on, top[on]] = meet
            begin[on, top[on] + 1] = np.inf
            going = going[hidden]
            top[going] -= 1
    out, k = np.empty((lines, n)), np.zeros(lines, np.int64)
    for x in range(n):
        going = line
        while len(going):
            going = going[begin[going, k[going] + 1] < x]
            k[going] += 1
        v = at[line, k]
        out[:, x] = heights[line, v] + (x - v) ** 2
    return out


def squared_distance_to(mask: np.ndarray) -> np.ndarray | None:
    """Exact squared Euclidean distance of each pixel to the nearest positive one; None without any."""
    if not mask.any():
        return None
    h, w = mask.shape
    rows = np.full((h, w), float(h + w))  # more than any distance inside the grid
    for sweep in (range(h), range(h - 1, -1, -1)):
        last = np.full(w, float(h + w))
        for y in sweep:
            last = np.where(mask[y], 0, last + 1)
            rows[y] = np.minimum(rows[y], last)
    return lower_envelope(rows**2)


def distance_to(mask: np.ndarray) -> np.ndarray | None:
    """Euclidean distance of each pixel to the nearest positive one; None without any."""
    squared = squared_distance_to(mask)
    return None if squared is None else np.sqrt(squared)


def outline(mask: np.ndarray) -> np.ndarray:
    """Positive pixels with a 4-neighbour outside; beyond the border counts as outside."""
    p = np.pad(mask, 1)
    return mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])


def hausdorff95(pred: np.ndarray, target: np.ndarray) -> float:
    """The larger of the two directed 95th percentiles of distances between outlines.

    Both masks empty: 0.  One empty: the diagonal of the grid between pixel centres.
    """
    a, b = outline(pred), outline(target)
    if not a.any() or not b.any():
        return float(np.hypot(pred.shape[0] - 1, pred.shape[1] - 1)) if a.any() or b.any() else 0.0
    return float(max(np.percentile(distance_to(b)[a], 95), np.percentile(distance_to(a)[b], 95)))


def gaussian(image: np.ndarray, sigma: float, size: int) -> np.ndarray:
    """Separable Gaussian blur, edges mirrored without the edge pixel."""
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size - 1 - size // 2)
        p = np.pad(image, pad, mode="reflect")
        image = sum(k[i] * np.take(p, np.arange(i, i + image.shape[axis]), axis=axis) for i in range(size))
    return image


def equalize_tiles(image: np.ndarray, clip: float, grid: tuple[int, int]) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an image in [0, 1].

    Tile histograms of 256 bins are clipped at max(floor(clip * pixels / 256), 1), the excess is
    spread evenly (what is left over one bin each from the start), and cumulative maps of the four
    nearest tiles are blended bilinearly.  A value x falls into bin floor(255 x); the grid has at most
    one tile a pixel, tiles have even sides, and a place lies at i / side - 0.5 between tiles.
    """
    if not (np.isfinite(clip) and clip > 0 and min(grid) > 0):
        raise ValueError("clip and grid must be positive")
    h, w = image.shape
    gy, gx = min(grid[0], h), min(grid[1], w)
    th, tw = -(-h // gy), -(-w // gx)
    th, tw = th + th % 2, tw + tw % 2
    image = np.clip(image.astype(np.float32), 0, 1)  # single precision decides on which side of a bin a value falls
    p = np.pad(image, ((0, th * gy - h), (0, tw * gx - w)), mode="reflect" if th * gy - h < h and tw * gx - w < w else "edge")
    bins = np.clip((p * np.float32(255)).astype(int), 0, 255)
    luts = np.empty((gy, gx, 256))
    pixels = th * tw
    limit = max(int(clip * pixels // 256), 1)
    for i in range(gy):
        for j in range(gx):
            hist = np.bincount(bins[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.clip(hist - limit, 0, None).sum())
            hist = np.minimum(hist, limit) + over // 256
            hist[: over % 256] += 1
            luts[i, j] = np.clip(np.floor(np.cumsum(hist).astype(np.float32) * np.float32(255.0 / pixels)), 0, 255) / 255.0

    def axis(n: int, tile: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / tile - 0.5
        low = np.clip(np.floor(at), 0, count - 1).astype(int)
        return low, np.clip(low + 1, 0, count - 1), np.clip(at - low, 0, 1)

    y0, y1, fy = axis(h, th, gy)
    x0, x1, fx = axis(w, tw, gx)
    b = bins[:h, :w]
    pick = lambda yy, xx: luts[yy[:, None], xx[None, :], b]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return top * (1 - fy[:, None]) + low * fy[:, None]
