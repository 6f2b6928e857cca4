"""Connected components of masks that are larger than a row.

A volume (or an image cut into strips) lies in slabs, one a row.  Every slab is labelled by itself
from its runs; the runs of facing slices say which labels of neighbouring slabs are one; these
links, a few for each face, are joined in Spark, and the slabs are drawn again with the numbers that
the whole volume gives them.  Voxels never leave their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from maskframe.functions import kernels
from maskframe.functions.storage import Written

_FACE = "struct<y:array<int>,start:array<int>,end:array<int>,label:array<int>>"


def _labelled(slabs: DataFrame, volume_type: str) -> DataFrame:
    """volume, slab, width, sizes (of labels 1, 2, ...) and the runs of the first and last slice of each slab."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                runs = kernels.label_runs(np.asarray(r.mask, float).reshape(r.depth, r.height, r.width) > 0)
                face = lambda z: {n: getattr(runs, n)[runs.z == z].astype(np.int32) for n in ("y", "start", "end", "label")}  # noqa: B023, E731
                rows.append((r.volume, r.slab, r.width, kernels.run_sizes(runs)[1:], face(0), face(r.depth - 1)))
            yield pd.DataFrame(rows, columns=["volume", "slab", "width", "sizes", "first", "last"], dtype=object)

    return slabs.select("volume", "slab", "depth", "height", "width", "mask").mapInPandas(run, f"volume {volume_type}, slab long, width int, sizes array<long>, first {_FACE}, last {_FACE}")


def _facing(faces: DataFrame, volume_type: str) -> DataFrame:
    """volume, a, b: pairs of (slab << 32 | label) that touch over the face between two slabs."""

    def runs(face: dict) -> kernels.Runs:
        y, start, end, label = (np.asarray(face[n], np.int64) for n in ("y", "start", "end", "label"))
        return kernels.Runs(np.zeros_like(y), y, start, end, label)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                above, below = runs(r.last), runs(r.first)
                pairs = [kernels.touching(below.y, below.start, below.end, below.y + d, above, above.y, r.width) for d in (-1, 0, 1)]
                p, q = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
                links = np.unique(np.stack([above.label[q] + ((r.slab - 1) << 32), below.label[p] + (r.slab << 32)], 1), axis=0)
                yield pd.DataFrame({"volume": pd.Series([r.volume] * len(links), dtype=object), "a": links[:, 0], "b": links[:, 1]})

    return faces.mapInPandas(run, f"volume {volume_type}, a long, b long")


def joined(edges: DataFrame, by: list[str], written: Written) -> DataFrame:
    """``by``, node, root: the smallest node of its component, for every node of an edge (by, a, b).

    Rounds of two grouped minima: every node's larger neighbours, and then its smaller ones, move to
    its smallest neighbour.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = written.cut(edges.select(*by, "a", "b").where("a <> b").distinct())
    state = None
    while True:
        turned = edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.unionByName(turned)
        least = both.groupBy(*by, "a").agg(F.least("a", F.min("b")).alias("m"))
        large = written.cut(both.where("b > a").join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy(*by, "a").agg(F.min("b").alias("m"))
        moved = down.join(least, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(*by, "a", F.col("m").alias("b")))
        edges = written.cut(moved.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, state = state, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(*by, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(*by, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def label_volumes(slabs: DataFrame, written: Written | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels of all slabs and sizes of all components.

    slabs(volume, slab, depth, height, width, mask): slab numbers 0, 1, 2, ... of a volume along its
    first axis, mask row-major [depth][height][width], positive inside.  Strips of an image are
    slabs of height 1 whose depth is their rows.  Components join over faces, edges and corners.
    Returns slabs with ``labels`` (0 outside) in place of the mask, and components(volume, label,
    size); labels are 1, 2, 3, ... by first voxel in each volume.  ``written`` keeps the tables in
    between; they must stay until the results have been read.
    """
    volume_type = dict(slabs.dtypes)["volume"]
    slabs = slabs.withColumns({"slab": F.col("slab").cast("long")} | {c: F.col(c).cast("int") for c in ("depth", "height", "width")})
    written = written or Written(slabs.sparkSession)
    found = written.cut(_labelled(slabs, volume_type))
    below = found.select("volume", "slab", "width", "first")
    faces = below.join(found.select("volume", (F.col("slab") + 1).alias("slab"), "last"), ["volume", "slab"])
    roots = joined(_facing(faces, volume_type), ["volume"], written)
    own = found.select("volume", "slab", F.posexplode("sizes").alias("at", "size")).withColumn("node", F.shiftleft(F.col("slab"), 32) + F.col("at") + 1)
    own = own.join(roots, ["volume", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    whole = own.groupBy("volume", "root").agg(F.sum("size").alias("size"))
    # numbered within slabs, after the components that begin in earlier ones: no task orders a volume's components
    whole = written.cut(whole.withColumn("begins", F.shiftright("root", 32)))
    begun = whole.groupBy("volume", "begins").count()
    earlier = begun.withColumn("earlier", F.coalesce(F.sum("count").over(_window("volume", "begins").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(_window(["volume", "begins"], "root"))
    numbered = written.cut(whole.withColumn("place", place).join(earlier, ["volume", "begins"]).select("volume", "root", (F.col("earlier") + F.col("place")).cast("long").alias("label"), "size"))
    per_slab = own.join(numbered.select("volume", "root", "label"), ["volume", "root"]).groupBy("volume", "slab").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("names"))
    labels = slabs.join(per_slab, ["volume", "slab"], "left").withColumn("labels", _drawn("mask", "depth", "height", "width", "names")).drop("mask", "names")
    return labels, numbered.select("volume", "label", "size")


def _window(by: str | list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _drawn(mask: pd.Series, depth: pd.Series, height: pd.Series, width: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for m, shape, new in zip(mask, zip(depth, height, width), names):
        runs = kernels.label_runs(np.asarray(m, float).reshape(shape) > 0)
        out.append(kernels.drawn(runs, shape, None if new is None else np.asarray(new, np.int64)[runs.label - 1]).ravel())
    return pd.Series(out, dtype=object)
