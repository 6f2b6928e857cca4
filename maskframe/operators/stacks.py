"""Stacks of arrays of one length, merged element by element without a row for each element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from maskframe.functions.arrays import doubles

#: Elements that a task holds before it passes what it has merged on.
HELD = 4_000_000


def merged_arrays(rows: DataFrame, by: list[str], data: str, how: str = "mean") -> DataFrame:
    """``by`` and the arrays ``data`` of each group merged element by element (``mean`` or ``max``).

    Null arrays are left out; arrays of a group that differ in length raise.  Arrays are merged in
    each task first and then once more by group, so a group costs one row a task and a hot group
    no more than others.
    """
    if how not in ("mean", "max"):
        raise ValueError("how must be mean or max")
    merge = np.add if how == "mean" else np.maximum
    schema = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in by)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        held = 0
        for frame in frames:
            for key, a in zip(frame[by].itertuples(index=False, name=None), frame[data]):
                if a is None:
                    continue
                if key in found:
                    _check(found[key][0], a)
                    merge(found[key][0], a, out=found[key][0])
                    found[key][1] += 1
                else:
                    found[key] = [np.array(a, float), 1]
                    held += len(a)
            if held > HELD:
                yield _frame(found, by, data)
                found, held = {}, 0
        yield _frame(found, by, data)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        _check(*frame[data])
        out = frame[by].head(1).copy()
        merged = merge.reduce(np.stack(frame[data].tolist()))
        out[data] = [merged / frame["n"].sum() if how == "mean" else merged]
        return out

    parts = rows.select(*by, doubles(data).alias(data)).mapInPandas(partial, f"{schema}, {data} array<double>, n long")
    return parts.groupBy(*by).applyInPandas(whole, f"{schema}, {data} array<double>")


def _check(*arrays: np.ndarray) -> None:
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("arrays of one group differ in length")


def _frame(found: dict[tuple, list], by: list[str], data: str) -> pd.DataFrame:
    out = pd.DataFrame(list(found), columns=by, dtype=object)
    out[data] = pd.Series([a for a, _ in found.values()], dtype=object)
    out["n"] = [n for _, n in found.values()]
    return out
