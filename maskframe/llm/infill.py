"""Fill-in-middle transformation over run-length class encodings.

A text is stored as its maximal runs of one character class, each with the units that end in it,
cumulated.  The units that end in a run lie at even distances before its end, so the place of any
cut is found by a binary search for its run and one multiplication; no list of units is made.
All documents of a block are encoded and cut together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import textblocks as tb
from maskframe.llm.common import documents, map_arrow

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are transformed, and of those the percent with the suffix first.
RATE = 100
SPM_RATE = 50
UNITS = ("line", "word", "char")

_MARKS = tuple(m.encode() for m in MARKS)
_SPACE = tb.table(b" \t\n\x0b\x0c\r")
_NEWLINE = tb.table(b"\n")
_TAIL = np.arange(256) >> 6 == 2  # bytes that go on with a character
_WIDTH = np.select([np.arange(256) >= 0xF0, np.arange(256) >= 0xE0, np.arange(256) >= 0xC0], [4, 3, 2], 1).astype(np.int8)


class Runs(NamedTuple):
    """Runs of a block: their ends, the bytes of each unit that ends in them, units up to and with each, and the number of each document's first run."""

    ends: np.ndarray
    step: np.ndarray
    total: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        """Units of each document."""
        before = np.append(0, self.total)
        return before[self.first[1:]] - before[self.first[:-1]]


def encode(block: tb.Block, unit: str = "line") -> Runs:
    """The runs of all documents of a block; none crosses documents.

    unit ``line``: up to and with a newline, ``word``: up to and with the white space after it
    (leading white space is a unit), ``char``: one code point; the rest of a text is a last unit.
    """
    data, n = block.data, len(block.data)
    if unit == "char":  # classes are the widths of the characters
        kind = _WIDTH[data]
        lead = np.flatnonzero(~_TAIL[data])
        kind = np.repeat(kind[lead], np.diff(np.append(lead, n))) if n else kind
    else:
        kind = (_NEWLINE if unit == "line" else _SPACE)[data].view(np.int8)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[block.starts] = True
    starts = np.flatnonzero(edge[:n])
    ends = np.append(starts[1:], n)[: len(starts)]
    first = np.append(np.searchsorted(starts, block.starts), len(starts))
    kind, size = kind[starts].astype(np.int64), ends - starts
    if unit == "char":
        step, many = kind, size // np.maximum(kind, 1)
    else:
        last = np.zeros(len(starts), bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        step = np.ones(len(starts), np.int64)
        many = np.where(kind == 1, size if unit == "line" else 1, last)
    return Runs(ends, step, np.cumsum(many), first)


def cut_places(runs: Runs, block: tb.Block, cuts: np.ndarray) -> np.ndarray:
    """The byte of the block after the first ``cuts`` units of each document (0 up to its units)."""
    if not len(runs.ends):
        return block.starts.copy()
    before = np.append(0, runs.total)[runs.first[:-1]]
    run = np.minimum(np.searchsorted(runs.total, before + cuts), len(runs.ends) - 1)
    return np.where(cuts > 0, runs.ends[run] - (runs.total[run] - before - cuts) * runs.step[run], block.starts)


def _transformed(unit: str, rate: int, spm_rate: int):
    p, s, m = _MARKS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5))
        for block in tb.blocks(batch.column("text")):
            rows = slice(block.lo, block.hi)
            runs = encode(block, unit)
            n = runs.counts()
            x, y = h1[rows] % (n + 1), h2[rows] % (n + 1)
            a, b = cut_places(runs, block, np.minimum(x, y)), cut_places(runs, block, np.maximum(x, y))
            chars = np.append(0, np.cumsum(~_TAIL[block.data]))
            form, output = [], []
            for k, (lo, hi) in enumerate(zip(block.starts, block.ends)):
                text = block.data[lo:hi].tobytes()
                cut1, cut2 = a[k] - lo, b[k] - lo
                if not text or h3[block.lo + k] % 100 >= rate or any(mark in text for mark in _MARKS):
                    form.append("plain")
                    output.append(text)
                elif h4[block.lo + k] % 100 < spm_rate:
                    form.append("spm")
                    output.append(b"".join([s, text[cut2:], p, text[:cut1], m, text[cut1:cut2]]))
                else:
                    form.append("psm")
                    output.append(b"".join([p, text[:cut1], s, text[cut2:], m, text[cut1:cut2]]))
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id")[rows], "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(chars[a] - chars[block.starts], pa.int64(), mask=plain), "middle_chars": pa.array(chars[b] - chars[a], pa.int64(), mask=plain),
                "output": pa.array(output, pa.binary()).cast(pa.string()),
            })

    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Every whole text with a middle moved to its end: doc_id, n, form, prefix_chars, middle_chars, output.

    n: the text's units (``line``, ``word`` or ``char``).  The prefix ends after a number of units
    drawn from 0 to n, the middle after another, the suffix is the rest; draws are SHA-256 of the
    seed and the doc_id, so a task that is run again makes the same cuts.  form ``psm`` is
    <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle.  A text that is empty or null
    or holds a marker stays as it is (form ``plain``, null lengths; null text: empty output), and so
    do 100 - ``rate`` percent of the others.  A null doc_id draws as an empty one and is carried
    through; repeated rows are cut alike, each on its own; other columns are not looked at.  One
    pass without a shuffle; memory is bounded by a block and the longest text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    drawn = docs.select(doc_id.alias("doc_id"), "text", digest.alias("h"))
    drawn = drawn.select("doc_id", "text", *(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    return map_arrow(drawn, _transformed(unit, rate, spm_rate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of: its parts between the markers, put in order again."""
    parts = F.split(output, "|".join(MARKS), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(at(1), at(3), at(2))).when(F.col(form) == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.col(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c, 256)
    return fill_in_middle(documents(spark, sf_dir)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
