"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces: a passage within the budget has
at least one piece untouched.  An Aho-Corasick automaton finds exact piece hits in each document;
hits of one item near one diagonal ask for one verification, by Myers' bit-parallel distance over
the stretch of text that the item could fill.  Short items are looked for as they are, between
word bounds.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.common import cut, documents, kept, map_arrow

#: Edits allowed, as a share of an item's normalised characters.
ERROR_RATE = 0.05
#: The error rate allows items with fewer normalised characters no edit; they must stand between word bounds.
MIN_CHARS = round(1 / ERROR_RATE)
#: Benchmark text in one automaton, which bounds what is broadcast; more of it takes more passes.
PASS_BYTES = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    """Words (letters and digits, lower-cased), parted by single spaces."""
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``item`` cut into budget + 1 parts of near equal length."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of ``pattern`` with any part of ``text``; of equals the first."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = hp << 1 & full
        hm = hm << 1 & full
        plus = hm | (full & ~(xv | hp))
        minus = hp & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, short_items: bool = True):
        clean = ((i, normalise(t)) for i, t in items)
        self.items = [(i, t, int(len(t) * error_rate) if len(t) >= min_chars else 0) for i, t in clean if len(t) >= (1 if short_items else max(1, min_chars))]
        self.short = [len(t) < min_chars for _, t, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best match in a normalised text."""
        if not self.items:
            return []
        diagonals: dict[int, set[int]] = {}
        exact: dict[int, tuple[int, int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                if self.short[k]:
                    start = end + 1 - length
                    if k not in exact and text[start - 1 : start] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        exact[k] = start, end + 1
                    continue
                diagonals.setdefault(k, set()).add(end + 1 - length - offset)
        found = [(self.items[k][0], 0, *at) for k, at in exact.items()]
        for k, starts in diagonals.items():
            item_id, item, budget = self.items[k]
            best = None
            lo = hi = None
            for d in [*sorted(starts), None]:
                if lo is not None and (d is None or d > hi + 2 * budget):
                    a, b = max(0, lo - budget), hi + len(item) + budget
                    distance, at = myers(item, text[a:b])
                    if distance <= budget and (best is None or distance < best[0]):
                        back, length = myers(item[::-1], text[a : a + at][::-1])
                        best = (distance, a + at - length, a + at)
                    lo = None
                if d is not None:
                    lo, hi = (d if lo is None else lo), d
            if best:
                found.append((item_id, *best))
        return found


def _matcher(shared) -> Matcher:
    return kept(f"matcher {shared.id}", lambda: Matcher(*shared.value))


class _Shared:
    """A broadcast by its id, so that each process builds one matcher for it."""

    def __init__(self, spark: SparkSession, value: tuple):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> tuple:
        return self.broadcast.value


def _passes(benchmark: DataFrame, error_rate: float, min_chars: int, short_items: bool) -> Iterator[tuple[_Shared, bool]]:
    """The benchmark in parts of about PASS_BYTES, and whether another one follows.

    A part is read and broadcast when it is asked for; the driver holds one at a time.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + size // PASS_BYTES
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield _Shared(spark, ([tuple(r) for r in part.collect()], error_rate, min_chars, short_items)), k + 1 < n


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, short_items: bool = True) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds within the error budget.

    Returns doc_id, item_id, distance (edits), budget, start, end (characters in the normalised
    text) and first_word (words before the match).  Both texts are lower-cased and reduced to
    words parted by single spaces; the budget is error_rate of the item's characters.  Documents
    without a match have no row; null and empty texts never match.  Items shorter than min_chars have
    budget 0 and match between word bounds, first place, unless short_items is false; null items and
    those without a word never match; equal items each match.  Repeated rows match each on their
    own, a null doc_id is carried through.  An empty benchmark gives no rows.  No shuffle: one
    pass over the documents for each PASS_BYTES of benchmark text.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(shared: _Shared) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            matcher, rows = _matcher(shared), []
            budgets = {i: b for i, _, b in matcher.items}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = normalise(text.as_py())
                rows += [(doc_id, i, d, budgets[i], a, b, text.count(" ", 0, a)) for i, d, a, b in matcher.find(text)]
            names = ("doc_id", "item_id", "distance", "budget", "start", "end", "first_word")
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})

        return map_arrow(chosen, run, "doc_id long, item_id long, distance long, budget long, start long, end long, first_word long", keeps="matcher")

    return functools.reduce(DataFrame.unionByName, (one(s) for s, _ in _passes(benchmark, error_rate, min_chars, short_items)))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, short_items: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no benchmark item; nulls stay.

    With short_items false, items shorter than min_chars reject nothing.  What one part of the
    benchmark leaves is written before the next one is looked for, so a task holds one matcher.
    """
    for shared, more in _passes(benchmark, error_rate, min_chars, short_items):

        def run(batch: pa.RecordBatch, shared: _Shared = shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            yield batch.filter(pa.array([not matcher.find(normalise(t.as_py())) for t in batch.column("text")], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema, keeps="matcher")
        if more:
            docs = cut(docs)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
