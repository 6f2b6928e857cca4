"""Quality rules with cross-document line frequency.

One pass over the texts counts words, symbols, repeated lines and repeated 5-word windows, and
hashes every line that has a word, letter case A-Z and white space normalised.  A second, small
job counts for each host and line hash the distinct texts that carry the line.  Lines carried by
more texts than the host's limit are boilerplate: they are taken out of every document but the
first carrier, and a document of which next to nothing is left is rejected.

Exact copies of a text count once, so copying a document does not turn its lines into
boilerplate; the first carrier (smallest id) keeps the line, so one of every group of documents
made of shared lines stays whole.

``cleaned`` applies the verdicts.  The frequent lines are few, each being carried by a share of its
host's texts, so they are sent to the tasks if their number allows it, and one more pass over the
texts judges, cuts lines and drops documents where they are read: no text is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm import textblocks as tb
from maskframe.llm.common import cut, documents, forget, map_arrow

WORD = ~tb.table(b" \t\n\v\f\r")
SYMBOLS = tb.table(b"#*$%&|<>")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate on a host if more distinct texts carry it than both of these.
MIN_LIMIT = 20
HOST_SHARE = 0.005
#: A document is depleted if fewer words stay than MIN_WORDS, or less than this share of its own.
MIN_LEFT = 0.1
#: As many frequent lines are sent to the tasks (24 bytes each); verdicts on more are joined to the texts.
SENT_LINES = 1_000_000

_PROFILE = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "text_hash long, line_no array<int>, line_hash array<long>, line_words array<int>"
)


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tb.mix(hashes + tb.mix(doc.astype(np.uint64) + np.uint64(1)))


def profile_block(block: tb.Block) -> dict[str, list]:
    """Counts and line hashes of each document of a block."""
    data, n_docs = block.data, len(block.starts)
    w = tb.words(block, WORD)
    counts = w.counts()
    characters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=characters[1:])
    word_chars = tb.segment_sums(characters[w.ends] - characters[w.starts], w.first[:-1], w.first[1:])
    n_symbols = tb.segment_sums(SYMBOLS[data], block.starts, block.ends)

    hashes = tb.span_hashes(data, w.starts, w.ends)
    value, at = tb.windows(w, hashes, WINDOW)
    _, back, times = np.unique(_in_doc(value, w.doc[at]), return_inverse=True, return_counts=True)
    begin = at[times[back] > 1]
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    n_repeat = tb.segment_sums(np.cumsum(cover)[:-1] > 0, w.first[:-1], w.first[1:])

    newline = np.flatnonzero(data == 10)
    before = np.searchsorted(newline, w.starts)  # newlines of the block before each word
    head = np.flatnonzero(np.diff(before, prepend=-1) | np.diff(w.doc, prepend=-1)) if len(before) else before
    tail = np.append(head[1:], len(w.starts)) if len(head) else head
    doc, line = w.doc[head], before[head]
    line_no = line - np.searchsorted(newline, block.starts)[doc]
    raw_start = np.maximum(block.starts[doc], np.append(newline, 0)[line - 1] + 1 if len(newline) else 0) if len(head) else head
    raw_start = np.where(line_no > 0, raw_start, block.starts[doc]) if len(head) else head
    raw_end = np.minimum(block.ends[doc], np.append(newline, len(data))[line]) if len(head) else head
    n_lines = np.bincount(doc, minlength=n_docs)
    raw = _in_doc(tb.span_hashes(data, raw_start, raw_end), doc)
    different = np.bincount(doc[np.unique(raw, return_index=True)[1]], minlength=n_docs)

    folded = tb.span_hashes(tb.fold_case(data), w.starts, w.ends)
    place = np.arange(len(w.starts)) - np.repeat(head, tail - head)
    total = np.zeros(len(w.starts) + 1, np.uint64)
    np.cumsum(tb.mix(folded + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    line_hash = tb.mix(total[tail] - total[head]).view(np.int64)
    line_words = (tail - head).astype(np.int32)
    cuts = np.append(0, np.cumsum(n_lines)).astype(np.int32)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))

    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_lines - different, "n_repeat_words": n_repeat,
        "text_hash": tb.span_hashes(data, block.starts, block.ends).view(np.int64),
        "line_no": lists(line_no.astype(np.int32)), "line_hash": lists(line_hash), "line_words": lists(line_words),
    }


def _profile(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batch.column("text")):
        found = profile_block(block)
        head = batch.slice(block.lo, block.hi - block.lo)
        yield pa.RecordBatch.from_pydict({c: head.column(c) for c in ("doc_id", "host", "text_key")} | {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in found.items()})


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def line_profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its counts, and number, hash and words of each line that has a word; text_key is null for null."""
    text = F.col("text").cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(host).alias("host"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text_key"), text.alias("text")), _profile, _PROFILE)


def frequent_lines(profile: DataFrame, min_limit: int = MIN_LIMIT, share: float = HOST_SHARE) -> DataFrame:
    """host, line_hash, n_texts and first_id of the lines above their host's limit.

    Rows are one per text and different line before the shuffle, and both steps of the count
    combine on the map side, so a line that every document carries is no hot key.
    """
    lines = profile.select("host", "text_hash", "doc_id", F.explode(F.array_distinct("line_hash")).alias("line_hash"))
    carried = (
        lines.groupBy("host", "line_hash", "text_hash").agg(F.min("doc_id").alias("doc_id"))
        .groupBy("host", "line_hash").agg(F.count("*").alias("n_texts"), F.min("doc_id").alias("first_id"))
        .where(F.col("n_texts") > min_limit)
    )
    hosts = profile.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_texts"))
    return carried.join(hosts, "host").where(F.col("n_texts") > share * F.col("host_texts")).select("host", "line_hash", "n_texts", "first_id")


def _verdicts(profile: DataFrame, frequent: DataFrame) -> DataFrame:
    """The profile with base_failed, kept, n_left_words and removed_lines."""
    profile = cut(profile.withColumn("row", F.monotonically_increasing_id()))
    removed = (
        profile.select("row", "doc_id", "host", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("l"))
        .select("row", "doc_id", "host", F.col("l.line_no").alias("line_no"), F.col("l.line_hash").alias("line_hash"), F.col("l.line_words").alias("line_words"))
        .join(frequent, ["host", "line_hash"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("row").agg(F.sum("line_words").alias("removed_words"), F.sort_array(F.collect_list("line_no")).alias("removed_lines"))
    )
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed_words").isNotNull() & ((left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words")))
    return profile.join(removed, "row", "left").select(
        "doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), left.alias("n_left_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts and verdict of every document, by the base rules and by line frequency.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_left_words (words outside removed lines) and removed_lines (numbers from 0 of the
    \\n-split lines to remove; ``without_lines`` applies them).

    Null text counts as an empty one: all counts 0, base_failed.  A null host is a host of its
    own (named '').  Repeated rows are judged each on their own, and are one text to the line
    counts.  A null doc_id is carried through.  An empty table gives an empty result; columns
    other than doc_id, text and the host are not looked at.
    """
    # the frequent lines are cut: adaptive execution splits the join at a line that very many texts carry
    # only where both sides are plain exchanges
    profile = cut(line_profile(docs, host))
    return _verdicts(profile, cut(frequent_lines(profile))).drop("host", "text_key")


class _Frequent:
    """Frequent lines as sorted keys of host and line, and the first carrier of each."""

    def __init__(self, rows: pa.Table):
        keys = line_keys(rows["host_hash"].to_numpy().view(np.uint64), rows["line_hash"].to_numpy().view(np.uint64))
        order = np.argsort(keys)
        self.keys, self.none = keys[order], rows["first_id"].is_null().to_numpy()[order]
        self.first = rows["first_id"].fill_null(0).to_numpy()[order]

    def removed(self, key: np.ndarray, doc: np.ndarray, no_doc: np.ndarray) -> np.ndarray:
        """Which lines, by key and document, are to be removed."""
        at = np.searchsorted(self.keys, key).clip(max=max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(key), bool)
        own = np.where(self.none[at], no_doc, ~no_doc & (self.first[at] == doc))
        return (self.keys[at] == key) & ~own


def line_keys(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    return tb.mix(line + tb.mix(host + np.uint64(1)))


def _judged(batch: pa.RecordBatch, frequent: _Frequent, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that are kept, their text without its frequent lines; ``__cut`` is true where lines went."""
    for block in tb.blocks(batch.column(text)):
        found = profile_block(block)
        head = batch.slice(block.lo, block.hi - block.lo)
        lines = np.diff(found["line_no"].offsets.to_numpy())
        doc = np.repeat(np.arange(len(lines)), lines)
        ids, hosts = head.column("__id"), head.column("__host").to_numpy().view(np.uint64)
        gone = frequent.removed(line_keys(hosts[doc], found["line_hash"].values.to_numpy().view(np.uint64)), ids.fill_null(0).to_numpy()[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc])
        n, lost = found["n_words"], np.bincount(doc[gone], found["line_words"].values.to_numpy()[gone], minlength=len(lines)).astype(np.int64)
        cut_lines = np.bincount(doc[gone], minlength=len(lines)) > 0
        left = n - lost
        kept = (n >= MIN_WORDS) & (100 * found["n_repeat_words"] <= MAX_REPEAT_PERCENT * n) & ~(cut_lines & ((left < MIN_WORDS) | (left < MIN_LEFT * n)))
        texts = head.column(text)
        if (cut_lines & kept).any():
            numbers, out = found["line_no"].values.to_numpy(), texts.to_pylist()
            for d in np.flatnonzero(cut_lines & kept):
                drop = set(numbers[gone & (doc == d)].tolist())
                out[d] = "\n".join([line for k, line in enumerate(out[d].split("\n")) if k not in drop])
            texts = pa.array(out, texts.type)
        columns = {c: texts if c == text else head.column(c) for c in head.schema.names if c not in ("__id", "__host")}
        yield pa.RecordBatch.from_pydict(columns | {"__cut": pa.array(cut_lines)}).filter(pa.array(kept))


def cleaned(docs: DataFrame, host: str = "source", sent_lines: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, their text without its boilerplate lines.

    All columns stay, and ``__cut`` says whether lines went.  At most ``sent_lines`` frequent lines
    (SENT_LINES by default) are sent to the tasks; verdicts on more are joined to the rows by doc_id,
    host and text, which decide them.  Odd rows are as in ``quality_rules``: null texts go.
    """
    profile = cut(line_profile(docs, host).select("doc_id", "host", "text_hash", "line_hash"))
    found = cut(frequent_lines(profile))
    forget(profile)
    if found.count() <= (SENT_LINES if sent_lines is None else sent_lines):
        spark = docs.sparkSession
        lines = found.select(F.xxhash64("host").alias("host_hash"), "line_hash", "first_id").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(_Frequent(lines))
        schema = T.StructType([*docs.schema.fields, T.StructField("__cut", T.BooleanType())])
        return map_arrow(docs.withColumns({"__id": F.col("doc_id").cast("long"), "__host": F.xxhash64(_host(host))}), lambda batch: _judged(batch, shared.value, "text"), schema)
    keys = {"__id": "doc_id", "__host": "host", "__text": "text_key"}
    verdicts = _verdicts(line_profile(docs, host), found).where("kept").select(*(F.col(c).alias(k) for k, c in keys.items()), F.col("removed_lines").alias("__lines")).dropDuplicates(list(keys))
    own = (F.col("doc_id").cast("long"), _host(host), F.xxhash64("text"))
    on = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(c) for k, c in zip(keys, own)))
    joined = docs.where("text is not null").join(verdicts, on).withColumn("__cut", F.size("__lines") > 0)
    return joined.select(*(F.when(F.col("__cut"), without_lines(c, "__lines")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns), "__cut")


def without_lines(text: str = "text", removed: str = "removed_lines") -> Column:
    """The text without its removed lines."""
    return F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col(removed), i)), "\n")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("removed_lines")


_W = r"[^\x20\x09-\x0D]+"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS w FROM d),
c AS (SELECT rid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
i AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
k AS (SELECT rid, i, w[i:i + 4] AS k FROM i),
r AS (SELECT rid, i FROM k QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
p AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY rid),
l AS (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS raw FROM d),
n AS (SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS lw FROM l WHERE regexp_matches(raw, '{_W}')),
u AS (SELECT rid, count(*) - count(DISTINCT raw) AS n_dup_lines FROM n GROUP BY rid),
h AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
f AS (SELECT host, lw, count(DISTINCT t) AS n, min(doc_id) AS first_id FROM n GROUP BY ALL),
q AS (SELECT host, lw, first_id FROM f JOIN h USING (host) WHERE n > {MIN_LIMIT} AND n > {HOST_SHARE} * texts),
x AS (SELECT rid, sum(len(lw)) AS removed FROM n JOIN q USING (host, lw) WHERE doc_id IS DISTINCT FROM first_id GROUP BY rid),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, removed, n_words - coalesce(removed, 0) AS n_left_words
  FROM d JOIN c USING (rid) LEFT JOIN p USING (rid) LEFT JOIN u USING (rid) LEFT JOIN x USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed IS NOT NULL AND (n_left_words < {MIN_WORDS} OR n_left_words < {MIN_LEFT} * n_words)) AS kept, n_left_words::BIGINT AS n_left_words
FROM b
"""
