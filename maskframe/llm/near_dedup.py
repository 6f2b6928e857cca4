"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles; equal sets are one node, named by the smallest
   doc_id that has it.  A MinHash signature of ``BANDS`` bands of ``ROWS`` values gives each node
   its buckets: nodes that share one are candidates of each other.
2. First every node of a bucket meets the bucket's smallest node.  Then, in the buckets whose nodes
   are still in several components, all nodes outside the bucket's largest component meet all
   others of another component, in blocks.  So a bucket of n near copies costs n rows, and no list
   of its pairs is ever made.
3. Candidates are verified sequentially: a second, independent signature of one byte a value is
   compared batch by batch, and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below ``MISS``.
4. Survivors are verified exactly on their full sets, most agreeing first; a pair whose ends have
   met in one component needs no more check.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import textblocks as tb
from maskframe.llm.common import cut, documents, forget, map_arrow, map_batches
from maskframe.llm.components import components

SHINGLE = 2
PERCENT = 80
BANDS = 32
ROWS = 6
#: Values of the verifying signature that are compared at a time, and how often at most.
BATCH = 16
BATCHES = 8
#: A candidate is dropped when it reaches the threshold with less than this probability.
MISS = 1e-5
#: A block of a large bucket holds about this many nodes, and shingles, of each side.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1_000_000

WORD = ~tb.table(b" \t\n\x0b\x0c\r")


def least_matches(percent: int = PERCENT, batch: int = BATCH, batches: int = BATCHES, miss: float = MISS) -> list[int]:
    """For each number of compared batches the fewest matches with which a pair goes on.

    With a flat prior a pair with m matches in n values has a Beta(m + 1, n - m + 1) posterior, so
    it reaches the threshold with the probability that a binomial of n + 1 draws is m or less.  Two
    values agree by chance in one of 256 cases, which raises the threshold on matches.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(batch, batch * batches + 1, batch):
        reach, m = (1 - p) ** (n + 1), 0
        while reach < miss:
            m += 1
            reach += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(block: tb.Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block, one after the other, and where each begins.

    A text of fewer words than ``width`` has its whole sequence as one shingle, one without words none.
    """
    folded = block._replace(data=tb.fold_case(block.data))
    w = tb.words(folded, WORD)
    hashes = tb.span_hashes(folded.data, w.starts, w.ends)
    value, at = tb.windows(w, hashes, width)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < width))
    if len(short):
        value = np.concatenate([value, *(tb.window_hashes(hashes[w.first[d] : w.first[d + 1]], w.first[d + 1] - w.first[d]) for d in short)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(block.starts) + 1))


def minima(value: np.ndarray, begin: np.ndarray, first: int, count: int) -> np.ndarray:
    """MinHash values number ``first`` and so on of the sets that start at ``begin``, one row a set."""
    rng = np.random.default_rng(20240502)
    times, flip = rng.integers(0, 1 << 32, (2, first + count), dtype=np.uint32)
    short = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), count), np.uint32)
    for k in range(count if len(begin) else 0):
        out[:, k] = np.minimum.reduceat((short ^ flip[first + k]) * (times[first + k] | np.uint32(1)), begin)
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of the MinHash values."""
    out = np.empty((len(found), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(found), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + found[:, k])
        out[:, band] = key
    return out


def _signed(width: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            value, first = shingle_sets(block, width)
            size = np.diff(first)
            keys = band_keys(minima(value, first[:-1][size > 0], 0, bands * rows), bands, rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id")[block.lo : block.hi], "n_shingles": pa.array(size, pa.int64()),
                "digest": pa.array([hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:])], pa.binary()),
                "keys": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((size > 0) * bands)), pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
            })

    return run


def _profiled(width: int, used: int, values: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            value, first = shingle_sets(block, width)
            some = np.flatnonzero(np.diff(first) > 0)
            signature = minima(value, first[some], used, values).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("doc_id")[block.lo : block.hi].take(pa.array(some)),
                "signature": pa.array([s.tobytes() for s in signature], pa.binary()), "shingles": pa.array([value[first[d] : first[d + 1]].tobytes() for d in some], pa.binary()),
            })

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()])


def survivors(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, least: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (row x of left, row y of right) those that no batch of the signatures rules out, with their matches."""
    matches = np.zeros(len(x), np.int64)
    for k, fewest in enumerate(least):
        if not len(x):
            break
        part = slice(k * batch, (k + 1) * batch)
        matches += np.count_nonzero(left[x, part] == right[y, part], axis=1)
        on = matches >= fewest
        x, y, matches = x[on], y[on], matches[on]
    return x, y, matches


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a and b| >= percent |a or b| of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = sorted((a, b), key=len)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pruned(least: list[int], batch: int):
    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            at = np.arange(rows.num_rows)
            x, _, matches = survivors(_matrix(rows.column("sa")), _matrix(rows.column("sb")), at, at, least, batch)
            yield pa.RecordBatch.from_pydict({"a": rows.column("a").take(pa.array(x)), "b": rows.column("b").take(pa.array(x)), "matches": pa.array(matches, pa.int64())})

    return run


def _verified(percent: int):
    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [[np.frombuffer(s, np.uint64) for s in rows.column(c).to_pylist()] for c in ("ka", "kb")]
        linked = pa.array([similar(a, b, percent) for a, b in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_pydict({c: rows.column(c).filter(linked) for c in "ab"})

    return run


def joined_roots(block: pa.RecordBatch, least: list[int], percent: int, batch: int = BATCH) -> list[tuple[int, int]]:
    """Pairs of roots that links between nodes of a block join, as many as connect them.

    side 0 are nodes outside the bucket's largest component, side 1 a block of all its nodes;
    without side 0 the nodes of side 1 outside the largest component (``small``) take its place.
    """
    node, root, small, side = (block.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "small", "side"))
    right = np.flatnonzero(side == 1)
    left = np.flatnonzero(side == 0) if (side == 0).any() else np.flatnonzero(small)
    signature, shingles = _matrix(block.column("signature")), block.column("shingles")
    pairs = []
    for some in np.array_split(left, len(left) * len(right) // 500_000 + 1):
        meets = (root[some, None] != root[None, right]) & (~small[None, right] | (node[some, None] < node[None, right]))
        x, y = np.nonzero(meets)
        x, y, matches = survivors(signature, signature, some[x], right[y], least, batch)
        pairs.append(np.stack([x, y, matches], 1))
    found = np.concatenate(pairs)
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.get(r, r) != r:
            parent[r] = r = parent.get(parent[r], parent[r])
        return r

    out, sets = [], {}
    for x, y, _ in found[np.argsort(-found[:, 2], kind="stable")].tolist():
        a, b = top(int(root[x])), top(int(root[y]))
        if a == b:
            continue
        for k in (x, y):
            if k not in sets:
                sets[k] = np.frombuffer(shingles[k].as_py(), np.uint64)
        if similar(sets[x], sets[y], percent):
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _met(least: list[int], percent: int, batch: int):
    """Blocks lie one after the other in a partition; one that a batch of rows breaks off is carried on."""
    columns = ("key", "k", "j")

    def joined(blocks: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        links = [link for lo, hi in zip(bounds, bounds[1:]) for link in joined_roots(blocks.slice(lo, hi - lo), least, percent, batch)]
        return pa.RecordBatch.from_pydict({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("ab")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last block so far
        for rows in batches:
            if not rows.num_rows:
                continue
            ids = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)
            new = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            if held and any(held[0].column(c)[0].as_py() != rows.column(c)[0].as_py() for c in columns):
                new = np.append(0, new)
            if len(new):
                last = int(new[-1])
                whole = pa.concat_batches([*held, rows.slice(0, last)])
                before = whole.num_rows - last
                yield joined(whole, sorted({0, *(before + new).tolist()}))
                held, rows = [], rows.slice(last)
            held.append(rows)
        if held:
            whole = pa.concat_batches(held)
            yield joined(whole, [0, whole.num_rows])

    return run


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, batches: int = BATCHES, miss: float = MISS, block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """Every document with its set's size and its component.

    Returns one row per row of ``docs``: doc_id, n_shingles (distinct runs of ``width`` words, A-Z
    lower-cased; words are parted by white space), component_id (smallest doc_id reachable over
    links, itself included) and kept (doc_id is component_id).  Documents are linked if 100 times
    their common shingles are ``percent`` times all their shingles or more.

    A text of fewer words is one shingle; a null text and one without words have none and are
    linked with nothing.  Repeated rows, and texts with equal sets, are linked.  Rows of one doc_id
    with different texts are one document with the links of all of them.  A row without doc_id
    cannot name a component: it is linked with nothing, its component_id is null and it is kept.
    An empty table gives no rows.  Other columns are not looked at.  Sets are told apart by a
    128-bit hash, shingles by a 64-bit one.
    """
    least = least_matches(percent, batch, batches, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(map_arrow(texts, _signed(width, bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>"))
    some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    nodes = cut(signed.where(some).groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")))

    below = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    # cut as in components: a bucket or node with very many rows is then split by the join
    buckets = cut(below.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep <> last").select("key", "rep"))
    shared = cut(below.join(buckets, "key"))
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    profiles = map_arrow(texts.join(wanted, "doc_id"), _profiled(width, bands * rows, batch * batches), "node long, signature binary, shingles binary")
    profiles = cut(profiles.groupBy("node", F.md5("shingles").alias("md5")).agg(F.first("signature").alias("signature"), F.first("shingles").alias("shingles")).drop("md5"))

    pairs = cut(shared.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct())
    side = lambda c, column, name: profiles.select(F.col("node").alias(c), F.col(column).alias(name))
    passed = map_arrow(pairs.join(side("a", "signature", "sa"), "a").join(side("b", "signature", "sb"), "b"), _pruned(least, batch), "a long, b long, matches long")
    best = cut(passed.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b")))
    links = map_arrow(best.join(side("a", "shingles", "ka"), "a").join(side("b", "shingles", "kb"), "b"), _verified(percent), "a long, b long")
    roots = cut(components(links).withColumnRenamed("root", "first_root"))

    placed = cut(shared.join(roots, "node", "left").select("key", "node", "n_shingles", F.coalesce("first_root", "node").alias("root")))
    held = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    total = held.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("root", F.struct("n", -F.col("root"))).alias("top"), F.max("n").alias("most"))
    many = lambda n, size: F.ceil(F.greatest(n / block_nodes, size / BLOCK_SHINGLES)).cast("int")
    total = cut(total.where("roots > 1").select("key", "top", many(F.col("n"), F.col("size")).alias("rights"), F.greatest(F.lit(1), many(F.col("n") - F.col("most"), F.col("size") * (1 - F.col("most") / F.col("n")))).alias("lefts")))
    open_ = placed.join(total, "key").withColumn("small", F.col("root") != F.col("top"))
    number = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = open_.select("key", "node", "root", "small", F.lit(1).alias("side"), every("lefts").alias("k"), number("rights", 1).alias("j"))
    left = open_.where("small AND rights > 1").select("key", "node", "root", "small", F.lit(0).alias("side"), number("lefts", 2).alias("k"), every("rights").alias("j"))
    blocks = right.unionByName(left).join(profiles, "node").repartition("key", "k", "j").sortWithinPartitions("key", "k", "j")
    joins = map_batches(blocks, _met(least, percent, batch), "a long, b long")
    roots2 = components(joins).select(F.col("node").alias("first_root"), F.col("root").alias("last_root"))

    node_roots = nodes.join(roots, "node", "left").select("digest", "node", F.coalesce("first_root", "node").alias("first_root"))
    found = cut(node_roots.join(roots2, "first_root", "left").select("digest", F.coalesce("last_root", "first_root").alias("component_id")))
    forget(nodes, buckets, shared, profiles, pairs, best, roots, placed, total)
    out = lambda df: df.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out(signed.where(some).join(found, "digest")).unionByName(out(signed.where(~some).withColumn("component_id", F.col("doc_id"))))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP12_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + {SHINGLE - 1}] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
r(a, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
c AS (SELECT a, min(root) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON c.a = doc_id LEFT JOIN n USING (doc_id)
"""
