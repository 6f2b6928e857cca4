"""N-gram Jaccard join: an LSH forest of MinHash prefix tries, then exact verification.

1. Every text becomes its set of 5-word shingles and a MinHash signature; the signature is cut
   into ``TREES`` labels of up to ``MAX_DEPTH`` values.  Each label is a path in one prefix trie.
2. The matched prefix is shortened from the full label until the modelled recall at the threshold,
   1 - (1 - t^depth)^trees, reaches ``RECALL``.  The texts below one trie node at that depth are
   candidates of each other; an edge from each to the node's smallest text joins them, so a node
   of n texts costs n rows, not n^2.
3. Candidate clusters (components of those edges) are verified exactly, every pair once: shingle
   sets meet in bounded blocks, and intersections come from a 0/1 matrix product.  Only link
   counts and a spanning forest leave a block.
4. Components of the verified links are the classes.

Exact copies are one node from the start, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import textblocks as tb
from maskframe.llm.common import cut, documents, map_arrow
from maskframe.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 10
RECALL = 0.9999
#: A block of a large cluster holds at most about this many texts, and shingles.
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 2_000_000
_COLUMNS = 4096

WORD = tb.table(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix whose modelled recall at the threshold reaches ``recall``; at least 1."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block's documents in order, and the number of each document's first.

    A text of one to four words is one shingle; one without words has none.
    """
    w = tb.words(block, WORD)
    hashes = tb.span_hashes(block.data, w.starts, w.ends)
    value, at = tb.windows(w, hashes, SHINGLE)
    doc = w.doc[at]
    short = [(d, w.first[d], w.first[d + 1]) for d in np.flatnonzero((w.counts() > 0) & (w.counts() < SHINGLE))]
    if short:
        value = np.concatenate([value, *(tb.window_hashes(hashes[a:b], b - a) for _, a, b in short)])
        doc = np.concatenate([doc, [d for d, _, _ in short]])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    return value, np.searchsorted(doc, np.arange(len(block.starts) + 1))


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def trie_nodes(value: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each document with shingles, the node its label reaches at ``depth`` in each tree."""
    begin = first[:-1][np.diff(first) > 0]
    if not len(begin):
        return np.zeros((0, trees), np.uint64)
    short = (value >> np.uint64(32)).astype(np.uint32)
    times, flip = _parameters(trees * depth)
    out = np.empty((len(begin), trees), np.uint64)
    for tree in range(trees):
        node = np.full(len(begin), tree + 1, np.uint64)
        for k in range(tree * depth, (tree + 1) * depth):
            node = tb.mix(node * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((short ^ flip[k]) * times[k], begin))
        out[:, tree] = node
    return out


def _signatures(trees: int, depth: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            value, first = shingles(block)
            nodes, many = trie_nodes(value, first, trees, depth), np.diff(first)
            cuts = np.append(0, np.cumsum((many > 0) * trees)).astype(np.int32)
            head = batch.slice(block.lo, block.hi - block.lo)
            yield pa.RecordBatch.from_pydict({
                "doc_id": head.column("doc_id"), "node": head.column("node"), "n_shingles": pa.array(many, pa.int64()),
                "prefixes": pa.ListArray.from_arrays(pa.array(cuts), pa.array(nodes.reshape(-1).view(np.int64))),
            })

    return run


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batch.column("text")):
        value, first = shingles(block)
        head = batch.slice(block.lo, block.hi - block.lo)
        yield pa.RecordBatch.from_pydict({
            "node": head.column("node"), "copies": head.column("copies"), "cluster": head.column("cluster"), "blocks": head.column("blocks"), "bin": head.column("bin"),
            "shingles": pa.array([np.unique(value[a:b]).tobytes() for a, b in zip(first, first[1:])], pa.binary()),
        })


def _matrix(sets: list[np.ndarray], column: np.ndarray, lo: int, hi: int, first: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sets)), np.diff(first))
    here = (column >= lo) & (column < hi)
    out = np.zeros((len(sets), hi - lo), np.float32)
    out[row[here], column[here] - lo] = 1
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of ``threshold`` or more; right None: left against itself, without the diagonal."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    first = np.append(0, np.cumsum(sizes))
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)  # a shingle of one text is in no intersection
    column, n = number[column], int((times > 1).sum())
    k = len(left)
    shared = np.zeros((k, len(right) if right is not None else k), np.float32)
    for lo in range(0, n, _COLUMNS):
        m = _matrix(both, column, lo, min(lo + _COLUMNS, n), first)
        shared += m[:k] @ (m[k:] if right is not None else m).T
    other = sizes[k:] if right is not None else sizes
    union = sizes[:k, None] + other[None, :] - shared
    out = shared + 1e-6 >= threshold * union
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _forest(nodes: np.ndarray, link: np.ndarray) -> np.ndarray:
    """For each node the smallest node of its component by ``link`` (square)."""
    label = nodes.copy()
    far = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(link, label[None, :], far).min(axis=1, initial=far))
        if (new == label).all():
            return label
        label = new


def verify_pairs(nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Root of each node, and the documents it is linked to. side: only pairs between side 0 and side 1 count."""
    if side is None:
        link = linked(sets, None, threshold)
    else:
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        link = np.zeros((len(nodes), len(nodes)), bool)
        if len(p) and len(q):
            link[np.ix_(p, q)] = part = linked([sets[i] for i in p], [sets[i] for i in q], threshold)
            link[np.ix_(q, p)] = part.T
    return _forest(nodes, link), link @ copies


def _verify(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in rows.groupby("cluster", sort=False):
            nodes, copies = g["node"].to_numpy(np.int64), g["copies"].to_numpy(np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            root, n = verify_pairs(nodes, copies, sets, (g["block"] == key[2]).to_numpy().astype(int) if key[1] != key[2] else None, threshold)
            found.append(pd.DataFrame({"a": nodes, "b": root, "n": n}))
        return pd.concat(found)

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> DataFrame:
    """Every document with its class and its links.

    Returns one row per row of ``docs``: doc_id, class_id (smallest doc_id of all documents joined
    with it by links, directly or through others), n_links (other documents whose shingle sets
    have a similarity of ``threshold`` or more, copies included) and n_copies (documents with the
    very same text, itself included).

    Words are runs of letters and digits, lower-cased.  Texts of fewer than five words are one
    shingle.  Null texts and texts without words are linked to nothing: class_id is their own
    doc_id, n_links 0, n_copies 1.  Repeated rows are copies of each other.  A null doc_id is
    carried through and never a class_id if the class has another.  Texts are told apart by a
    64-bit hash.  Other columns of ``docs`` are not looked at.
    """
    depth = matched_depth(threshold, trees, max_depth, recall)
    key = F.xxhash64("text").alias("node")
    signed = cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.lower("text").alias("text")), _signatures(trees, depth), "doc_id long, node long, n_shingles long, prefixes array<long>"))
    some = signed.where("n_shingles > 0")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))

    below = some.groupBy("node").agg(F.first("prefixes").alias("prefixes")).select("node", F.explode("prefixes").alias("prefix"))
    # cut as in components: a trie node, class or text with very many rows is then split by the join
    shared = cut(below.groupBy("prefix").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("prefix", "b"))
    clusters = components(below.join(shared, "prefix").select(F.col("node").alias("a"), "b"))

    members = clusters.select("node", F.col("root").alias("cluster")).join(nodes, "node")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("size"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("size") / BLOCK_SHINGLES)).cast("int")))
    texts, size = sizes.where("blocks = 1").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins = int(max(1, texts // BLOCK_TEXTS, size // BLOCK_SHINGLES)) * 2
    members = members.join(sizes.select("cluster", "blocks"), "cluster").withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")))

    chosen = members.select("node", "first_id", "copies", "cluster", "blocks", "bin")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key).where("text is not null")
    found = text.join(chosen.hint("shuffle_hash"), (text["node"] == chosen["node"]) & text["doc_id"].eqNullSafe(chosen["first_id"])).select(chosen["node"], F.lower("text").alias("text"), "copies", "cluster", "blocks", "bin")
    sets = map_arrow(found.dropDuplicates(["node"]), _sets, "node long, copies long, cluster long, blocks int, bin long, shingles binary")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    met = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    checked = cut(met.groupBy("bin", "p", "q").applyInPandas(_verify(threshold), "a long, b long, n long"))

    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(checked)
    rooted = cut(nodes.join(roots, "node", "left").select("node", "first_id", "copies", F.coalesce("root", "node").alias("root")))
    ids = cut(rooted.groupBy("root").agg(F.min("first_id").alias("class_id")))
    by_node = cut(rooted.join(ids, "root").join(links, "node", "left").select("node", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links")))
    plain = signed.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return some.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")).unionByName(plain)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` without near copies: of each class the one whose doc_id is the class_id.

    All columns are kept.  Of repeated rows (same doc_id and text) one stays.  Rows without doc_id stay.
    """
    first = F.col("doc_id") == F.col("class_id")
    keep = cut(jaccard_classes(docs).where(first).groupBy(F.col("doc_id").alias("__keep")).agg(F.count("*").alias("__rows")))
    left = docs.join(keep, F.col("doc_id").cast("long") == F.col("__keep"))
    if keep.where("__rows > 1").limit(1).count():  # repeated rows are rare: only then are whole rows compared
        once, again = left.where("__rows = 1"), left.where("__rows > 1").dropDuplicates()
        left = once.unionByName(again)
    return left.drop("__keep", "__rows").unionByName(docs.where("doc_id is null"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, md5(text) AS m, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, w[i:i + {SHINGLE - 1}] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE o >= {THRESHOLD} * (p.n + q.n - o) - 1e-6),
r(a, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
c AS (SELECT a, min(root) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT doc_id, count(*) OVER (PARTITION BY m) AS n_copies FROM w WHERE len(w) > 0)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM documents JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id LEFT JOIN m USING (doc_id)
"""
