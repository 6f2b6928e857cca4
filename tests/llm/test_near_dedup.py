"""Near-duplicates with Bayesian verification against comparing all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskframe.llm import near_dedup as nd
from maskframe.llm import textblocks


def shingle_set(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width=2, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    for n, a in enumerate(known):
        for b in known[:n]:
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    out = []
    for k, (i, _) in enumerate(rows):
        root = None if i is None else min(rows[j][0] for j in known if top(j) == top(k))
        out.append((i, len(sets[k]), root, root in (i, None)))
    return sorted(out, key=str)


def edited(rng, words, share):
    return [rng.choice("qwertzuiop") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed, families, copies):
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(copies):
            out.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1, 0.15]))))
    return out


ODD = [None, None, "", " \n", "One", "oNE", "two words", "Two\tWORDS", "日本語 テキスト", "日本語 テキスト", "a\x00b c", "x" * 70_000, "long text " * 9_000, "long text again " * 9_000]


def test_limits_of_the_posterior():
    least = nd.least_matches(80, 16, 8, 1e-5)
    assert least == sorted(least) and all(m <= 16 * k for k, m in enumerate(least, 1))
    rng = np.random.default_rng(5)
    p = 0.8 + 0.2 / 256
    hits = (rng.random((200_000, 128)) < p).cumsum(axis=1)[:, 15::16]
    assert (hits < np.array(least)).any(axis=1).mean() < 2e-4
    low = (rng.random((20_000, 128)) < 0.5).cumsum(axis=1)[:, 15::16]
    assert (low >= np.array(least)).all(axis=1).mean() < 1e-3
    assert nd.least_matches(80, 16, 8, 1e-2) > least


def test_sets_of_blocks():
    texts = [*corpus(1, 5, 2), *ODD]
    for block in textblocks.blocks(pa.array(texts), 500):
        value, first = nd.shingle_sets(block)
        assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts[block.lo : block.hi]]
        assert all((np.diff(value[a:b].astype(object)) > 0).all() for a, b in zip(first, first[1:]))


def test_exact_similarity():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(30), rng.randrange(1, 30))) for _ in "ab")
        both = len(set(a) & set(b))
        assert nd.similar(np.array(a, np.uint64), np.array(b, np.uint64), 60) == (100 * both >= 60 * len({*a, *b}))


@pytest.mark.parametrize(("width", "percent", "block_nodes"), [(2, 80, 512), (2, 80, 4), (3, 60, 7)])
def test_components_with_odd_rows(spark, width, percent, block_nodes):
    rng = random.Random(width)
    texts = [*corpus(4, 20, 6), *corpus(5, 1, 60), *ODD]
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    rows += [*rows[3:6], (None, texts[0]), (None, None), (rows[9][0], texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "key", "root", "digest", "keys", "kept", "n", "side")}).coalesce(3)
    got = nd.near_duplicates(docs, width, percent, bands=64, rows=4 if percent < 80 else 6, block_nodes=block_nodes)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width, percent)


def test_chain_in_one_bucket(spark):
    """Texts that each link with the next only: one component, although few link with the bucket's first."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 240])) for k in range(30)]
    assert sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_nodes=5).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
