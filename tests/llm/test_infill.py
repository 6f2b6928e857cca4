"""Fill-in-middle against plain slicing of lists of units."""

import hashlib
import random
import re

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm import infill, textblocks

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}
ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é\n日本\n\n😀x", "has <P> in it", "<S>", "x<\n<P\n>", "<M\n<M\n>\n", "long line " * 30_000, "row\n" * 40_000, "\r\n \t z", "a\x00b\nc"]


def brute(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", infill.UNITS)
def test_every_cut_of_random_texts(unit):
    rng = random.Random(unit)
    texts = ["".join(rng.choice("ab \n\té日😀") for _ in range(rng.randrange(9))) for _ in range(400)]
    for block in textblocks.blocks(pa.array(texts), 300):
        runs = infill.encode(block, unit)
        units = [re.findall(UNIT[unit], t) for t in texts[block.lo : block.hi]]
        assert runs.counts().tolist() == [len(u) for u in units]
        for share in (0, 0.3, 0.7, 1):
            cuts = np.array([int(share * len(u)) for u in units])
            want = [len("".join(u[:c]).encode()) for u, c in zip(units, cuts)]
            assert (infill.cut_places(runs, block, cuts) - block.starts).tolist() == want


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 7, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + rows[:5] + [(None, "no id\nat all\n")], "doc_id long, text string")
    return docs.withColumns({c: F.lit("clash") for c in ("n", "form", "output", "h", "h1", "prefix_chars")}).coalesce(2)


@pytest.mark.parametrize(("unit", "rate"), [("line", 100), ("word", 100), ("char", 40)])
def test_texts_with_odd_rows(odd, unit, rate):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = infill.fill_in_middle(odd, unit, rate).withColumn("back", infill.restored()).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((i, *brute(i, t, unit, rate)) for i, t in docs), key=key)
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == sorted((str(i), t or "") for i, t in docs)


def test_empty_table_and_wrong_unit(odd):
    assert infill.fill_in_middle(odd.where("doc_id = -1")).count() == 0
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(odd, "page")
