"""Secret scans, in Spark's own functions only.

Patterns give the base spans.  Beyond them, strings of one character class are scanned with a
sliding window: the counts of the characters in the window, and with them the Shannon entropy,
are brought forward by one character in and one out.  Strings with a window above the class's
threshold are secrets unless a base span covers them.  An allow-list pattern suppresses the windows
within ``AROUND`` characters of its match, not those of the rest of a long string.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.common import documents

#: Kinds in order: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),  # the runs are maximal: shorter ones may as well not match
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
#: Character classes for entropy: alphabet, pattern of a candidate, characters of a window, bits.
CLASSES = {
    "hex_entropy": ("0123456789abcdef", "(?<![A-Za-z0-9+/_-])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{16,}(?![A-Za-z0-9+/_-])", 16, 2.8),
    "base64_entropy": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 20, 3.6),
}
#: What lies within AROUND characters of a match of one of these, in the same string, is no secret.
AROUND = 100
ALLOWED = [
    "(?i)example|sample|placeholder|changeme|dummy|lorem",
    "(?i)x{4,}|0{8,}|1234567|abcdefg|deadbeef",
    "(?i)sha(1|256|512)[-_]|uuid|/[a-z]+/[a-z]+/",
]
KINDS = [*BASE, *CLASSES]
_SPAN = "struct<start:int,kind:int,end:int>"
#: Spans are gathered in parts of this many, so that adding one does not copy all before it.
_PART = 256
#: Counts of a window's characters: so many bits each, and so many to a 64-bit number.
_BITS, _IN_WORD = 5, 12
_SCALE = 1 << 40


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """What each step of a fold gives, as one array: step(state, item) is (next state, output or null for none)."""
    none, nested = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")
    start = F.struct(state.alias("state"), none.alias("open"), nested.alias("full"))

    def forward(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        whole = F.size(acc["open"]) >= _PART
        opened = F.when(whole, none).otherwise(acc["open"])
        return F.struct(after.alias("state"), F.when(out.isNull(), opened).otherwise(F.concat(opened, F.array(out))).alias("open"), F.when(whole, F.concat(acc["full"], F.array(acc["open"]))).otherwise(acc["full"]).alias("full"))

    return F.aggregate(items, start, forward, lambda acc: F.concat(F.flatten(acc["full"]), acc["open"]))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, hit) of all matches, in code points: the pieces between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, F.lit(pattern), -1), F.lit(1), F.size(hits)), hits, lambda piece, hit: F.struct(F.length(piece).alias("before"), F.length(hit).alias("long"), hit.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["before"]
        return start + x["long"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["long"]).alias("end"), x["hit"].alias("hit"))

    return running(pairs, F.lit(0), step, "struct<start:int,kind:int,end:int,hit:string>")


def _plain(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def _base_spans(text: Column, kind: int) -> Column:
    pattern, group, least = list(BASE.values())[kind]
    spans = _matches(text, pattern, kind)
    if group:
        counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        spans = F.filter(F.zip_with(spans, counted, lambda s, n: F.when(n >= least, s)), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), F.transform(spans, _plain)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _hot_range(string: Column, alphabet: str, window: int, bits: float, found: Callable[[Column, Column], Column]) -> Column:
    """``found`` of first and last: the stretch from the first to the last window whose entropy reaches ``bits``; null without one.

    The counts of the window's characters go forward by one character in and one out, with the sum
    of c * log2(c) over them: the entropy is log2(window) - sum / window.  Counts take _BITS bits
    each of a few numbers, and the sum is kept in whole 2^-40ths, so it never drifts: the work is
    the same for every character, whatever the string's length.
    """
    term = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(window + 2)]
    gain = F.array(*(F.lit(b - a).cast("long") for a, b in zip(term, term[1:])))  # of count c becoming c + 1
    most = math.floor(window * (math.log2(window) - bits) * _SCALE) + window
    words = [f"w{k}" for k in range(-(-len(alphabet) // _IN_WORD))]

    def spot(c: Column) -> Column:
        p = F.instr(F.lit(alphabet), c) - 1
        return F.when(c.isNotNull(), F.struct(p.alias("place"), F.floor(p / _IN_WORD).cast("int").alias("word"), ((p % _IN_WORD) * _BITS).cast("int").alias("shift")))

    def count(acc: Column, p: Column) -> Column:
        held = acc[words[0]]
        for k, w in enumerate(words[1:], 1):
            held = F.when(p["word"] == k, acc[w]).otherwise(held)
        return F.call_function("shiftright", held, p["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    one = F.lit(1).cast("long")
    unit = lambda p, k: F.when(p["word"] == k, F.call_function("shiftleft", one, p["shift"])).otherwise(F.lit(0).cast("long"))
    hot = lambda acc: (acc["at"] >= window) & (acc["sum"] <= most)
    first = lambda acc: F.when(acc["first"].isNull() & hot(acc), acc["at"] - window).otherwise(acc["first"])
    last = lambda acc: F.when(hot(acc), acc["at"]).otherwise(acc["last"])

    def forward(acc: Column, x: Column) -> Column:
        """Looks at the window so far, then takes the next character in and the oldest one out."""
        same = F.coalesce(x["in"]["place"] == x["out"]["place"], F.lit(False))
        entered = acc["sum"] + F.get(gain, count(acc, x["in"]))
        total = F.when(same, acc["sum"]).when(x["out"].isNull(), entered).otherwise(entered - F.get(gain, count(acc, x["out"]) - 1))
        return F.struct(*((acc[w] + unit(x["in"], k) - unit(x["out"], k)).alias(w) for k, w in enumerate(words)), total.alias("sum"), (acc["at"] + 1).alias("at"), first(acc).alias("first"), last(acc).alias("last"))

    chars = F.split(string, "")
    moves = F.zip_with(chars, F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars), F.lit(1), F.length(string)), lambda c, gone: F.struct(spot(c).alias("in"), spot(gone).alias("out")))
    zero = F.lit(0).cast("long")
    start = F.struct(*(zero.alias(c) for c in (*words, "sum")), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(moves, start, forward, lambda acc: F.when(first(acc).isNotNull(), found(first(acc), last(acc))))


def _entropy_spans(text: Column, name: str) -> Column:
    alphabet, pattern, window, bits = CLASSES[name]
    kind = KINDS.index(name)
    allowed = "|".join(f"(?:{a})" for a in ALLOWED)

    def judged(m: Column) -> Column:
        span = lambda first, last: F.struct((m["start"] + first).alias("start"), m["kind"].alias("kind"), (m["start"] + last).alias("end"))
        return _hot_range(F.lower(m["hit"]) if name.startswith("hex") else m["hit"], alphabet, window, bits, span)

    strings = F.flatten(F.transform(_matches(text, pattern, kind), lambda m: F.when(m["hit"].rlike(allowed), _unsuppressed(m, allowed, window)).otherwise(F.array(m))))
    return F.when(text.rlike(pattern), F.filter(F.transform(strings, judged), lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _unsuppressed(m: Column, allowed: str, window: int) -> Column:
    """The parts of a string that no allow-list match suppresses and that hold a window."""
    near = _matches(m["hit"], allowed, 0)
    begins = F.concat(F.array(F.lit(0)), F.transform(near, lambda x: x["end"] + AROUND))
    ends = F.concat(F.transform(near, lambda x: x["start"] - AROUND), F.array(F.length(m["hit"])))
    part = lambda a, b: F.when(b - a >= window, F.struct((m["start"] + a).alias("start"), m["kind"].alias("kind"), (m["start"] + b).alias("end"), F.substring(m["hit"], a + 1, b - a).alias("hit")))
    return F.filter(F.zip_with(begins, ends, part), lambda x: x.isNotNull())


def _apart(spans: Column, base: Column) -> Column:
    """Those ``spans`` that overlap none of ``base``; both by start, spans not overlapping each other.

    Read in order, a span overlaps an earlier base span if one of those ends after its start; read
    backwards, a later one if it starts before its end.  Two running folds tell, without comparing
    each with each.
    """
    marked = lambda a, new: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s.alias("span")))
    kept = f"struct<start:int,new:int,span:{_SPAN}>"

    def early(end: Column, x: Column) -> tuple[Column, Column]:
        base_span = x["new"] == 0
        return F.when(base_span, F.greatest(end, x["span"]["end"])).otherwise(end), F.when(base_span | (x["start"] >= end), x)

    def late(start: Column, x: Column) -> tuple[Column, Column]:
        base_span = x["new"] == 0
        return F.when(base_span, F.least(start, x["start"])).otherwise(start), F.when(~base_span & (x["span"]["end"] <= start), x["span"])

    forward = running(F.array_sort(F.concat(marked(base, 0), marked(spans, 1))), F.lit(0), early, kept)
    return F.when(F.size(spans) > 0, F.reverse(running(F.reverse(forward), F.lit(1 << 30).cast("int"), late, _SPAN))).otherwise(spans)


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """__text (null: empty), base and added spans of every document: arrays of (start, kind, end), by start, then kind.

    kind is the place in KINDS; places are code points from 0, the end is exclusive.  The columns
    ``keep``, by default doc_id, come first.
    """
    first, second = CLASSES
    text = F.col("__text")
    found = docs.select(*(F.col(c) for c in keep or ["doc_id"]), F.coalesce("text", F.lit("")).alias("__text"))
    found = found.withColumns({"__base": F.array_sort(F.concat(*(_base_spans(text, k) for k in range(len(BASE))))), **{f"__{name}": _entropy_spans(text, name) for name in CLASSES}})
    found = found.withColumn("__added", _apart(F.col(f"__{first}"), F.col("__base")))
    found = found.withColumn("__added", F.concat("__added", _apart(F.col(f"__{second}"), F.array_sort(F.concat("__base", "__added")))))
    return found.drop(*(f"__{name}" for name in CLASSES))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of every document.

    Returns doc_id, n_assign, n_access, n_hex (base matches), base_sha256 (of the base spans as
    kind:start:end, comma-joined), spans (all spans, likewise) and n_entropy.  A null text is an
    empty one: no spans.  Repeated rows are scanned each on their own, a null doc_id is carried
    through, other columns are not looked at.  No shuffle, no Python.
    """
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(_written(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("__base", "__added"))).alias("spans"), F.size("__added").cast("long").alias("n_entropy"),
    )


def masked_text(text: str = "__text", mark: str = "[SECRET]") -> Column:
    """The text of ``find_secrets`` with each span, or run of overlapping spans, replaced by ``mark``.

    The text is cut into blocks once, and what stands between spans is read from the blocks it lies
    in: a place deep in a text costs no more than one at its start.
    """
    many = 4096

    def between(blocks: Column, a: Column, b: Column) -> Column:
        block = lambda x: F.floor(x / F.lit(many)).cast("int")
        part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * many, F.lit(0)) + 1, b - F.greatest(a, k * many))
        return F.when(b > a, F.array_join(F.transform(F.sequence(block(a), block(b - 1)), part), "")).otherwise(F.lit(""))

    def whole(x: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(between(x["blocks"], at, s["start"]), F.lit(mark)))

        last = F.aggregate(x["spans"], F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        tail = bind(last, lambda at: between(x["blocks"], at, x["long"]))
        return F.concat(F.array_join(running(x["spans"], F.lit(0), step, "string"), ""), tail)

    spans = F.array_sort(F.concat("__base", "__added"))
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{many}}}"), F.lit(0))
    masked = bind(F.struct(spans.alias("spans"), blocks.alias("blocks"), F.length(F.col(text)).alias("long")), whole)
    return F.when(F.size("__base") + F.size("__added") > 0, masked).otherwise(F.col(text))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
