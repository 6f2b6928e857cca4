"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens (runs of a-z, 0-9) that any URL it
matches must have.  A literal that may be part of a longer token gives its runs of GRAM characters
instead.  Tokens and runs are counted over all URLs, each rule is filed under its rarest one, and a
URL's own tokens, and their runs, fetch the few rules whose expressions then run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.common import map_arrow

#: Host and path rules, in the order host, path, verdict; the longest that fits decides.
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Where no host rule fits: expressions over the lower-cased URL that block it.
PATTERNS = [
    ("spam-farm", r"://([^/?#]*\.)?spam-farm\."),
    ("cheap-pills", r"://([^/?#]*\.)?cheap-pills\."),
    ("casino", r"://[^/?#]*casino"),
    ("feed-tracking", r"[?&]utm_source=feed(&|#|$)"),
]
#: Rules are broadcast; more than this many are refused rather than sent to every executor.
MAX_RULES = 200_000

#: Characters of the runs that stand for a literal inside a longer token.
GRAM = 3

_TOKEN = re.compile("[a-z0-9]+")
#: One part of an expression (group, class, escape or character) and what says how often it comes.
_PART = re.compile(r"(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|\[\^?\]?(?:[^\]\\]|\\.)*\]|\\.|.)([?*+]|\{[^}]*\})?", re.S)
_UNKNOWN = "\x00"


class Rule(NamedTuple):
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int  #: of the rules that match, the highest rank decides; host rules have their length, patterns 0


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    return lower_ascii(rest[:end]), re.split("[?#]", rest[end:], maxsplit=1)[0]


def _whole_tokens(literal: str) -> tuple[str, ...]:
    """Tokens of a literal that starts at a token's start; the last counts only if something ends it."""
    return tuple(m[0] for m in _TOKEN.finditer(lower_ascii(literal)) if m.end() < len(literal))


def host_rule(host: str, path: str, verdict: str) -> Rule:
    return Rule(host + path, rf"^://(?:[^/?#]*\.)?{re.escape(lower_ascii(host))}(?=/|\Z){re.escape(path)}", _whole_tokens(host + (path or "/")), verdict, len(host + path))


def _literals(pattern: str) -> str:
    """The characters that every match must have, in order; _UNKNOWN where anything or nothing may stand."""
    out = ""
    for part, times in _PART.findall(pattern):
        if part == "|":
            return ""
        if part[0] == "\\" and not part[1].isalnum():
            part = part[1]
        elif part in ".^$":
            part = _UNKNOWN
        out += part if len(part) == 1 and not times else _UNKNOWN
    return out


def grams(token: str) -> set[str]:
    """Runs of GRAM characters, marked apart from whole tokens."""
    return {"~" + token[k : k + GRAM] for k in range(len(token) - GRAM + 1)}


def pattern_rule(name: str, pattern: str) -> Rule:
    """A blocking expression; its tokens are the whole ones it can't match without, or else runs of its literals."""
    bare = _literals(pattern)
    whole = tuple(m[0] for m in _TOKEN.finditer(bare) if _ended(bare, m.start() - 1) and _ended(bare, m.end()))
    return Rule(name, pattern, whole or tuple(sorted({g for m in _TOKEN.finditer(bare) for g in grams(m[0])})), "block", 0)


def _ended(bare: str, k: int) -> bool:
    """Whether a token next to this place of an expression can't go on in the URL."""
    return 0 <= k < len(bare) and not bare[k].isalnum() and bare[k] != _UNKNOWN


class RuleIndex:
    """Rules by their rarest token or run; only those without a literal of GRAM characters are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            made = (rule, re.compile(rule.regex))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(made)
            else:
                self.always.append(made)
        self.has_grams = any(t[0] == "~" for t in self.by_token)

    def candidates(self, lower: str) -> Iterator[tuple[Rule, re.Pattern]]:
        yield from self.always
        tokens = set(_TOKEN.findall(lower))
        if self.has_grams:
            tokens = tokens.union(*map(grams, tokens))
        for token in tokens & self.by_token.keys():
            yield from self.by_token[token]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """host, path, host rule, verdict, pattern, number of expressions run."""
        host, path = split_url(url)
        lower = lower_ascii(url or "")
        place = f"://{host}{path}" if host or path else ""
        best, pattern, tried = None, None, 0
        for rule, expression in self.candidates(lower):
            tried += 1
            if not expression.search(place if rule.rank else lower):
                continue
            if rule.rank == 0:
                pattern = min(rule.name, pattern) if pattern else rule.name
            elif best is None or (rule.rank, rule.name) > (best.rank, best.name):
                best = rule
        verdict = best.verdict if best else "block" if pattern else "allow"
        return host, path, best.name if best else None, verdict, None if best else pattern, tried


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """Verdict of every page by its URL.

    Returns page_id, host, path, rule (the longest host rule that fits, else null), verdict (the
    rule's; else block if a pattern matches, else allow), pattern (which, else null) and n_tried
    (expressions run).  A null URL or one without ``://`` has empty host and path and meets no
    host rule.  Repeated rows are judged each on their own, a null page_id is carried through,
    other columns are not read.  Token counts take one small aggregation (only tokens and runs of
    rules are counted); judging is one pass without a shuffle.
    """
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(*p) for p in patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})] or [("",)], "token string")
    found = F.split(F.translate(F.col("url").cast("string"), ascii_uppercase, ascii_lowercase), "[^a-z0-9]+")
    if any(t[0] == "~" for r in rules for t in r.tokens):
        runs = F.transform(F.filter(found, lambda t: F.length(t) >= GRAM), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda k: F.concat(F.lit("~"), F.substring(t, k, F.lit(GRAM)))))
        found = F.concat(found, F.flatten(runs))
    tokens = pages.select(F.explode(F.array_distinct(found)).alias("token"))
    counts = dict(tokens.join(F.broadcast(wanted), "token").groupBy("token").count().collect())
    shared = spark.sparkContext.broadcast((rules, counts))
    made: list[RuleIndex] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(RuleIndex(*shared.value))
        found = [made[0].judge(u) for u in batch.column("url").to_pylist()]
        columns = list(zip(*found)) if found else [()] * 6
        names = ("host", "path", "rule", "verdict", "pattern")
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id")} | {n: pa.array(c, pa.string()) for n, c in zip(names, columns)} | {"n_tried": pa.array(columns[5], pa.int64())})

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), run, "page_id long, host string, path string, rule string, verdict string, pattern string, n_tried long")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("n_tried")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, url, lower(url) AS low,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host,
    CASE WHEN contains(url, '://') THEN regexp_extract(regexp_replace(substr(url, instr(url, '://') + 3), '^[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path
  FROM pages
), hosts AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM hosts
), judged AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(low, '://[^/?#]*casino') THEN 'casino'
    WHEN regexp_matches(low, '://([^/?#]*\.)?cheap-pills\.') THEN 'cheap-pills'
    WHEN regexp_matches(low, '[?&]utm_source=feed(&|#|$)') THEN 'feed-tracking'
    WHEN regexp_matches(low, '://([^/?#]*\.)?spam-farm\.') THEN 'spam-farm' END AS pattern
  FROM ruled
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM judged
"""
