"""Token counts by prefix dynamic programming.

One pass over each different word works out the exact number of tokens of every one of its
prefixes: the count at the start of a prefix's last token, and one.  These arrays are stored, and
with the counts at word bounds they give the tokens of every prefix of a text: how long a text is,
whether it is over a limit, and where to cut it to fit a budget.  No tokens are ever listed.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.bpe import Vocabulary
from maskframe.llm.common import documents, kept, map_arrow, text_groups

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Words of which each Python worker stores the counts, and bytes of these; then it forgets all of them.
REMEMBERED = 200_000
STORED_BYTES = 64 << 20
#: Characters of texts that are split and counted together.
GROUP_CHARS = 1_000_000


class _Stored(dict):
    """Word to the tokens of each of its prefixes (in bytes), the empty one first."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.bytes = vocab, 0

    def learn(self, words: set[str]) -> None:
        """Store the words that are not known yet, all together."""
        new = list(words - self.keys())
        if len(self) + len(new) > REMEMBERED or self.bytes > STORED_BYTES:
            self.clear()
            new, self.bytes = list(words), 0
        symbols = self.vocab.symbols
        counts = self.vocab.automaton.prefix_counts([symbols(w) for w in new])
        self.update(zip(new, counts))
        self.bytes += sum([c.nbytes if isinstance(c, np.ndarray) else len(c) for c in counts])

    def __missing__(self, word: str) -> bytes:
        self.learn({word})
        return self[word]


class TokenCounter:
    """Counts for one byte-level vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.stored = _Stored(vocab)

    def of_word(self, word: str) -> int:
        return int(self.stored[word][-1])

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; new words of all of them are stored together."""
        split = [[(None, part) if special is not None else (self.vocab.words(part), "") for part, special in self.vocab.parts(t)] for t in texts]
        self.stored.learn({w for parts in split for words, _ in parts if words for w in words})
        return [sum([1 if words is None else sum(map(self.of_word, words)) for words, _ in parts]) for parts in split]

    def count(self, text: str) -> int:
        """Tokens of one whole text."""
        return self.counts([text])[0]

    def _plain(self, text: str) -> list[int]:
        """Tokens of each prefix (in characters) of a text whose special strings are plain text."""
        out, at, base = [0], 0, 0  # base: tokens of the words before the current one
        run = run_base = run_byte = 0  # where the white space before a place began, the tokens up to there, and its bytes so far
        blanks: bytes | np.ndarray = b""  # counts of all prefixes of that white space, as one word each
        for word in self.vocab.words(text):
            counts = self.stored[word]
            byte = 0
            for k, c in enumerate(word, 1):
                byte += len(c.encode())
                n = base + int(counts[byte])
                if c.isspace():  # white space at the end of a prefix is one word, a prefix of the whole run's
                    if at + k == 1 or not text[at + k - 2].isspace():
                        run, run_base, run_byte = at + k - 1, base, 0
                        blanks = self.stored[_BLANKS.match(text, run)[0]]
                    run_byte += len(c.encode())
                    n = run_base + int(blanks[run_byte])
                elif k == 2 and word in ("'re", "'ve", "'ll"):
                    n = base + self.of_word("'") + self.of_word(c)
                out.append(n)
            at += len(word)
            base += int(counts[-1])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of each prefix (in characters), as encoding that prefix by itself gives them."""
        out = [0]
        parts = list(self.vocab.parts(text))
        k = 0
        while k < len(parts):
            part, special = parts[k]
            base = out[-1]
            if special is None:
                after = parts[k + 1][0] if k + 1 < len(parts) else ""
                plain = self._plain(part + after)  # a special string cut short is plain text
                out += [base + n for n in plain[1 : len(part) + len(after)]] if after else [base + n for n in plain[1:]]
                if after:
                    out.append(base + self.count(part) + 1)
                    k += 1
            else:
                out += [base + n for n in self._plain(part)[1:-1]] + [base + 1]
            k += 1
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Walks words until the budget is passed and looks at single prefixes only around there.
        """
        at = used = 0
        end, before = len(text), [(0, 0)]  # before: places between words, and the tokens up to there
        for part, special in self.vocab.parts(text):
            start = at
            for word in [part] if special is not None else map(_MATCHED, self.vocab.pattern.finditer(part)):
                n = 1 if special is not None else self.of_word(word)
                if used + n > budget:
                    end = at + len(word)
                    break
                at, used = at + len(word), used + n
                before.append((at, used))
            else:
                continue
            break
        else:
            return len(text)
        while before[-1][0] > start and text[before[-1][0] - 1].isspace():  # white space that the word goes on with
            before.pop()
        if special is not None:  # cut short it is plain text, part of what stands before it
            while before[-1][0]:
                before.pop()
        at, used = before[-1]
        while end < len(text) and text[end].isspace():
            end += 1
        while True:
            counts = self.prefix_counts(text[at:end])
            best = max(k for k, n in enumerate(counts) if used + n <= budget)
            if best < end - at or end == len(text):
                return at + best
            end = min(len(text), at + 2 * (end - at) + 64)


_MATCHED = operator.methodcaller("group")
#: White space as ``str.isspace`` has it.
_BLANKS = re.compile(r"\s+")


def counter(content: str) -> TokenCounter:
    """The counter of a vocabulary, made once in each process."""
    return kept(f"counter {hash(content)}", lambda: TokenCounter(Vocabulary(content)))


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) and fit_chars of every whole text.

    fit_chars: characters of the longest prefix with at most ``limit`` tokens.  path: a byte-level
    vocabulary file, ``public_tokenizers.path("byte_bpe_50k.json")`` by default.  A null text
    counts as an empty one: all 0 and false.  Repeated rows are counted each on their own, a null
    doc_id is carried through, other columns are not looked at.  One pass, no shuffle; the
    vocabulary (under 2 MB) is broadcast.
    """
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counter(content.value)
        for part, texts in text_groups(batch, GROUP_CHARS):
            n = c.counts(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([k > limit for k in n]), "fit_chars": pa.array([c.fit(t, limit) if k > limit else len(t) for t, k in zip(texts, n)], pa.int64()),
            })

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", keeps="counter")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
