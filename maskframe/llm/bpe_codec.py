"""BPE encoding and decoding with the tokenization automaton of ``bpe``.

Words are pre-split as the vocabulary says and encoded by transitions of the automaton; decoding
emits the labels of the arcs that the ids name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.bpe import Vocabulary
from maskframe.llm.common import documents, kept, map_arrow, text_groups

VOCABULARY = "word_bpe_49k.json"
#: Encoded words each Python worker remembers; then it forgets all of them.
REMEMBERED = 150_000
#: Characters of texts that are split and encoded together.
GROUP_CHARS = 1_000_000


class Codec:
    """Text to ids and back, for one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.label = vocab.label | {i: t for t, i in vocab.special.items()}
        self._forget()

    def _forget(self) -> None:
        self._n: dict[str, int] = {}
        self._ids: dict[str, str] = {}
        self._labels: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, all together."""
        new = list(words - self._n.keys())
        if len(self._n) + len(new) > REMEMBERED:
            self._forget()
            new = list(words)
        symbols, label = self.vocab.symbols, self.vocab.label
        for word, path in zip(new, self.vocab.automaton.encode([symbols(w) for w in new])):
            self._n[word] = len(path)
            self._ids[word] = " ".join([str(i) for i in path])
            self._labels[word] = " ".join([label[i] for i in path])

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, parted by spaces as the vocabulary has no decoder of its own."""
        return " ".join([self.label[i] for i in ids])

    def split(self, text: str) -> list[tuple[list[str] | None, str]]:
        """The text's parts: (words, "") or (None, special string)."""
        return [(None, part) if special is not None else (self.vocab.words(part), "") for part, special in self.vocab.parts(text)]

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
        """For each text its number of tokens, and ids and labels of its words."""
        split = [self.split(t) for t in texts]
        self.learn({w for parts in split for words, _ in parts if words for w in words})
        for parts in split:
            n, ids, labels = 0, [], []
            for words, special in parts:
                if words is None:
                    n += 1
                    ids.append(str(self.vocab.special[special]))
                    labels.append(special)
                else:
                    n += sum(map(self._n.__getitem__, words))
                    ids += map(self._ids.__getitem__, words)
                    labels += map(self._labels.__getitem__, words)
            yield n, ids, labels

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings in it become their own ids."""
        return [int(i) for _, ids, _ in self.pieces([text]) for word in ids for i in word.split(" ")]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids and SHA-256 of the decoded text, of each text."""
        for n, ids, labels in self.pieces(texts):
            yield n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(labels).encode()).hexdigest()


def codec(content: str) -> Codec:
    """The codec of a vocabulary, made once in each process."""
    return kept(f"codec {hash(content)}", lambda: Codec(Vocabulary(content)))


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with ``keep_ids`` ids and decoded too.

    path: the vocabulary file, ``public_tokenizers.path("word_bpe_49k.json")`` by default.  Null
    and empty texts have no tokens.  Rows keep their number: repeated rows are encoded each on
    their own, a null doc_id is carried through, other columns are not looked at.  The work is
    one pass without a shuffle; the vocabulary (under 2 MB) is broadcast.
    """
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for part, texts in text_groups(batch, GROUP_CHARS):
            n, ids_sha256, decoded_sha256 = zip(*c.digests(texts))
            out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha256), "decoded_sha256": pa.array(decoded_sha256)}
            if keep_ids:
                ids = [c.encode(t) for t in texts]
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([c.decode(i) for i in ids], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids, keeps="codec")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
