"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards and labels every position; the log
probabilities of all positions of a document are pooled.  It is trained in numpy, by
back-propagation through time, on a bounded sample of labelled rows.  A position depends on its
own word only, so within a task each different word is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import textblocks as tb
from maskframe.llm.common import crc32_mod3, documents, map_arrow

#: Bounds of the training sample: documents, and characters of each, from a place its id decides.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 600
HIDDEN = 8
STEPS = 700
BATCH = 256
RATE = 0.02
#: A longer word is read in parts of this many bytes.
MAX_WORD = 32
#: Words of which each Python worker remembers the result.
REMEMBERED = 400_000
_TRAIN_BYTES = 16
_READ = 1 << 14

WORD = ~tb.table(b" \t\n\v\f\r")
UNKNOWN = "und"


class Model(NamedTuple):
    """For each direction what a byte adds to the gates (256 x 3H), what the state adds (H x 3H); then the output layer."""

    inputs: tuple[np.ndarray, np.ndarray]
    state: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    langs: tuple[str, ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cell(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    n = h.shape[1]
    hu = h @ u
    zr = _sigmoid(gates[:, : 2 * n] + hu[:, : 2 * n])
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(gates[:, 2 * n :] + r * hu[:, 2 * n :])
    return c + z * (h - c), z, r, c, hu[:, 2 * n :]


def gradients(model: Model, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of the words ``x`` (rows of bytes, padded), and its gradients."""
    b, t = x.shape
    n = model.state[0].shape[0]
    mask = np.arange(t)[None, :] < lengths[:, None]
    order = (range(t), range(t - 1, -1, -1))
    saved: tuple[list, list] = ([], [])
    hidden = np.zeros((2, b, t, n))
    for d in (0, 1):
        h = np.zeros((b, n))
        for k in order[d]:
            new, *parts = _cell(model.inputs[d][x[:, k]], h, model.state[d])
            m = mask[:, k, None]
            saved[d].append((k, h, m, *parts))
            h = np.where(m, new, h)
            hidden[d, :, k] = h
    both = np.concatenate([hidden[0], hidden[1]], axis=2)
    logits = both @ model.out + model.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = mask.sum()
    loss = -np.log(p[np.arange(b)[:, None], np.arange(t)[None, :], y[:, None]] + 1e-12)[mask].sum() / total
    p[np.arange(b)[:, None], np.arange(t)[None, :], y[:, None]] -= 1
    p *= mask[:, :, None] / total
    grads = [np.zeros_like(model.inputs[0]), np.zeros_like(model.inputs[1]), np.zeros_like(model.state[0]), np.zeros_like(model.state[1]), np.einsum("btn,btc->nc", both, p), p.sum(axis=(0, 1))]
    back = p @ model.out.T
    for d in (0, 1):
        dh = np.zeros((b, n))
        for k, h, m, z, r, c, hc in reversed(saved[d]):
            dh = dh + back[:, k, d * n : (d + 1) * n]
            g = np.where(m, dh, 0)
            dc = g * (1 - z) * (1 - c * c)
            dz = g * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            gates = np.concatenate([dz, dr, dc], axis=1)
            through = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(grads[d], x[:, k], gates)
            grads[2 + d] += h.T @ through
            dh = np.where(m, through @ model.state[d].T + g * z, dh)
    return loss, grads


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Model:
    """A model of the words of ``texts``; every language is drawn equally often."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        none = np.zeros((0, 0), np.float32)
        return Model((none, none), (none, none), none, none, ())
    rng = np.random.default_rng(seed)
    words = {lang: sorted({w[:_TRAIN_BYTES] for t, label in zip(texts, labels) if label == lang for w in t.encode().split()}) for lang in langs}
    pools = []
    for lang in langs:
        found = [w for w in words[lang] if w]
        x = np.zeros((max(len(found), 1), _TRAIN_BYTES), np.int64)
        for i, w in enumerate(found):
            x[i, : len(w)] = list(w)
        pools.append((x, np.array([len(w) for w in found] or [0])))
    w = lambda *s: rng.normal(0, 0.3, s)
    params = [w(256, 3 * hidden), w(256, 3 * hidden), w(hidden, 3 * hidden), w(hidden, 3 * hidden), w(2 * hidden, len(langs)), np.zeros(len(langs))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        pick = [rng.integers(0, len(pools[k][0])) for k in y]
        x, lengths = np.stack([pools[k][0][i] for k, i in zip(y, pick)]), np.array([pools[k][1][i] for k, i in zip(y, pick)])
        if not lengths.any():
            break
        _, grads = gradients(Model(tuple(params[:2]), tuple(params[2:4]), params[4], params[5], langs), x[:, : lengths.max()], lengths, y)
        rate = RATE * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, first, second):  # Adam
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    params = [p.astype(np.float32) for p in params]
    return Model(tuple(params[:2]), tuple(params[2:4]), params[4], params[5], langs)


def read_words(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word the sum over its positions of the log probabilities of the languages."""
    n, out = model.state[0].shape[0], np.zeros((len(starts), len(model.langs)), np.float32)
    order = np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), _READ):
        part = order[lo : lo + _READ]
        s, many = starts[part], lengths[part]
        alive = [int(np.searchsorted(-many, -k, "left")) for k in range(int(many[0]) if len(many) else 0)]
        ends = np.append(0, np.cumsum(many))
        hidden = np.empty((2, ends[-1], n), np.float32)
        for d in (0, 1):
            h = np.zeros((len(part), n), np.float32)
            for k, m in enumerate(alive):
                place = k if d == 0 else many[:m] - 1 - k
                h[:m] = _cell(model.inputs[d][data[s[:m] + place]], h[:m], model.state[d])[0]
                hidden[d, ends[:m] + place] = h[:m]
        logits = hidden[0] @ model.out[:n] + hidden[1] @ model.out[n:] + model.bias
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        out[part] = np.add.reduceat(logits, ends[:-1], axis=0) if len(part) else 0
    return out


class Reader:
    """Languages of documents; remembers the words it has read."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, first, back = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        new = first[~known]
        values = np.empty((len(hashes), len(self.model.langs)), np.float32)
        values[known] = self.values[at[known]]
        values[~known] = read_words(self.model, data, starts[new], ends[new] - starts[new])
        if len(self.hashes) + len(new) > REMEMBERED:
            self._forget()
        else:
            merged = np.concatenate([self.hashes, hashes[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.values = merged[order], np.concatenate([self.values, values[~known]])[order]
        return values[back]

    def block(self, block: tb.Block) -> tuple[list[str], np.ndarray]:
        """Language and score of each document of a block."""
        n = len(block.starts)
        w = tb.words(block, WORD)
        starts, ends, doc = w.starts, w.ends, w.doc
        if len(starts) and int((ends - starts).max()) > MAX_WORD:
            parts = -(-(ends - starts) // MAX_WORD)
            word = np.repeat(np.arange(len(starts)), parts)
            k = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, ends, doc = starts[word] + k * MAX_WORD, np.minimum(ends[word], starts[word] + (k + 1) * MAX_WORD), doc[word]
        letters = block.data | 0x20
        letter = tb.segment_sums((letters >= 97) & (letters <= 122), block.starts, block.ends) > 0
        for d in np.flatnonzero(~letter & (tb.segment_sums(block.data >= 128, block.starts, block.ends) > 0)):
            letter[d] = any(map(str.isalpha, block.data[block.starts[d] : block.ends[d]].tobytes().decode("utf-8", "replace")))
        langs = self.model.langs
        if not langs or not len(starts):
            return [UNKNOWN] * n, np.zeros(n)
        each = self._words(block.data, starts, ends)
        pooled = np.stack([np.bincount(doc, each[:, c], minlength=n) for c in range(len(langs))], axis=1)
        positions = np.bincount(doc, ends - starts, minlength=n)
        best = pooled.argmax(axis=1)
        mean = pooled / np.maximum(positions, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        score = np.where(letter, p.max(axis=1) / p.sum(axis=1), 0.0)
        return [langs[k] if ok else UNKNOWN for k, ok in zip(best, letter)], score


_reader: dict[bytes, Reader] = {}


def _reader_of(model: Model) -> Reader:
    key = model.out.tobytes() + model.state[0].tobytes()
    if key not in _reader:
        _reader.clear()
        _reader[key] = Reader(model)
    return _reader[key]


def fit_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of a sample of the labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    The sample is at most ``sample_docs`` rows, the first by a hash of the id, with ``sample_chars``
    characters of each from a place the hash decides.  A bound on the hash leaves about three times
    as many candidates, so that is about all that tasks send to the driver, however many they are.
    """
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod3("doc_id") != 1))
    order = F.xxhash64("doc_id", F.lit(11))
    start = F.lit(1) + F.pmod(order, F.greatest(F.length("text") - sample_chars, F.lit(1)).cast("long")).cast("int")
    share = min(1.0, 3 * sample_docs / max(1, mine.select("doc_id", "lang").count()))
    mine = mine.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = mine.select(order.alias("o"), F.substring("text", start, F.lit(sample_chars)).alias("t"), "lang").orderBy("o", "t", "lang").limit(sample_docs).collect()
    return train([r["t"] for r in rows], [r["lang"] for r in rows])


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    held_out: crc32(doc_id as text) mod 3 is 1; such rows are never learned from.  lang_pred is a
    learned language, or ``und`` with score 0 for null texts, texts without a letter, and when no
    row is labelled.  score is the normalised geometric mean of the positions' probabilities.
    Repeated rows are judged each on their own; a null doc_id is carried through (held_out false)
    and never learned from; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model or fit_model(docs)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reader = _reader_of(Model(*shared.value))
        for block in tb.blocks(batch.column("text"), 4 * tb.BLOCK_BYTES):
            langs, score = reader.block(block)
            head = batch.slice(block.lo, block.hi - block.lo)
            yield pa.RecordBatch.from_pydict({"doc_id": head.column("doc_id"), "held_out": head.column("held_out"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), "text")
    return map_arrow(chosen, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
