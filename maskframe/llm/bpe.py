"""Byte-pair vocabularies, and the tokenization automaton compiled from their merges.

The automaton starts as one state with a loop for every base symbol.  Each merge (a, b) -> c, in
order of rank, adds a gadget: every arc a is led to a copy of its target that lacks the arc b, and
wherever a then b could be read, an arc c leads to the old target of b.  What the automaton then
accepts are exactly the token sequences that byte-pair merging makes, one for each string.

All arcs of one label have one target, so a state is named by the label last read.  Its arcs are
kept as the record of the gadgets: the copies made for label a lack one label each, from the rank
of that gadget on, and before c there was, as of the rank of its gadget, the state of b.  So the
whole automaton is a table of merges (what may not follow, and since when) with the left and right
part of every label, as large as the list of merges; ``has_arc`` reads it.

Words are strings of bytes, a word-end mark being the byte 0xFF, which no UTF-8 text has.  At each
place of a word exactly one state is live, and its arcs lead on to later places.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

END = b"\xff"
#: Longer words go one by one, shorter ones in batches of about so many bytes.
LONG = 64
BATCH_BYTES = 400_000
_SLOTS = 1 << 20
_REMEMBERED = 100_000
_NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Automaton:
    """Arcs of a merge list; tokens are byte strings, states are the ids of the tokens last read (-1: none)."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        self.token = {i: t for t, i in ids.items()}
        n = max(ids.values()) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.after: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            c = ids[a + b]
            self.rank[c], self.left[c], self.right[c] = k, ids[a], ids[b]
            self.after[ids[a], ids[b]] = k
        self._keys = np.array(sorted((a << 32) | b for a, b in self.after), np.int64)
        self._since = np.array([self.after[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in self._keys], np.int64)
        merged = np.flatnonzero(self.rank >= 0)
        made = self.has_arcs(self.left[merged], self.right[merged], self.rank[merged])  # a merge that no text ever has makes no token
        self.usable = {t: i for t, i in ids.items()}
        for i in merged[~made]:
            del self.usable[self.token[int(i)]]
        self._lists = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self._known: dict[tuple[int, int], bool] = {}
        self.heads = {t[:k] for t in self.usable for k in range(1, len(t) + 1)}
        self._build_trie()
        self._slot_key, self._slot = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)

    def _build_trie(self) -> None:
        """Tokens by their bytes: a row of 256 next nodes for each node that has any."""
        number = {h: k for k, h in enumerate(sorted(self.heads), 1)}
        self._token_at = np.full(len(number) + 1, -1, np.int64)
        for t, i in self.usable.items():
            self._token_at[number[t]] = i
        parents = sorted({number.get(h[:-1], 0) for h in self.heads})
        self._row = np.full(len(number) + 1, -1, np.int64)
        self._row[parents] = np.arange(len(parents))
        self._next = np.full(len(parents) * 256, -1, np.int32)
        for h, k in number.items():
            self._next[self._row[number.get(h[:-1], 0)] * 256 + h[-1]] = k

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in this state."""
        rank, left, right = self._lists
        as_of = _NEVER
        while True:
            if self.after.get((state, token), as_of) < as_of:
                return False
            if rank[token] > rank[state]:  # the arc came with or after the state, where its left part could be read
                as_of, token = min(as_of, rank[token] + 1), left[token]
            elif rank[state] >= 0:
                as_of, state = rank[state], right[state]
            else:
                return True

    def has_arcs(self, states: np.ndarray, tokens: np.ndarray, as_of: np.ndarray | None = None) -> np.ndarray:
        """``has_arc`` for many at once."""
        out = np.ones(len(states), bool)
        live, x, u = np.arange(len(states)), states, tokens
        as_of = np.full(len(states), _NEVER) if as_of is None else as_of
        while len(live):
            key = (x << 32) | u
            at = np.searchsorted(self._keys, key)
            at[at == len(self._keys)] = 0
            cut = (self._keys[at] == key) & (self._since[at] < as_of) if len(self._keys) else np.zeros(len(live), bool)
            out[live[cut]] = False
            rx, ru = self.rank[x], self.rank[u]
            go = ~cut & ((rx >= 0) | (ru >= 0))
            live, x, u, as_of, rx, ru = live[go], x[go], u[go], as_of[go], rx[go], ru[go]
            newer = ru > rx
            as_of = np.where(newer, np.minimum(as_of, ru + 1), rx)
            x, u = np.where(newer, x, self.right[x]), np.where(newer, self.left[u], u)
        return out

    def _follow(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``has_arcs`` through a table of transitions filled so far (of fixed size, new ones replace old ones)."""
        key = (states << 32) | tokens
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self._slot_key[slot] != key)
        out = self._slot[slot]
        if len(new):
            out[new] = found = self.has_arcs(states[new], tokens[new])
            self._slot_key[slot[new]], self._slot[slot[new]] = key[new], found
            # two keys of this call can share a slot: the last one has it, with its own answer
        return out

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of a word the number of its tokens, and the last of them."""
        n, usable, heads, known = len(word), self.usable, self.heads, self._known
        count, state = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, more, j = state[i], count[i] + 1, i + 1
            if i and here < 0:
                continue  # inside a base symbol
            while (part := word[i:j]) in heads:
                token = usable.get(part)
                if token is not None:
                    ok = here < 0 or known.get((here, token))
                    if ok is None:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        ok = known[here, token] = self.has_arc(here, token)
                    if ok:
                        count[j], state[j] = more, token
                if j == n:
                    break
                j += 1
        return count, state

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: the labels of the one accepted path that spells it."""
        out: list[list[int]] = [[]] * len(words)
        for part in self._batches(words):
            for k, path in zip(part, self._encode_batch([words[k] for k in part])):
                out[k] = path
        for k, w in enumerate(words):
            if len(w) > LONG:
                state, at, path = self.prefixes(w)[1], len(w), []
                while at:
                    path.append(state[at])
                    at -= len(self.token[state[at]])
                out[k] = path[::-1]
        return out

    def prefix_counts(self, words: list[bytes]) -> list[bytes | np.ndarray]:
        """For each word the number of tokens of each of its prefixes, from the empty one to the whole.

        Of a byte string longer than LONG it is an array, else as many bytes: one a prefix.
        """
        out: list[bytes | np.ndarray] = [b"\0"] * len(words)
        for part in self._batches(words):
            order, many, place, _, _, count = self._walk([words[k] for k in part], counted=True)
            stored = count.astype(np.uint8).tobytes()
            for k, p, n in zip(order.tolist(), place.tolist(), many.tolist()):
                out[part[k]] = stored[p : p + n + 1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = np.array(self.prefixes(w)[0], np.uint32)
        return out

    @staticmethod
    def _batches(words: list[bytes]) -> Iterator[list[int]]:
        """Numbers of the words of 1 to LONG bytes, in lists of about BATCH_BYTES of them."""
        part, size = [], 0
        for k, w in enumerate(words):
            if 0 < len(w) <= LONG:
                part.append(k)
                size += len(w)
                if size >= BATCH_BYTES:
                    yield part
                    part, size = [], 0
        if part:
            yield part

    def _walk(self, words: list[bytes], counted: bool = False) -> tuple[np.ndarray, ...]:
        """Last token of every prefix of every word and its bytes, and with ``counted`` the prefix's number of tokens.

        Words stand in falling length: order and lengths of them, and where the places of each begin.
        """
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join([words[k] for k in order]), np.uint8)
        many = lengths[order]
        first = np.cumsum(many) - many
        place = first + np.arange(len(many))  # of prefix 0 of each word; prefix i is i further on
        total = len(data) + len(many)
        state, size, count = np.full(total, -1, np.int64), np.zeros(total, np.int64), np.zeros(total if counted else 0, np.int32)
        for i in range(int(many[0])):
            m = int(np.searchsorted(-many, -i, "left"))  # words longer than i
            live = np.arange(m)
            here = state[place[:m] + i]
            if i:
                live = live[here >= 0]
            row, d = np.zeros(len(live), np.int64), i
            while len(live):
                node = self._next[row * 256 + data[first[live] + d]]
                go = node >= 0
                live, node = live[go], node[go]
                d += 1
                token = self._token_at[node]
                is_token = token >= 0
                at, token = live[is_token], token[is_token]
                if i and len(at):
                    ok = self._follow(here[at], token)
                    at, token = at[ok], token[ok]
                to = place[at] + d
                state[to], size[to] = token, d - i
                if counted:
                    count[to] = count[place[at] + i] + 1
                row = self._row[node]
                on = (row >= 0) & (many[live] > d)
                live, row = live[on], row[on]
        return order, many, place, state, size, count

    def _encode_batch(self, words: list[bytes]) -> list[list[int]]:
        order, many, place, state, size, _ = self._walk(words)
        # read the paths back, all words at once
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live, at = np.arange(len(many)), many.copy()
        while len(live):
            p = place[live] + at
            found.append((live, state[p]))
            at = at - size[p]
            on = at > 0
            live, at = live[on], at[on]
        out: list[list[int]] = [[] for _ in words]
        for live, token in reversed(found):
            for k, t in zip(order[live].tolist(), token.tolist()):
                out[k].append(t)
        return out


def _newer_letters(spec: dict) -> str:
    """Ranges, for a character class, of what ``regex`` takes for a letter or digit and the vocabulary's library does not.

    Their Unicode tables differ in age.  Only code points unassigned in Python's own are asked about.
    """
    split = Tokenizer.from_str(json.dumps(spec)).pre_tokenizer
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))) if unicodedata.category(c) == "Cn"]
    found = [u for u in found if len(split.pre_tokenize_str(f"x{chr(u)}{chr(u)}y")) == 3 and regex.match(r"\p{L}", chr(u)) or len(split.pre_tokenize_str(f"1{chr(u)}{chr(u)}1")) == 3 and regex.match(r"\p{N}", chr(u))]
    firsts = [u for u, before in zip(found, [-1, *found]) if u != before + 1]
    lasts = [u for u, after in zip(found, [*found[1:], -1]) if u != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)) or "\\U0010ffff"


class Vocabulary:
    """A byte-pair vocabulary file of the tokenizers library: splitting, merges, special strings."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.end = END if self.mark else b""
        byte = {c: b for b, c in byte_letters().items()}

        def symbols(token: str) -> bytes:
            ended = bool(self.mark) and token.endswith(self.mark)
            return bytes([byte[c] for c in (token[: -len(self.mark)] if ended else token)]) + END * ended

        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {symbols(t): i for t, i in model["vocab"].items() if not self.mark or t != byte_letters()[255]}
        self.automaton = Automaton(ids, [(symbols(a), symbols(b)) for a, b in pairs])
        self.label = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.kinds = [s["type"] for s in steps]
        splits = [s for s in (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]) if s["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"] if splits else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(pattern)
        self.newer = None
        if splits:  # such patterns know no letters or digits newer than Python's own tables
            newer = _newer_letters(spec)
            self.newer = regex.compile(f"[{newer}]")
            self.older_pattern = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]").replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]"))

    def normalize(self, text: str) -> str:
        if "NFC" in self.kinds:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.kinds:
            text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])  # no final sigma
        return text

    def symbols(self, word: str) -> bytes:
        """A split word as bytes, with the end mark if the vocabulary has one."""
        return word.encode("utf-8", "surrogatepass") + self.end

    def parts(self, text: str):
        """(plain text, None) and (special string, its id) in order."""
        at = 0
        if self.special_pattern is not None and any(s in text for s in self.special):
            for m in self.special_pattern.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], None
                yield m[0], self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:], None

    def words(self, text: str) -> list[str]:
        """The words that merges work on, of a text without special strings."""
        text = self.normalize(text)
        if self.newer is not None and not text.isascii() and self.newer.search(text):
            return self.older_pattern.findall(text)
        return self.pattern.findall(text)

