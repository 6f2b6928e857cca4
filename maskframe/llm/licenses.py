"""License scans by a positional index of rare words.

Licence texts are kept as templates: the places of their words, function words left out.  One
pass over the documents finds where licence words stand, and the function words of whole mandatory
phrases.  Counting documents by word gives each word's IDF, and then in each document every
template is looked up by its own words of highest IDF: the places of its mandatory phrases' words,
shifted by their places in the template, must agree on one shift, the rarest word first.  At that
shift the share of the template's words that stand where they should is its score.  A template
without mandatory phrases is tried at the shifts of so many of its rarest words that no match of
MIN_SCORE can do without all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import textblocks as tb
from maskframe.llm.common import cut, documents, map_arrow

WORD = tb.table(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)

# Phrases of the base scan and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of public licences and of their usual notices, with the phrases that must be there.
TEMPLATES = {
    "gpl-notice": ("This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    "gpl-licensed": ("licensed under the GNU General Public License version", ["gnu general public license version"]),
    "lgpl": ("under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    "agpl": ("under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    "apache-2.0": ("Licensed under the Apache License Version 2.0", ["apache license version 2 0"]),
    "mit-licensed": ("Released under the MIT License", ["mit license"]),
    "mit-text": ("Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction", ["hereby granted free of charge"]),
    "isc-text": ("Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    "bsd-text": ("Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", ["mozilla public license"]),
    "cc-by-licensed": ("Licensed under CC BY", ["licensed under cc by"]),
    "cc-by-nc": ("Licensed under CC BY NC", ["cc by nc"]),
    "cc-by-sa": ("Licensed under CC BY SA", ["cc by sa"]),
    "public-domain": ("This is free and unencumbered software released into the public domain", ["released into the public domain"]),
}
# Words too common to be looked for.
FUNCTION_WORDS = "a an and any are as be by can for from in into is it of or out that the this to under use with without you".split()
MIN_SCORE = 0.6


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return tb.span_hashes(np.frombuffer(data, np.uint8), ends - [len(w.encode()) for w in words], ends)


class Index:
    """Templates as places of words, and the places of their mandatory phrases with function words."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]] = TEMPLATES):
        self.labels = list(templates)
        self.mandatory = sorted({tuple(split_words(p)) for _, phrases in templates.values() for p in phrases})
        texts = [split_words(t) for t, _ in templates.values()]
        self.words = sorted({w for t in texts for w in t if w not in FUNCTION_WORDS} | {w for p in self.mandatory for w in p})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.function = np.array([w in FUNCTION_WORDS for w in self.words])
        self.hashes = hash_words(self.words)
        self.order = np.argsort(self.hashes)
        self.places = [{k: self.number[w] for k, w in enumerate(t) if w not in FUNCTION_WORDS} for t in texts]
        if not all(self.places):
            raise ValueError("a template has function words only")
        #: Of each template the words of its phrases, function words too, by their places within the template.
        self.phrases = [{k: self.number[t[k]] for p in phrases for k in self._within(t, split_words(p))} for t, (_, phrases) in zip(texts, templates.values())]

    @staticmethod
    def _within(text: list[str], phrase: list[str]) -> range:
        at = next(k for k in range(len(text)) if text[k : k + len(phrase)] == phrase)
        return range(at, at + len(phrase))

    def anchors(self, idf: list[float]) -> list[list[tuple[int, int]]]:
        """Of each template the places and words that are looked up, rarest first."""
        rarest = lambda places: sorted(places.items(), key=lambda x: (-idf[x[1]], x))
        # n words of which m must stand: one of any n - m + 1 does
        spare = lambda n: sum(m / n >= MIN_SCORE for m in range(1, n + 1))
        return [rarest(phrase) if phrase else rarest(here)[: spare(len(here))] for phrase, here in zip(self.phrases, self.places)]

    def match(self, words: list[int], places: list[int], anchors: list[list[tuple[int, int]]]) -> dict[str, float]:
        """Label and score of each template found among licence words (numbers) at places."""
        at = dict(zip(places, words))
        stands: dict[int, list[int]] = {}
        for w, place in zip(words, places):
            stands.setdefault(w, []).append(place)
        found: dict[str, float] = {}
        for t, look in enumerate(anchors):
            if self.phrases[t]:
                first, w = look[0]
                shifts = {place - first for place in stands.get(w, ())}
                for k, w in look[1:]:
                    shifts = {shift for shift in shifts if at.get(shift + k) == w}
            else:
                shifts = {place - k for k, w in look for place in stands.get(w, ())}
            here = self.places[t]
            score = max((sum(at.get(shift + k) == w for k, w in here.items()) / len(here) for shift in shifts), default=0.0)
            if score >= MIN_SCORE:
                found[self.labels[t]] = score
        return found


_PROFILE = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, words array<int>, places array<int>"


def profile_block(block: tb.Block, index: Index) -> dict[str, list]:
    """Base matches, and numbers and places of licence words, of each document of a block."""
    data = tb.fold_case(block.data)
    w = tb.words(block._replace(data=data), WORD)
    hashes = tb.span_hashes(data, w.starts, w.ends)

    def starts(phrase: list[str]) -> np.ndarray:
        wanted = hash_words(phrase)
        at = np.flatnonzero(hashes == wanted[0])
        for j, h in enumerate(wanted[1:], 1):
            at = at[at + j < len(hashes)]
            at = at[(hashes[at + j] == h) & (w.doc[at + j] == w.doc[at])]
        return at

    doc, begin, kind = [], [], []
    for k, phrase in enumerate(BASE):
        at = starts(phrase.split(" "))
        doc.append(w.doc[at])
        begin.append(at)
        kind.append(np.full(len(at), k))
    doc, begin, kind = np.concatenate(doc), np.concatenate(begin), np.concatenate(kind)
    labels = list(BASE.values())
    where = np.searchsorted(index.hashes[index.order], hashes).clip(max=len(index.order) - 1)
    number = index.order[where]
    kept = (index.hashes[number] == hashes) & ~index.function[number]
    for phrase in index.mandatory:
        if any(x in FUNCTION_WORDS for x in phrase):  # function words are kept where they stand in a whole phrase
            at = starts(list(phrase))
            for j in range(len(phrase)):
                kept[at + j] = True
    hit = np.flatnonzero(kept)
    cuts = np.searchsorted(hit, w.first)
    out: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "words", "places")}
    by_doc: dict[int, list[int]] = {}
    for k, d in enumerate(doc):
        by_doc.setdefault(int(d), []).append(k)
    for d in range(len(block.starts)):
        mine = by_doc.get(d, [])
        first = [int(begin[k] - w.first[d]) for k in mine]
        out["n_base"].append(len(mine))
        out["first_word"].append(min(first, default=None))
        out["last_word"].append(max(first, default=None))
        out["base_labels"].append(sorted({labels[kind[k]] for k in mine}))
        out["words"].append(number[hit[cuts[d] : cuts[d + 1]]])
        out["places"].append(hit[cuts[d] : cuts[d + 1]] - w.first[d])
    return {"n_words": w.counts()} | out


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Licences of every whole text, lower-cased A-Z.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels (base labels and
    those of found templates; both distinct, sorted, comma-joined) and score (the best share of a
    found template's words that stand in place; 1 with base labels alone, else 0).

    A null text is an empty one: 0 words, null places, empty labels.  Repeated rows are scanned
    each on their own and each count for IDF; a null doc_id is carried through; other columns are
    not looked at.  What the driver collects is one count for each licence word.
    """
    index = Index(templates or TEMPLATES)

    def profile(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        types = {"base_labels": pa.list_(pa.string()), "words": pa.list_(pa.int32()), "places": pa.list_(pa.int32())}
        for block in tb.blocks(batch.column("text")):
            found = profile_block(block, index)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(block.lo, block.hi - block.lo)} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in found.items()})

    table = cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), profile, _PROFILE))
    counts = dict(table.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect())
    total = table.count()
    anchors = index.anchors([float(np.log((1 + total) / (1 + counts.get(k, 0)))) for k in range(len(index.words))])

    def match(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels, scores = [], []
        for base, words, places in zip(*(batch.column(c).to_pylist() for c in ("base_labels", "words", "places"))):
            found = index.match(words, places, anchors) if words else {}
            labels.append(",".join(sorted({*base, *found})))
            scores.append(max(found.values(), default=1.0 if base else 0.0))
        base = pa.array([",".join(x) for x in batch.column("base_labels").to_pylist()], pa.string())
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")} | {"base_labels": base, "labels": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_arrow(table, match, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
