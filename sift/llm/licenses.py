"""License scans by a positional rare-token index.

Templates are word sequences with a label and a mandatory key phrase: the
notices of well-known licences (``notices``) and the base phrases, which are
all key phrase.  The corpus is counted once: in how many texts each template
word occurs.  Each template's anchors are the words of highest IDF of its key
phrase, up to ``ANCHORS``, with their positions in the template as postings.

A file looks up the anchor words that it holds.  A posting at position p for a
word at place w says that the template would start at w - p.  The start lists
of a template's anchors are intersected, the rarest word's first: the key phrase
must stand whole, so every place is in all of them.  Each start left is
verified: the key phrase must stand, and the IDF-weighted share of template
words that stand at their relative positions must reach the template's least
score.  So all places are found, however common an anchor is and whatever words
outside the key phrase are altered.
IDFs are 1 or more, so words that all texts hold still count.

Defined cases: a null text is empty, has no words and no places; a text is read
whole; overlapping places all count; an empty corpus has an empty result; rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm import notices
from sift.llm.arrow import blocks

#: Words of a key phrase whose places are intersected.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[int, int]          # span of the mandatory phrase in words
    least: float = 1.0            # least score of a place
    base: bool = False


def _template(label: str, text: str, key: str, least: float = 0.8) -> Template:
    words, phrase = tuple(text.encode().split()), tuple(key.encode().split())
    at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
    return Template(label, words, (at, at + len(phrase)), least)


def _phrase(label: str, text: str) -> Template:
    words = tuple(text.encode().split())
    return Template(label, words, (0, len(words)), base=True)


# The base phrases and their labels.
BASE = (_phrase("mit", "under the mit license"), _phrase("apache-2", "apache license version 2"), _phrase("cc-by-nc", "cc by nc"))

# First sentences of well-known notices, each with the phrase that must stand.
SENTENCES = (
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
              "free of charge to any person obtaining a copy"),
    _template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance",
              "apache license version 2"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
              "in source and binary forms"),
    _template("gpl", "under the terms of the gnu general public license as published by the free software foundation",
              "gnu general public license"),
    _template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
              "gnu lesser general public license"),
    _template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
              "for any purpose with or without fee"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)

NOTICES = SENTENCES + tuple(_template(label, text, key) for label, text, key in notices.NOTICES)

# A-Z to a-z; digits, letters and every byte of a non-ASCII character stay; all else separates words.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Index:
    """Postings of the templates' anchors: words of their key phrases, rarest first."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates, self.idf = templates, idf
        self.weight = [sum(idf.get(w, 0.0) for w in t.words) for t in templates]
        # of each template, (word, positions in it), the word of highest IDF first
        self.postings: list[list[tuple[bytes, tuple[int, ...]]]] = []
        for template in templates:
            a, b = template.key
            rare = sorted(set(template.words[a:b]), key=lambda w: (-idf.get(w, 0.0), w))[:ANCHORS]
            self.postings.append([(word, tuple(p for p in range(a, b) if template.words[p] == word)) for word in rare])
        self.anchors = frozenset(word for anchors in self.postings for word, _ in anchors)

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of every verified place."""
        held = self.anchors.intersection(words)
        if not held:
            return []
        at: dict[bytes, list[int]] = defaultdict(list)
        for place, word in enumerate(words):
            if word in held:
                at[word].append(place)
        found = []
        for number, anchors in enumerate(self.postings):
            if not all(word in held for word, _ in anchors):
                continue
            template, (a, b) = self.templates[number], self.templates[number].key
            # every anchor stands in the key phrase, so a place is in all their lists of starts
            starts: set[int] | None = None
            for word, positions in anchors:
                own = {place - p for p in positions for place in at[word]} if starts is None else {
                    start for start in starts if any(0 <= start + p < len(words) and words[start + p] == word for p in positions)}
                starts = own
                if not starts:
                    break
            for start in starts:
                if start + a < 0 or tuple(words[start + a:start + b]) != template.words[a:b]:
                    continue
                score = 1.0 if template.base else self.score(number, start, words)
                if score >= template.least:
                    found.append((number, start, score))
        return found

    def score(self, number: int, start: int, words: list[bytes]) -> float:
        """IDF-weighted share of the template's words that stand in their places."""
        template = self.templates[number]
        there = sum(self.idf.get(w, 0.0) for i, w in enumerate(template.words) if 0 <= start + i < len(words) and words[start + i] == w)
        return min(1.0, there / self.weight[number]) if self.weight[number] > 0 else 0.0


class _Presence:
    """Arrow batches of texts: how many texts hold each template word, a row per word and batch."""

    def __init__(self, vocabulary: frozenset[bytes]):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        texts_seen = 0
        for _, texts in blocks(batches):
            texts_seen += len(texts)
            for text in texts:
                for word in self.vocabulary.intersection(words_of(text)):
                    held[word] += 1
        held[b""] = texts_seen
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held]), pa.array(list(held.values()), pa.int64())],
                                         names=["word", "texts"])


def inverse_frequencies(documents: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, float]:
    """IDF of every template word over all texts; one row per template word reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    counted = (documents.select(F.col(text_col).alias("text")).mapInArrow(_Presence(vocabulary), "word string, texts long")
                        .groupBy("word").agg(F.sum("texts").alias("texts")).collect())
    texts = {row.word.encode(): row.texts for row in counted}
    total = texts.pop(b"", 0)
    return {w: 1 + math.log((total + 1) / (texts.get(w, 0) + 1)) for w in vocabulary}


class Scan:
    """Arrow batches of (doc_id, text) to the scan's columns."""

    def __init__(self, index: Index):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = self.index.templates
        for batch, texts in blocks(batches):
            rows = []
            for text in texts:
                words = words_of(text)
                places = self.index.places(words)
                base = [(n, start) for n, start, _ in places if templates[n].base]
                starts = [start for _, start in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({templates[n].label for n, _ in base})),
                             ",".join(sorted({templates[n].label for n, _, _ in places})),
                             max((score for _, _, score in places), default=0.0)))
            columns = zip(*rows)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word",
                                                    "base_labels", "labels", "score"])


def scan(documents: DataFrame, templates: tuple[Template, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = BASE + tuple(templates)
    index = Index(templates, inverse_frequencies(documents, templates, text_col))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(Scan(index), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                                         "base_labels string, labels string, score double")
