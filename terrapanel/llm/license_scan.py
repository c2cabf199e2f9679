"""License scans by a positional rare-token index.

Templates are short licence wordings. Document frequencies of the templates' words are counted over the whole corpus; the
``rare`` rarest words of each template, however frequent they are, index it: word -> (template, position). A file looks up all
its words that have postings and votes for (template, file position - template position), so that postings meet by relative
position, and the best alignment of each template is scored by the IDF share of its words found there, give or take
``slack`` words of drift. A template's label holds only where the score reaches ``threshold`` and each of its mandatory key
phrases stands in the file's words.

Defined results: null or empty text has no words, no labels and score 0; every input row gives one output row; a corpus
without documents gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, doc_texts, parts, text_bytes

# Label, wording, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ["permission is hereby granted"],
    ),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ["gnu general public license"],
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("proprietary", "all rights reserved proprietary and confidential unauthorized copying is prohibited", ["all rights reserved"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def _phrase_places(words: list[bytes], phrase: tuple[bytes, ...], anchors: dict[bytes, list[int]]) -> list[int]:
    """Starts of a phrase, from the places of its last word."""
    back = len(phrase) - 1
    return [p - back for p in anchors.get(phrase[-1], ()) if p >= back and tuple(words[p - back : p + 1]) == phrase]


def word_frequencies(docs: DataFrame, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each of the given words stands; the result is as small as ``words``."""

    def count(batches):
        for batch in parts(batches):
            found: dict[bytes, int] = {b"": batch.num_rows}
            for text in text_bytes(batch):
                for w in words.intersection(alnum_words(text)):
                    found[w] = found.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"],
            )

    rows = doc_texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class PositionalIndex:
    """Postings of each template's rarest words with their IDF."""

    def __init__(self, templates, n_docs: int, frequencies: dict[bytes, int], rare: int):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].encode().split() for t in templates]
        self.phrases = [[tuple(p.encode().split()) for p in t[2]] for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 0.5)) for ws in self.words for w in ws}
        self.weight = [sum(self.idf[w] for w in ws) or 1.0 for ws in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, ws in enumerate(self.words):
            rarest = sorted(set(ws), key=lambda w: (-self.idf[w], w))[:rare]
            for p, w in enumerate(ws):
                if w in rarest:
                    self.postings.setdefault(w, []).append((k, p))
        self.last_words = {p[-1] for ps in self.phrases for p in ps}

    def match(self, words: list[bytes], slack: int) -> tuple[list[tuple[int, float]], dict[bytes, list[int]]]:
        """(template, score) of the best alignment of each template, and the places of licence words."""
        places: dict[bytes, list[int]] = {}
        keep = self.postings.keys() | self.last_words
        for w in keep.intersection(words):
            places[w] = []
        if not places:
            return [], places
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        votes: dict[tuple[int, int], float] = {}
        for w in sorted(places.keys() & self.postings.keys()):
            for k, p in self.postings[w]:
                for i in places[w]:
                    votes[k, i - p] = votes.get((k, i - p), 0.0) + self.idf[w]
        best: dict[int, tuple[float, int]] = {}
        for (k, shift), vote in votes.items():
            best[k] = max(best.get(k, (0.0, 0)), (vote, -shift))
        scores = []
        for k, (_, back) in sorted(best.items()):
            found, at = 0.0, -back
            for w in self.words[k]:
                for step in sorted(range(-slack, slack + 1), key=abs):
                    if 0 <= at + step < len(words) and words[at + step] == w:
                        found, at = found + self.idf[w], at + step
                        break
                at += 1
            scores.append((k, found / self.weight[k]))
        return scores, places


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, best_template int"
)


def scan(
    docs: DataFrame, templates=TEMPLATES, rare: int = 12, slack: int = 2, threshold: float = 0.8
) -> DataFrame:
    """Rows of SCHEMA: base phrases, and labels of the templates that align and whose key phrases are present."""
    wanted = {w for t in templates for w in t[1].encode().split()}
    n_docs, frequencies = word_frequencies(docs, wanted)
    index = PositionalIndex(templates, n_docs, frequencies, rare)
    base = [(tuple(p.encode().split()), label) for p, label in BASE]
    index.last_words |= {p[-1] for p, _ in base}

    def row(text):
        words = alnum_words(text)
        scores, places = index.match(words, slack)
        starts, base_labels = [], set()
        for phrase, label in base:
            found = _phrase_places(words, phrase, places)
            starts += found
            if found:
                base_labels.add(label)
        labels, best = set(base_labels), (0.0, -1)
        for k, score in scores:
            best = max(best, (score, -k - 1))
            if score >= threshold and all(_phrase_places(words, p, places) for p in index.phrases[k]):
                labels.add(index.labels[k])
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return (
            len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            min(1.0, best[0]), -best[1] - 1 if best[0] else None,
        )

    kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.int32())
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for batch in parts(batches):
            columns = list(zip(*map(row, text_bytes(batch)), strict=True)) or [[] for _ in kinds]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs)
