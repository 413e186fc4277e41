"""Licence scan with a positional index of rare licence words.

Templates are notices: a label, words, and key phrases that must be there. For each
template the index holds its rarest words and the rarest of each key phrase, by document
frequency over the whole corpus, with their positions. A file looks up the index words it has; every occurrence proposes
where the template would start, and proposals that agree on the start are intersected. A
start with enough agreeing words counts if all key phrases stand at their places; where they
do, their words agree, so none is missed. Its score is the share of the template's words
found in place; words that the file has not before its first key phrase are missing ones.

A short phrase is a template whose key phrase is all of it: the start proposed by its
rarest word is enough to propose it, so every place is found.

Nulls and empty texts have no words and no labels; very long texts are read whole, one at a time. Each file is judged by itself with the
index alone, so repeated rows give repeated results. In an empty corpus all words are
equally rare and the index falls back to alphabetical order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.batches import per_text

#: Bytes that end a word, after lower-casing A-Z.
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))

#: Rare words of a template in the index, and how many must agree on its start.
RARE_WORDS = 4
AGREE = 2

#: Phrases and labels of the base scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices of public licences with the phrases that must stand in them.
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        ["permission is hereby granted free of charge"],
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at",
        ["except in compliance with the license"],
    ),
    (
        "gpl-3",
        "licensed under the gnu general public license version 3",
        ["gnu general public license version 3"],
    ),
    (
        "gpl",
        "redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ["under the terms of the gnu general public license"],
    ),
    (
        "lgpl",
        "under the terms of the gnu lesser general public license",
        ["gnu lesser general public license"],
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license",
        ["gnu affero general public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software",
        ["may be used to endorse or promote products"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with "
        "or without fee is hereby granted",
        ["for any purpose with or without fee is hereby granted"],
    ),
    (
        "mpl-2",
        "subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license v 2 0"],
    ),
    (
        "cc-by-nc",
        "creative commons attribution noncommercial 4 0 international license",
        ["attribution noncommercial"],
    ),
    (
        "cc-by-sa",
        "creative commons attribution sharealike 4 0 international license",
        ["attribution sharealike"],
    ),
    (
        "cc-by",
        "creative commons attribution 4 0 international license",
        ["creative commons attribution 4 0"],
    ),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related "
        "rights",
        ["has waived all copyright and related"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ["free and unencumbered software"],
    ),
]

SCAN = [
    ("n_words", "bigint"),
    ("n_base", "bigint"),
    ("first_word", "bigint"),
    ("last_word", "bigint"),
    ("base_labels", "string"),
    ("labels", "string"),
    ("score", "double"),
    ("starts", "array<bigint>"),
    ("found", "array<string>"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # place in the template and words
    base: bool


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


def template(label: str, text: str, keys: list[str], base: bool = False) -> Template:
    words = words_of(text.encode())
    placed = []
    for key in keys:
        own = words_of(key.encode())
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        placed.append((at, tuple(own)))
    return Template(label, tuple(words), tuple(placed), base)


TEMPLATES = [template(label, p, [p], base=True) for p, label in PHRASES.items()] + [
    template(*notice) for notice in NOTICES
]


class Index:
    """Rare words of the templates, each with the places it stands at."""

    def __init__(self, templates: list[Template], docs: int, counts: dict[bytes, int]) -> None:
        self.templates = templates
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for t, known in enumerate(templates):
            def rarest(words: tuple[bytes, ...], n: int) -> list[bytes]:
                return sorted(
                    set(words),
                    key=lambda w: (-math.log((docs + 1) / (counts.get(w, 0) + 1)), w),
                )[:n]

            # the rarest words of each key phrase too: where all of these stand, enough agree
            of_keys = {w for _, key in known.keys for w in rarest(key, AGREE)}
            rare = rarest(known.words, 1) if known.base else {*rarest(known.words, RARE_WORDS), *of_keys}
            for word in sorted(rare):
                at = [i for i, w in enumerate(known.words) if w == word]
                self.places.setdefault(word, []).extend((t, i) for i in at)
            self.needed.append(1 if known.base else min(AGREE, len(of_keys)))

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        places = self.places
        agreeing: dict[tuple[int, int], int] = {}
        for i, word in enumerate(words):
            if word in places:
                for t, at in places[word]:
                    agreeing[t, i - at] = agreeing.get((t, i - at), 0) + 1
        found, base = [], set()
        for (t, start), votes in agreeing.items():
            if votes >= self.needed[t] and self.has_keys(words, t, start):
                # a notice may lack the words before its first key phrase
                found.append((max(start, 0), self.templates[t].label, self.share(words, t, start)))
                if self.templates[t].base:
                    base.add((start, self.templates[t].label))
        found.sort()
        starts = [start for start, _ in base]
        return (
            len(words),
            len(base),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted({label for _, label in base})),
            ",".join(sorted({label for _, label, _ in found})),
            max((share for _, _, share in found), default=0.0),
            [start for start, _, _ in found],
            [label for _, label, _ in found],
        )

    def has_keys(self, words: list[bytes], t: int, start: int) -> bool:
        return all(
            start + at >= 0 and tuple(words[start + at : start + at + len(key)]) == key
            for at, key in self.templates[t].keys
        )

    def share(self, words: list[bytes], t: int, start: int) -> float:
        own = self.templates[t].words
        there = zip(own[max(-start, 0) :], words[max(start, 0) : start + len(own)])
        return sum(a == b for a, b in there) / len(own)


def word_counts(docs: DataFrame, templates: list[Template]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those with each template word.

    What comes to the driver is one row per word of the templates, whatever the corpus.
    """
    listed = sorted({w for t in templates for w in t.words})
    number = {w: k for k, w in enumerate(listed)}

    def run(text: bytes) -> tuple:
        return ([number[w] for w in set(words_of(text)).intersection(number)],)

    present = per_text(run, [("present", "array<int>")])("text")
    held = docs.select(F.explode(F.concat(F.array(F.lit(-1)), present["present"])).alias("w"))
    counts = {row.w: row["count"] for row in held.groupBy("w").count().collect()}
    return counts.get(-1, 0), {w: counts.get(k, 0) for w, k in number.items()}


def scan_licences(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Places, labels and score per document; ``starts`` and ``found`` list all places."""
    # a few hundred words: bounded by the templates, so it travels with the function
    index = Index(templates, *word_counts(docs, templates))
    return docs.select("doc_id", per_text(index.scan, SCAN)("text").alias("s")).select(
        "doc_id", "s.*"
    )
