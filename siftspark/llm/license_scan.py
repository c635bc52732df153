"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words that occurs in a template. Streaming a text
through it gives matching statistics: for each word the longest run ending there that
some template holds, and where. Long matches are chained per template, in the order of
both text and template, into spans; a span's covered share of its template scores it.
Words that no template holds reset the automaton, so only runs of known words are stepped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Grant notices of public licences, as their stewards word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)

#: Lower-cases A-Z and turns all other ASCII but digits and a-z into blanks; bytes of other characters stay.
_TO_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers; state 0 is the empty run."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For each state the (template, end) places of its runs, filled by finish().
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(0 if copy is None else self.link[copy])
        self.length.append(length)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """The state for the runs that end in at's longest run and word, made from the longer ones in to."""
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._state(self.length[at] + 1, to)
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (to := self.next[last].get(word)) is not None:
            return self._split(last, word, to)
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, word, self.next[at][word])
        return new

    def add(self, template: int, words: list[bytes]) -> int:
        """Adds a template; returns the state of its whole run of words."""
        last = 0
        for end, word in enumerate(words):
            last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
            self.places[last].append((template, end))
        return last

    def whole(self, words: list[bytes]) -> int:
        at = 0
        for word in words:
            at = self.next[at][self.vocabulary[word]]
        return at

    def finish(self) -> None:
        """Hands every state's places down to the states of its suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])
        self.places = [sorted(set(x)) for x in self.places]


class Scanner:
    """The compiled templates and phrases; find(text) gives a text's phrase places and template spans."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, seed_words: int = 3, covered: float = 0.6):
        self.templates = [(label, words_of(text.encode())) for label, text in templates]
        self.phrases = [(label, words_of(text.encode())) for text, label in phrases]
        self.seed_words, self.covered = seed_words, covered
        self.auto = Automaton()
        for k, (_, words) in enumerate(self.templates + self.phrases):
            self.auto.add(k, words)
        self.auto.finish()
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.phrases):
            ends.setdefault(self.auto.whole(words), []).append((k, len(words)))
        # every state's phrases: its own and those of its suffixes
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.auto.length)
        for state in sorted(range(1, len(self.auto.length)), key=self.auto.length.__getitem__):
            self.ending[state] = self.ending[self.auto.link[state]] + tuple(ends.get(state, ()))

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of every word that ends a run of some template."""
        known = self.auto.vocabulary
        follow, link, length = self.auto.next, self.auto.link, self.auto.length
        state = run = 0
        before = -2
        for at, word in [(i, known[w]) for i, w in enumerate(words) if w in known]:
            if at != before + 1:
                state = run = 0
            before = at
            while state and word not in follow[state]:
                state = link[state]
                run = length[state]
            state, run = follow[state][word], run + 1
            yield at, state, run

    def find(self, data: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """The number of words, the (start, label) places of phrases, the (start, end, label, covered share) spans of templates."""
        words = words_of(data)
        bases, matches, held = [], [], None
        for at, state, run in self.statistics(words):
            bases += [(at - n + 1, self.phrases[k][0]) for k, n in self.ending[state] if n <= run]
            if run >= self.seed_words:  # a match is reported where it is longest: its next word does not lengthen it
                if held and not (at == held[0] + 1 and run == held[2] + 1):
                    matches.append(held)
                held = (at, state, run)
            elif held:
                matches.append(held)
                held = None
        if held:
            matches.append(held)
        return len(words), bases, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains of matches that advance in text and template; a gap may be as long as the template's words left out, and as many again."""
        open_: dict[int, list[int]] = {}
        spans = []

        def close(k: int) -> None:
            start, end, _, words = open_.pop(k)
            label, template = self.templates[k]
            if words >= self.covered * len(template):
                spans.append((start, end, label, words / len(template)))

        for at, state, run in matches:
            for k, end in self.auto.places[state]:
                if k >= len(self.templates):
                    continue
                start, first = at - run + 1, end - run + 1
                if k in open_:
                    _, last, seen, words = open_[k]
                    over = max(0, seen + 1 - first, last + 1 - start)
                    if end > seen and over < run and start - last - 1 <= 2 * max(0, first - seen - 1) + self.seed_words:
                        open_[k][1:] = [at, end, words + run - over]
                        continue
                    if end <= seen and at <= last:
                        continue
                    close(k)
                open_[k] = [start, at, end, run]
        for k in list(open_):
            close(k)
        return sorted(spans)


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, bases, spans = scanner.find(text.as_py() or b"")
                starts = [s for s, _ in bases]
                base = sorted({label for _, label in bases})
                score = max([0.0, *(share for *_, share in spans), *(1.0 for _ in bases[:1])])
                rows.append((n, len(bases), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(label for _, _, label, _ in spans)})), min(1.0, score), [{"start": a, "end": b, "label": c, "covered": d} for a, b, c, d in spans]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row per row of docs: words, phrase places, labels, score and the covered template spans (start, end: words from 0).

    Every place of a phrase counts, overlapping ones too. score is 1 where a phrase stands,
    else the largest covered share of a template of at least the scanner's threshold, else
    0. A null or empty text has no word, no place (null first_word and last_word), no label
    (empty strings) and score 0. Repeated rows and null ids come back as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, covered: double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_scan(scanner or Scanner()), schema)
