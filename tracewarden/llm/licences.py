"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of the templates. A text is streamed through it word by
word: the state and the length of the longest run that ends here are the matching statistics.
Phrases are read off the states that they end in; long maximal matches are chained, in template order, into
the share of a template that the text covers.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, utf8

#: Phrases and the labels that they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Published licences and notices, or their openings.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
#: A maximal match counts for a chain from so many words on; so much of a template gives its label.
LEAST_WORDS, COVERAGE = 4, 0.5
#: A chain may take up so many times the words of its template.
STRETCH = 4
#: Letters, digits and what is not ASCII make words; A-Z is lowered, all else divides.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, from A-Z lowered."""
    return text.translate(_WORDS).split()


class SuffixAutomaton:
    """The generalised suffix automaton of token sequences.

    ``origin[s]``: a sequence and the place after which a run of state s ends there.
    ``ending[s]``: the whole sequences that are suffixes of the longest run of s.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.origin: list[list[tuple[int, int]]] = [[]]
        final: dict[int, list[int]] = {}
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.origin[last].append((k, i + 1))
            final.setdefault(last, []).append(k)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):  # a run's places are also its suffixes'
            self.origin[self.link[s]] += self.origin[s]
        self.ending: list[list[int]] = [[] for _ in self.link]
        for s in order:
            self.ending[s] = final.get(s, []) + self.ending[self.link[s]]

    def _extend(self, last: int, token: bytes) -> int:
        to = self.next[last].get(token)
        if to is not None and self.length[to] == self.length[last] + 1:
            return to
        if to is None:
            state = self._state(self.length[last] + 1, {})
            at = last
            while at >= 0 and token not in self.next[at]:
                self.next[at][token] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
                return state
            to = self.next[at][token]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._clone(at, token, to)
            return state
        return self._clone(last, token, to)

    def _state(self, length: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.origin.append([])
        return len(self.next) - 1

    def _clone(self, at: int, token: bytes, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]))
        self.link[copy] = self.link[to]
        self.link[to] = copy
        while at >= 0 and self.next[at].get(token) == to:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def stream(self, tokens: list[bytes]) -> list[tuple[int, int, int]]:
        """(place after the token, state, length) of each token that some run of the sequences ends with."""
        following, link, lengths = self.next, self.link, self.length
        first = following[0]
        state = length = 0
        out = []
        for i, token in enumerate(tokens, 1):
            if state == 0:
                if token not in first:
                    continue
                state, length = first[token], 1
            else:
                while (to := following[state].get(token)) is None:
                    state = link[state]
                    if state < 0:
                        break
                    length = lengths[state]
                if state < 0:
                    state = length = 0
                    continue
                state, length = to, length + 1
            out.append((i, state, length))
        return out


class Scanner:
    """Templates and phrases in one automaton."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> None:
        self.phrases = [(words(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(words(t.encode()), label) for label, t in templates.items()]
        self.n = len(self.phrases)
        self.automaton = SuffixAutomaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Number of words, places (phrase, first word) and spans (label, first word, end, coverage) of templates."""
        tokens = words(text)
        a = self.automaton
        places, maximal = [], []
        before = (0, 0, 0)
        for here in a.stream(tokens):
            i, state, length = here
            if before[2] >= LEAST_WORDS and (i != before[0] + 1 or length <= before[2]):
                maximal.append(before)
            before = here
            for k in a.ending[state]:
                if k < self.n and len(self.phrases[k][0]) <= length:
                    places.append((k, i - len(self.phrases[k][0])))
        if before[2] >= LEAST_WORDS:
            maximal.append(before)
        return len(tokens), places, self._chains(maximal) if maximal else []

    def _chains(self, maximal: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """For each template the chain of matches, ascending in text and template, that covers most of it."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, state, length in maximal:
            for k, end in set(self.automaton.origin[state]):
                if k >= self.n and end >= length:
                    by.setdefault(k, []).append((i, end, length))
        out = []
        for k, matches in sorted(by.items()):
            size = len(self.templates[k - self.n][0])
            best, first, text_end, chain = self._best(matches, size)
            if chain:
                out.append((self.templates[k - self.n][1], first, text_end, best / size))
        return out

    @staticmethod
    def _best(matches: list[tuple[int, int, int]], size: int) -> tuple[int, int, int, bool]:
        """The chain of matches (text end, template end, length) that covers most template words, and where it begins and ends.

        Both ends ascend along a chain; what a match shares in text or template with the one before it does not count
        again; a chain lies in a stretch of text of four times the template. Of equals the first one.
        """
        found = sorted(set(matches))
        ends = [i for i, _, _ in found]
        best = (0, 0, 0, False)
        for begin in sorted({i - length for i, _, length in found}):
            window = [m for m in found[bisect_right(ends, begin) : bisect_right(ends, begin + STRETCH * size)] if m[0] - m[2] >= begin]
            if min(size, sum(m[2] for m in window)) <= best[0]:
                continue
            covered: list[int] = []
            for k, (i, end, length) in enumerate(window):
                # A chain begins where the window does; others are found from their own beginnings.
                most = length if i - length == begin else 0
                for j in range(k):
                    before, before_end, _ = window[j]
                    if covered[j] and before < i and before_end < end:
                        most = max(most, covered[j] + min(length, i - before, end - before_end))
                covered.append(most)
                if most > best[0]:
                    best = (most, begin, i, True)
        return best


_MADE: list[Scanner] = []


def _scanner() -> Scanner:
    if not _MADE:
        _MADE.append(Scanner())
    return _MADE[0]


def scan_licences(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_words, places (label, word), spans (label, first_word, end_word, coverage) for each row.

    Places are those of the fixed phrases, all of them; spans are the best chain of each template with a
    match of four words or more. A null or empty text has no words, places or spans. Rows stay one
    for one, repeated and null keys too; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
        scanner = _scanner()
        for batch in chunks(batches, 1):
            n, places, spans = [], [], []
            for t in utf8(batch.column(1)):
                count, found, chained = scanner.scan(t)
                n.append(count)
                places.append([{"label": scanner.phrases[k][1], "word": w} for k, w in found])
                spans.append([dict(zip(("label", "first_word", "end_word", "coverage"), x, strict=True)) for x in chained])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, span)], [key, "n_words", "places", "spans"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first_word:long,end_word:long,coverage:double>>")


def op2_suffix_automaton_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all ``documents``.

    The score is 1 with a phrase, else the largest share of a template that is covered.
    """
    found = scan_licences(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    covered = F.filter("spans", lambda s: s["coverage"] >= COVERAGE)
    word = F.col("places.word")
    best = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, covered["label"])), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
