"""Licence scans by a generalised suffix automaton of licence words.

The automaton reads a text's words one by one and tells, at each, the longest run of words that
ends there and stands in some template (matching statistics). Runs that go no further are
anchors where they are long enough; anchors that follow each other in the text as in a
template are chained, and a chain covers a share of its template and a span of the text.
Short phrases are templates that must be met whole: one ends wherever the automaton's state, or
one of its suffixes, is the phrase.
"""

from __future__ import annotations

from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spanloom.llm.common import forget_with, small_batches, table, take_turn
from spanloom.llm.words import BLOCK, byte_table, words_of

#: The base phrases of the query and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices of public licences and their labels.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
)

LETTERS = bytes(range(0x41, 0x5B))
GAPS = bytes(b for b in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)) if b not in LETTERS)
TABLE = byte_table(GAPS)
LEAST = 4  # words of an anchor
APART = 24  # words between anchors of a chain, in the text and in the template
COVERED = 0.75  # of a template, for its label

FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label string, template int, first long, last long, covered double>>"
)


class Automaton:
    """A suffix automaton of several word lists. State 0 is the empty run; `places` are all
    (list, end) where a state's runs stand."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in lists:
            last = 0
            for word in words:
                last = self._extended(last, word)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, words in enumerate(lists):
            state = 0
            for end, word in enumerate(words, 1):
                state = self.next[state][word]
                self.places[state].append((k, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] += self.places[state]
        self.places[0] = []

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of the longest run of `at` and then `word`, alone."""
        old = self.next[at][word]
        if self.length[old] == self.length[at] + 1:
            return old
        new = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """At each word, the state and the length of the longest run that ends there."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (then := self.next[state].get(word)) is not None:
                state, length = then, length + 1
            out.append((state, length))
        return out


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


class Scanner:
    def __init__(self, phrases: tuple, templates: tuple) -> None:
        lists = [plain_words(text) for _, text in (*phrases, *templates)]
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.sizes, self.phrases = [len(x) for x in lists], len(phrases)
        names = sorted({w for x in lists for w in x})
        self.names = pa.array(names, pa.large_binary())
        number = {w: i for i, w in enumerate(names)}
        coded = [[number[w] for w in x] for x in lists]
        self.automaton = Automaton(coded)
        self.follows = np.zeros((len(names) + 1, len(names) + 1), np.bool_)  # the last: no word of any list
        for x in coded:
            self.follows[x[:-1], x[1:]] = True
        ends: dict[int, list[int]] = defaultdict(list)
        for k in range(self.phrases):
            ends[self.automaton.statistics(coded[k])[-1][0]].append(k)
        self.whole: list[list[int]] = [[]]  # the phrases that a state's runs can end with
        order = sorted(range(1, len(self.automaton.next)), key=lambda s: self.automaton.length[s])
        self.whole *= len(self.automaton.next)
        for state in order:
            self.whole[state] = self.whole[self.automaton.link[state]] + ends[state]

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
        """Each text's number of words; phrases (phrase, first word) and anchors (template, first
        word, first word in the template, words) of the texts that have any."""
        words = words_of(texts, TABLE)
        total = np.bincount(words.text, minlength=len(texts))
        begin = np.cumsum(total) - total
        known = pc.fill_null(pc.index_in(words.names, value_set=self.names), len(self.names)).to_numpy()
        ids = known[words.ids].astype(np.int64) if len(words.ids) else np.zeros(0, np.int64)
        pairs = self.follows[ids[:-1], ids[1:]] & (words.text[:-1] == words.text[1:])
        edges = np.flatnonzero(np.diff(pairs, prepend=False, append=False))
        found: dict[int, tuple[list, list]] = {}
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):
            text = int(words.text[a])
            self._run(ids[a:b].tolist(), a - int(begin[text]), text, found)
        return total, found

    def _run(self, run: list[int], at: int, text: int, found: dict[int, tuple[list, list]]) -> None:
        steps = self.automaton.statistics(run)
        for i, (state, length) in enumerate(steps):
            whole = [(k, at + i + 1 - self.sizes[k]) for k in self.whole[state] if length >= self.sizes[k]]
            further = i + 1 < len(steps) and steps[i + 1][1] == length + 1
            anchors = []
            if length >= LEAST and not further:
                for k, end in self.automaton.places[state]:
                    if k >= self.phrases:
                        anchors.append((k, at + i + 1 - length, end - length, length))
            if whole or anchors:
                phrases, others = found.setdefault(text, ([], []))
                phrases += whole
                others += anchors

    def chains(self, anchors: list[tuple]) -> list[tuple[int, int, int, float]]:
        """The best chains of anchors, apart from each other in the text for each template:
        template, first and last word, share of the template that is covered."""
        by: dict[int, list[tuple]] = defaultdict(list)
        for k, first, there, size in anchors:
            by[k].append((first, there, size))
        return [x for k in sorted(by) for x in self._chained(k, sorted(by[k]))]

    def _chained(self, k: int, anchors: list[tuple]) -> list[tuple[int, int, int, float]]:
        best, near = [], deque()  # best: words covered up to an anchor, the anchor before it
        for i, (first, there, size) in enumerate(anchors):
            while near and anchors[near[0]][0] + anchors[near[0]][2] + APART + self.sizes[k] < first:
                near.popleft()
            most, back = size, -1
            for j in near:
                begun, before, held = anchors[j]
                ahead, deeper = first - begun - held, there - before - held
                if ahead > APART or deeper > APART or begun >= first or before >= there:
                    continue
                fresh = size + min(0, ahead, deeper)  # what two anchors share counts once
                if fresh > 0 and best[j][0] + fresh > most:
                    most, back = best[j][0] + fresh, j
            best.append((most, back))
            near.append(i)
        out: list[tuple[int, int, int, float]] = []
        used = np.zeros(len(anchors), np.bool_)
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(anchors)), key=lambda i: (-best[i][0], i)):
            chain, at = [], i
            while at >= 0 and not used[at]:
                chain.append(at)
                at = best[at][1]
            if at >= 0 or used[i]:
                used[chain] = True
                continue  # goes into a chain that was taken
            used[chain] = True
            span = anchors[chain[-1]][0], anchors[i][0] + anchors[i][2] - 1
            if all(span[1] < a or b < span[0] for a, b in taken):
                taken.append(span)
                out.append((k, *span, best[i][0] / self.sizes[k]))
        return sorted(out)


@lru_cache(maxsize=2)
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


forget_with(scanner.cache_clear)


def scanned(text: Column, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, covered: float = COVERED) -> Column:
    """What scan_licences says of each text, as a struct."""

    def told(tool: Scanner, total: int, phrases: list, anchors: list) -> dict:
        chains = tool.chains(anchors)
        starts = [first for _, first in phrases]
        base = {tool.labels[k] for k, _ in phrases}
        spans = [(k, a, a + tool.sizes[k] - 1, 1.0) for k, a in phrases]
        spans += [c for c in chains if c[3] >= covered]
        return {
            "n_words": total,
            "n_base": len(phrases),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {tool.labels[s[0]] for s in spans})),
            "score": max([0.0, *(1.0 for _ in phrases[:1]), *(c[3] for c in chains)]),
            "spans": [
                {"label": tool.labels[k], "template": k, "first": a, "last": b, "covered": c}
                for k, a, b, c in sorted(spans, key=lambda s: (s[1], s[2], s[0]))
            ],
        }

    kind = pa.struct(
        [
            *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([
                ("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()),
                ("covered", pa.float64()),
            ]))),
        ]
    )

    @arrow_udf(FOUND)
    def run(column: pa.Array) -> pa.Array:
        take_turn("licences")
        tool, out = scanner(phrases, templates), []
        texts, held = [], 0
        for value in [*column.cast(pa.binary()).to_pylist(), ...]:
            if value is ... or held >= BLOCK:
                if texts:
                    totals, found = tool.scan(texts)
                    out += [told(tool, n, *found.get(i, ([], []))) for i, n in enumerate(totals.tolist())]
                texts, held = [], 0
            if value is not ...:
                texts.append(value or b"")
                held += len(texts[-1])
        return pa.array(out, kind)

    return run.asNondeterministic()(text)  # keeps Spark from running it twice for two uses


def scan_licences(
    docs: DataFrame, text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, covered: float = COVERED
) -> DataFrame:
    """All rows of docs with n_words, n_base, first_word, last_word, base_labels, labels, score
    and spans.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all beyond ASCII. n_base counts the
    places of `phrases` ((label, text), two words or more), overlapping ones too; first_word and
    last_word are their least and greatest start (null: none). `templates` ((label, text))
    add their labels where a chain covers the share `covered` of one. score: 1 with a phrase,
    else the largest share of any template that a chain covers. spans: where phrases and such
    chains stand (label, template, first and last word, covered). Both lists go to every
    task, so they should be thousands of words at most.

    Rows are scanned one by one, so ties, repeated rows and order have no effect. A null or
    empty text has no words, no labels and score 0; an empty table gives an empty table; columns
    with the new names are replaced. A text is scanned whole, however long.
    """
    new = "n_words n_base first_word last_word base_labels labels score spans __found".split()
    kept = docs.drop(*(c for c in docs.columns if c.lower() in new and c != text))
    found = kept.withColumn("__found", scanned(F.col(f"`{text}`"), phrases, templates, covered))
    return found.select(*(F.col(f"`{c}`") for c in kept.columns if c.lower() not in new), "__found.*")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )
