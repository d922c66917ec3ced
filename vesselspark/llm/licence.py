"""Licence scans: matching statistics of streamed texts in a generalised suffix automaton of licence words, chained into template spans."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import ALNUM, LOWER, Words, slices, utf8

#: Phrases whose every place is reported, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Clauses of licences and notices by label, as words. A licence is cut into clauses so that a text with a part of it is covered too.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)


def split_words(text: str) -> list[str]:
    """Words as the scan sees them: A-Z lowered, everything ASCII but letters and digits ends a word."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


class Automaton:
    """All substrings of several word sequences. Each state knows, for each sequence, where its substrings end: the first place (ends) and all (places)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[tuple[int, int, int]] = []
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self.add(last, word)
                own.append((last, number, at))
        self.places: list[dict[int, list[int]]] = [{} for _ in self.link]
        for state, number, at in own:
            self.places[state].setdefault(number, []).append(at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for number, at in self.places[state].items():
                self.places[self.link[state]].setdefault(number, []).extend(at)
        self.ends = [{number: min(at) for number, at in p.items()} for p in self.places]

    def state(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        return len(self.link) - 1

    def split(self, before: int, word: int) -> int:
        """The state that `before` reaches by word, cut off from longer substrings that end elsewhere too."""
        target = self.next[before][word]
        if self.length[target] == self.length[before] + 1:
            return target
        short = self.state(self.length[before] + 1, target)
        self.link[target] = short
        while before != -1 and self.next[before].get(word) == target:
            self.next[before][word] = short
            before = self.link[before]
        return short

    def add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word)
        new, before = self.state(self.length[last] + 1), last
        while before != -1 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        self.link[new] = 0 if before == -1 else self.split(before, word)
        return new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest known substring that ends there."""
        follow, link, lengths = self.next, self.link, self.length
        state = length = 0
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                length = lengths[state]
            state = follow[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...], min_words: int, max_gap: int):
        self.min_words, self.max_gap = min_words, max_gap
        self.phrases, self.templates = list(phrases), [label for label, _ in templates]
        texts = [split_words(t) for t in (*phrases.values(), *(t for _, t in templates))]
        vocabulary = sorted({w for t in texts for w in t})
        data, offsets = utf8(pa.array(vocabulary, pa.string()))
        hashes = Words(data, offsets, ALNUM).hashes(fold=LOWER)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        number = {w: k for k, w in enumerate(vocabulary)}
        sequences = [[number[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in sequences]
        self.n_words = len(vocabulary)
        self.pairs = np.unique(np.array([a * self.n_words + b for s in sequences for a, b in zip(s, s[1:], strict=False)], np.int64))
        self.automaton = Automaton(sequences)
        self.shortest = min([min_words, *self.sizes[: len(self.phrases)]])
        #: For each state the phrases that end wherever it ends, with their lengths.
        self.phrase_ends: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for k, sequence in enumerate(sequences[: len(self.phrases)]):
            *_, (own, _) = self.automaton.walk(sequence)
            for state in range(len(self.automaton.link)):
                above = state
                while above > 0 and above != own:
                    above = self.automaton.link[above]
                if above == own:
                    self.phrase_ends[state].append((k, len(sequence)))

    def run(self, words: list[int], first: int, places: list, matches: dict) -> None:
        """Adds what a run of known words holds; its first word has number `first` in the document."""
        found = list(self.automaton.walk(words))
        for at, (state, length) in enumerate(found):
            for k, size in self.phrase_ends[state]:
                if length >= size:
                    places.append((self.phrases[k], first + at - size + 1))
            if length >= self.min_words and (at + 1 == len(found) or found[at + 1][1] <= length):
                for number, ends in self.automaton.places[state].items():
                    if number >= len(self.phrases):
                        matches.setdefault(number, []).extend((first + at - length + 1, first + at, end - length + 1, end) for end in ends)

    def chains(self, matches: dict) -> list[dict]:
        """For each template the chains of matches, in order in text and template with small gaps, that cover most of it; of chains that overlap the one that covers more, then the earlier one."""
        out = []
        for number, own in sorted(matches.items()):
            own.sort()
            best: list[tuple[int, int]] = []
            for k, (begin, end, at, _) in enumerate(own):
                covered, start = end - begin + 1, begin
                for j in range(k - 1, -1, -1):
                    if begin - own[j][1] > self.max_gap + self.sizes[number]:
                        break
                    if own[j][1] < begin <= own[j][1] + self.max_gap and own[j][3] < at and best[j][0] + end - begin + 1 > covered:
                        covered, start = best[j][0] + end - begin + 1, best[j][1]
                best.append((covered, start))
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(((c, s, own[k][1]) for k, (c, s) in enumerate(best)), key=lambda x: (-x[0], x[1], x[2])):
                at = bisect.bisect_left(taken, (start, end))
                if (at and taken[at - 1][1] >= start) or (at < len(taken) and taken[at][0] <= end):
                    continue
                taken.insert(at, (start, end))
                out.append({"label": self.templates[number - len(self.phrases)], "first": start, "last": end, "coverage": covered / self.sizes[number]})
        return out

    def scan(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[list], list[list[dict]]]:
        words = Words(*utf8(batch.column("__text")), ALNUM)
        hashes = words.hashes(fold=LOWER)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        ids = self.ids[at]
        # a run goes on while words are known and follow each other in some sequence
        new = np.ones(len(known) + 1, bool)
        new[1:-1] = (words.doc[1:] != words.doc[:-1]) | ~known[:-1] | ~known[1:] | ~np.isin(ids[:-1] * self.n_words + ids[1:], self.pairs)
        begin = np.flatnonzero(known & new[:-1])
        end = np.flatnonzero(known & new[1:]) + 1
        places: list[list] = [[] for _ in range(batch.num_rows)]
        matches: list[dict] = [{} for _ in range(batch.num_rows)]
        for b, e in zip(begin[end - begin >= self.shortest].tolist(), end[end - begin >= self.shortest].tolist(), strict=True):
            doc = int(words.doc[b])
            self.run(ids[b:e].tolist(), int(words.pos[b]), places[doc], matches[doc])
        return words.n, places, [self.chains(m) if m else [] for m in matches]


def scan_licences(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None, min_words: int = 4, max_gap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, places of phrases (label, first word) and template spans (label, first and last word, coverage).

    Only pairs of words that some licence has move the automaton; any other word sets it back to its start, so a text costs one
    vectorised pass over its bytes and a step for each word of such pairs. Matches of min_words words or more that cannot be made longer
    to the right are chained, at most max_gap words apart; spans are chains that don't overlap, all of a template's in a text, and coverage is the share of
    its words that the chain matched. Words are known by 64-bit hashes of their bytes. Null counts as empty and has no words. Rows stand alone: ties, repeated rows and
    null ids are kept as they are.
    """
    setup = (phrases or PHRASES, templates or TEMPLATES, min_words, max_gap)
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
    place = pa.struct([("label", pa.string()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*setup)
        for batch in slices(batches, "__text"):
            n, places, spans = scanner.scan(batch)
            found = pa.array([[{"label": a, "first": b} for a, b in p] for p in places], pa.list_(place))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), found, pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "places", "spans"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("__text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, first: long>>, spans array<struct<label: string, first: long, last: long, coverage: double>>")
