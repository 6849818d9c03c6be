"""Licence scan with a generalised suffix automaton (operator 4).

The words of all licence templates and phrases make one automaton whose states are the sets of their
substrings with equal places. A text is streamed through it word by word; the state and the length
of the longest match that ends at each word (the matching statistics) say which phrases end there and
which stretches of which templates stand in the text. Long stretches are chained, in order in both the
template and the text, into spans, and a template is found where a span covers enough of it.
"""

from __future__ import annotations

import bisect
import functools
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracemill.llm.common import per_text, text_pieces

# Phrases whose consecutive words are a base place, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licence notices, with the labels that they add.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions",
    ),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version",
    ),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("all-rights-reserved", "all rights reserved"),
)

#: Words a match needs to enter a chain; a shorter template must match whole.
LONG_MATCH = 3
#: Words of the text, and of the template, that a chain may skip between two matches.
MAX_GAP = 6
#: Share of a template's words that a span must cover.
MIN_COVER = 0.8

#: Letters A-Z to small ones; digits, small letters and all bytes above ASCII stay; the rest is space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


class Automaton:
    """A generalised suffix automaton of word sequences, with the places of each state."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]  # a suffix ends wherever the longer string does
        self.ends[0] = set()
        self.vocabulary = frozenset(w for s in sequences for w in s)

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _copy_for(self, state: int, word: bytes, target: int) -> int:
        """Split off the part of ``target`` that ``state`` reaches in one step."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._copy_for(last, word, target)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._copy_for(state, word, target)
        return new

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """State and length of the longest match that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        following = self.next[state].get(word)
        return (0, 0) if following is None else (following, length + 1)


class Scanner:
    """Phrases and templates in texts."""

    def __init__(self):
        phrases = [words(p.encode()) for p in PHRASES]
        templates = [words(t.encode()) for _, t in TEMPLATES]
        self.phrase_labels = list(PHRASES.values())
        self.template_labels = [label for label, _ in TEMPLATES]
        self.template_words = [len(t) for t in templates]
        self.automaton = auto = Automaton(phrases + templates)
        #: Per state its places in templates, as (template, words up to its end).
        self.places = [sorted((n - len(phrases), e) for n, e in ends if n >= len(phrases)) for ends in auto.ends]
        #: Per state the phrases that are suffixes of its longest string, as (words, phrase).
        self.phrase_ends: list[list[tuple[int, int]]] = [[] for _ in auto.ends]
        self.shortest = min(map(len, phrases))
        for number, phrase in enumerate(phrases):
            home = 0
            for word in phrase:
                home = auto.next[home][word]
            for state in range(len(auto.ends)):
                up = state
                while up > 0 and up != home:
                    up = auto.link[up]
                if up == home:
                    self.phrase_ends[state].append((len(phrase), number))

    def scan(self, data: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
        """(words, base places, first, last, base labels, all labels, score) of a text."""
        step, phrase_ends, vocabulary = self.automaton.step, self.phrase_ends, self.automaton.vocabulary
        n, base, first, last, base_labels = 0, 0, None, None, set()
        matches: list[tuple[int, int, int]] = []  # (word after the match, words, state), not extendable
        state = length = 0
        for piece in text_pieces(data):
            found = words(piece)
            for i, word in enumerate(found, n):
                if word not in vocabulary:
                    if length:
                        if length >= LONG_MATCH:
                            matches.append((i, length, state))
                        state = length = 0
                    continue
                new_state, new_length = step(state, length, word)
                if new_length <= length and length >= LONG_MATCH:
                    matches.append((i, length, state))
                state, length = new_state, new_length
                if length >= self.shortest:
                    for size, phrase in phrase_ends[state]:
                        if size <= length:
                            base += 1
                            start = i - size + 1
                            first = start if first is None else min(first, start)
                            last = start if last is None else max(last, start)
                            base_labels.add(self.phrase_labels[phrase])
            n += len(found)
        if length >= LONG_MATCH:
            matches.append((n, length, state))
        shares = self._chained(matches)
        score = 1.0 if base else max(shares.values(), default=0.0)
        return n, base, first, last, base_labels, base_labels | set(shares), score

    def spans(self, data: bytes) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of each template span in a text."""
        matches: list[tuple[int, int, int]] = []
        state, length, n = 0, 0, 0
        for piece in text_pieces(data):
            for word in words(piece):
                new_state, new_length = self.automaton.step(state, length, word)
                if new_length <= length and length >= LONG_MATCH:
                    matches.append((n, length, state))
                state, length, n = new_state, new_length, n + 1
        if length >= LONG_MATCH:
            matches.append((n, length, state))
        return [(self.template_labels[t], a, b, c) for t, a, b, c in self._spans(matches)]

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of matches, in order in text and template, that cover enough of a template.

        A match extends every chain that it follows and starts one of its own; a chain that it does not extend stays
        open as long as its end is near. Of chains that end at one place of text and template the best is kept, and
        of complete ones that overlap in the text the one that covers most.
        """
        # per template, (text end, template end) of each open chain: (covered, text start)
        open_chains: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        complete: dict[int, list[tuple[int, int, int]]] = {}  # (covered, text start, text end)

        def keep(template: int, ended: dict[tuple[int, int], tuple[int, int]]) -> None:
            for (stop, _), (covered, start) in ended.items():
                if covered / self.template_words[template] >= MIN_COVER:
                    complete.setdefault(template, []).append((covered, start, stop))

        for end, size, state in matches:
            by_template: dict[int, list[int]] = {}
            for template, place in self.places[state]:
                if place >= size:
                    by_template.setdefault(template, []).append(place)
            for template, places in by_template.items():
                chains = open_chains.get(template, {})
                near = {at: c for at, c in chains.items() if end - size - at[0] <= MAX_GAP}
                keep(template, {at: c for at, c in chains.items() if at not in near})
                added: dict[tuple[int, int], tuple[int, int]] = {}
                for place in places:
                    best = (size, end - size)
                    for (stop, last), (covered, start) in near.items():
                        # words already covered count once; the rest must come later in the template
                        fresh = min(size, end - stop, place - last)
                        if fresh > 0 and place - fresh - last <= MAX_GAP and covered + fresh >= best[0]:
                            if covered + fresh > best[0] or start < best[1]:
                                best = (covered + fresh, start)
                    added[end, place] = best
                open_chains[template] = near | added
        for template, chains in open_chains.items():
            keep(template, chains)
        found = []
        for template, ended in complete.items():
            starts: list[int] = []
            taken: list[tuple[int, int, int]] = []  # in order, without overlaps
            for covered, start, stop in sorted(ended, key=lambda c: (-c[0], c[1], c[2])):
                at = bisect.bisect_left(starts, start)
                free = (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or stop <= starts[at])
                if free:
                    starts.insert(at, start)
                    taken.insert(at, (start, stop, covered))
            found += [(template, a, b, c / self.template_words[template]) for a, b, c in taken]
        return found

    def _chained(self, matches: list[tuple[int, int, int]]) -> dict[str, float]:
        best: dict[str, float] = {}
        for template, _, _, share in self._spans(matches):
            label = self.template_labels[template]
            best[label] = max(best.get(label, 0.0), share)
        return best


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``).

    ``n_base`` counts every place of every base phrase; first and last are the smallest and largest
    word, from 0, at which one starts. Labels are sorted and comma-joined; templates add theirs to the
    base ones. ``score`` is 1 with a base place, else the largest covered share of a found template.

    Edge cases: a null or empty text has no words, no places, null first and last words, empty labels and
    score 0. Long texts are streamed in pieces. Null ids stay null; repeated rows each give a row; an
    empty table gives no rows; other columns are ignored.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        scan = scanner().scan
        rows = [scan(t) for t in texts.cast(pa.binary()).to_pylist()]
        longs = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        names = [pa.array([",".join(sorted(r[k])) for r in rows], pa.string()) for k in (4, 5)]
        return [*longs, *names, pa.array([float(r[6]) for r in rows], pa.float64())]

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    fields += [T.StructField("score", T.DoubleType())]
    return per_text(docs, id_col, text_col, fields, compute)
