"""License scans by a generalised suffix automaton of license words.

The automaton holds all template texts, word by word.  A file's words run through it and give
matching statistics: the longest suffix read so far that some template contains.  Matches that
cannot be extended (in their template) are kept from ``shortest`` words on.  The best chain of matches that follow each other
in file and template is found for each template; its covered share of the template is its score.

Most words of a file are in no template, so numpy first finds the places where two neighbouring
words are neighbours in some template; only those stretches go through the automaton, word by
word.  A stretch that is left out has matches of one word at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._words import Words, blocks, starts_inside, utf8

#: Phrases whose places are counted one by one, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"""
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
_BSD_END = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_GNU_END = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details"
#: Texts of licenses and of their notices by label; several texts of a label are templates of their own.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "this software is licensed under the mit license"),
    ("mit", _MIT),
    ("mit", f"{_MIT} {_AS_IS}"),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", _GNU.format("general public license", 2)),
    ("gpl", _GNU.format("general public license", 3)),
    ("gpl", f"{_GNU.format('general public license', 3)} {_GNU_END.format('general public license')}"),
    ("lgpl", _GNU.format("lesser general public license", 3)),
    ("lgpl", _GNU.format("lesser general public license", "2 1").replace("program", "library")),
    ("agpl", _GNU.format("affero general public license", 3)),
    ("bsd", _BSD.split(" redistributions in binary")[0]),
    ("bsd", f"{_BSD} {_BSD_END}"),
    ("bsd", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


@dataclass
class Match:
    """Words ``start`` .. ``stop`` - 1 of a file equal words ``place`` .. of a template."""

    start: int
    stop: int
    template: int
    place: int


class Automaton:
    """Generalised suffix automaton over lists of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, i))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.longest[v]):  # ends go to shorter suffixes
            self.ends[self.link[v]] += self.ends[v]

    def _state(self, longest: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest text followed by w, set apart from longer texts if need be."""
        q = self.next[p][w]
        if self.longest[q] == self.longest[p] + 1:
            return q
        twin = self._state(self.longest[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.longest[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        v = size = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                size = self.longest[v]
            if w in self.next[v]:
                v = self.next[v][w]
                size += 1
            yield v, size


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str], shortest: int = 4, covered: float = 0.6, gap: int = 30):
        self.shortest, self.covered, self.gap = shortest, covered, gap
        texts = [*base, *(t for _, t in templates)]
        split = [re.findall(_WORD, t.lower()) for t in texts]
        vocabulary = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = Words([w.encode() for w in vocabulary], space=NO_WORD).hashes()
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        sequences = [[number[w] for w in ws] for ws in split]
        self.n_base, self.base_labels = len(base), list(base.values())
        self.labels = [*base.values(), *(x for x, _ in templates)]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.pairs = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        # base phrases that are suffixes of a state's texts (and the match length from which on):
        # a phrase belongs to one state, and is a suffix of all states whose links lead to that one
        a, self.phrases = self.automaton, []
        for v in range(len(a.link)):
            own, u = [], v
            while u > 0:
                own += [(p, self.sizes[p]) for p in range(self.n_base) if a.longest[a.link[u]] < self.sizes[p] <= a.longest[u] and (p, self.sizes[p] - 1) in a.ends[u]]
                u = a.link[u]
            self.phrases.append(own)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def stretches(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word's place in it, word numbers) of stretches that templates may share."""
        number = self.numbers(words.hashes())
        at, _ = starts_inside(words.first, words.count, 2)
        ok = np.zeros(len(number) + 1, bool)
        a, b = number[at], number[at + 1]
        ok[at] = (a >= 0) & (b >= 0) & self.pairs[a, b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok)).astype(np.int8)))
        docs = np.searchsorted(words.first, edge[::2], "right") - 1
        for doc, i, j in zip(docs.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
            yield doc, i - int(words.first[doc]), number[i : j + 1].tolist()

    def scan(self, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int, int]], list[Match]]:
        """Base places (phrase, first word, last word) and matches of one text."""
        places, matches = [], []
        a = self.automaton
        for first, words in stretches:
            got = list(a.statistics(words))
            now = self.ending(*got[0]) if got else {}
            for i, (v, size) in enumerate(got):
                for p, least in self.phrases[v]:
                    if size >= least:
                        places.append((p, first + i - self.sizes[p] + 1, first + i))
                after = self.ending(*got[i + 1]) if i + 1 < len(got) else {}
                matches += [Match(first + i - n + 1, first + i + 1, t, e - n + 1) for (t, e), n in now.items() if (t, e + 1) not in after]
                now = after
        return places, matches

    def ending(self, v: int, size: int) -> dict[tuple[int, int], int]:
        """The template places that what was read last ends at, and how many words match there.

        Places of shorter suffixes are those of the states that the links lead to.
        """
        a, out = self.automaton, {}
        while size >= self.shortest:
            for place in a.ends[v]:
                if place[0] >= self.n_base:
                    out.setdefault(place, size)
            v = a.link[v]
            size = a.longest[v]
        return out

    def chains(self, matches: list[Match]) -> dict[int, tuple[float, int, int]]:
        """For each template its best chain: (share covered, first word, last word).

        A match follows another if it goes further in both texts and leaves out ``gap`` words of the
        file at most; where they overlap in either text, the common words count once.  The best
        chain that ends with each match comes from the best ones that it may follow, so a stray match
        or a repetition ends no chain.
        """
        best: dict[int, tuple[float, int, int]] = {}
        by: dict[int, list[Match]] = {}
        for m in matches:
            by.setdefault(m.template, []).append(m)
        for t, own in by.items():
            own.sort(key=lambda m: (m.start, m.place))
            longest = max(m.stop - m.start for m in own)
            ends: list[tuple[int, int]] = []  # words covered and first word of the best chain that ends with each match
            low = 0
            for i, m in enumerate(own):
                size = m.stop - m.start
                held = (size, m.start)
                while own[low].start + longest + self.gap < m.start:
                    low += 1
                for k in range(low, i):
                    p = own[k]
                    n = p.stop - p.start
                    both = max(0, p.stop - m.start, p.place + n - m.place)
                    if p.start < m.start and p.place < m.place and both < size and m.start - p.stop <= self.gap:
                        held = max(held, (ends[k][0] + size - both, ends[k][1]), key=lambda x: (x[0], -x[1]))
                ends.append(held)
                share = held[0] / self.sizes[t]
                if share > best.get(t, (0.0,))[0]:
                    best[t] = (share, held[1], m.stop - 1)
        return best


_scanners: dict[tuple, Scanner] = {}


def _scanner(templates: tuple, base: tuple) -> Scanner:
    if (templates, base) not in _scanners:
        _scanners[templates, base] = Scanner(list(templates), dict(base))
    return _scanners[templates, base]


def _run(templates: tuple, base: tuple):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(templates, base)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in utf8(batch.column(1))]
            for i, j in blocks(texts):
                words = Words(texts[i:j], lower=True, space=NO_WORD)
                found: dict[int, list] = {}
                for doc, first, numbers in s.stretches(words):
                    found.setdefault(doc, []).append((first, numbers))
                rows = []
                for k, n in enumerate(words.count.tolist()):
                    places, matches = s.scan(found[k]) if k in found else ([], [])
                    good = {t: c for t, c in s.chains(matches).items() if c[0] >= s.covered}
                    own = {s.labels[p] for p, _, _ in places}
                    score = max([c[0] for c in good.values()] + [1.0] * bool(places), default=0.0)
                    spans = [{"label": s.labels[t], "first": c[1], "last": c[2], "covered": c[0]} for t, c in sorted(good.items())]
                    rows.append((ids[i + k], n, len(places), min((p[1] for p in places), default=None), max((p[1] for p in places), default=None), ",".join(sorted(own)), ",".join(sorted(own | {s.labels[t] for t in good})), score, spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """License findings of each text of ``docs`` (doc_id, text), rows one by one.

    n_words; n_base, first_word, last_word and base_labels for the base phrases (all their places;
    ``first_word`` and ``last_word`` are the smallest and largest start); labels, which adds the
    labels of templates covered by 0.6 or more; score, the largest share covered (1 with a base
    phrase); spans of the template chains.  Null and empty texts have no words and score 0.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.  The automaton is built once in each worker
    and its size is that of the templates.
    """
    t = tuple(map(tuple, templates if templates is not None else TEMPLATES))
    b = tuple((base if base is not None else BASE).items())
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,covered:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(t, b), schema)
