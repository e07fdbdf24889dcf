"""Licence scan by a generalised suffix automaton over the templates' words.

The automaton holds every run of words of every template. A text is streamed
through it word by word, which gives the matching statistics: the length of
the longest run of template words that ends at each word, and its state.
Matches that can't be extended are chained, in the order of text and template,
into covered spans of a template; a template whose covered share reaches
``COVERED`` gives its label. Short phrases are templates too and count where
they stand whole.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import PUNCTUATED, lower_ascii, row_chunks, span_hashes, spans, utf8
from loanbook.llm.tables import map_arrow, only

# Phrases with their labels, and opening or operative sentences
# of common public licences.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"),
}

#: words of a match that may enter a chain, words that a chain may jump, and the covered share that gives a label
LONG_MATCH, GAP, COVERED = 4, 40, 0.75


def words_of(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


class Scanner:
    """Generalised suffix automaton of word sequences with their labels."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.texts = [words_of(p) for p in phrases] + [words_of(t) for t in templates.values()]
        self.labels = [*phrases.values(), *templates]
        self.n_phrases = len(phrases)
        self.words = {w: i for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.next, self.link, self.size = [{}], [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (text, words up to the end) of each state's longest run
        for k, text in enumerate(self.texts):
            last = 0
            for at, w in enumerate(text):
                last = self._extend(last, self.words[w])
                self.ends[last].append((k, at + 1))
        for v in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(e)) for e in self.ends]
        # a phrase ends where its state is the state or one of its suffixes
        self.phrase_ends: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for v in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            own = [(k, len(self.texts[k])) for k in range(self.n_phrases)
                   if (k, len(self.texts[k])) in self.ends[v] and self.size[self.link[v]] < len(self.texts[k]) <= self.size[v]]
            self.phrase_ends[v] = self.phrase_ends[self.link[v]] + own
        raw = [w.encode() for w in self.words]
        length = np.array([len(w) for w in raw])
        ends = np.cumsum(length)
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - length, ends)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]

    def _state(self, size: int, next_: dict, link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the run of size[p] + 1 words into q, cloned off q if q is longer."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)

    def scan(self, ids: list[int], first: int, places: list, matches: list) -> None:
        """Matching statistics of one run of known words that starts at word
        ``first``: phrase places (start, phrase), and matches (end, length,
        state) that the next word doesn't extend."""
        v, size = 0, 0
        for i, w in enumerate(ids):
            before = (v, size)
            while v and w not in self.next[v]:
                v = self.link[v]
                size = self.size[v]
            v = self.next[v].get(w, 0)
            size = size + 1 if v else 0
            if size <= before[1] and before[1] >= LONG_MATCH:
                matches.append((first + i, before[1], before[0]))
            for k, n in self.phrase_ends[v]:
                if n <= size:
                    places.append((first + i + 1 - n, k))
        if size >= LONG_MATCH:
            matches.append((first + len(ids), size, v))

    def _chain(self, parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """(covered words, first word) of the best chain up to each part (end, place in the template, words)."""
        best: list[tuple[int, int]] = []
        for i, (end, at, size) in enumerate(parts):
            covered, first = size, end - size
            for j in range(i - 1, -1, -1):
                e, a, _ = parts[j]
                if end - e > GAP + size:
                    break
                fresh = min(size, end - e, at - a)
                if fresh > 0 and at - a - fresh <= GAP and best[j][0] + fresh > covered:
                    covered, first = best[j][0] + fresh, best[j][1]
            best.append((covered, first))
        return best

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(first word, word behind the last, text, covered share): of each
        template every chain that covers ``COVERED`` of it and doesn't overlap
        a better one of the same template, or else its best chain."""
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, v in matches:
            for k, at in self.ends[v]:
                if k >= self.n_phrases and at >= size:
                    by_text.setdefault(k, []).append((end, at, size))
        out = []
        for k, parts in by_text.items():
            whole, found, top = len(self.texts[k]), [], None
            open_ = [parts]
            while open_:  # chains are looked for anew between the ones found
                left = []
                for some in open_:
                    best = self._chain(some)
                    order = sorted(range(len(some)), key=lambda x, best=best: (-best[x][0], x))
                    if top is None:
                        top = (best[order[0]][1], some[order[0]][0], k, best[order[0]][0] / whole)
                    own: list[tuple[int, int]] = []
                    for i in order:
                        covered, first = best[i]
                        if covered < COVERED * whole:
                            break
                        at = bisect.bisect(own, (first, some[i][0]))
                        if (at == 0 or own[at - 1][1] <= first) and (at == len(own) or some[i][0] <= own[at][0]):
                            own.insert(at, (first, some[i][0]))
                            found.append((first, some[i][0], k, covered / whole))
                    if own:
                        gaps = zip([0, *[e for _, e in own]], [*[f for f, _ in own], some[-1][0] + 1], strict=True)
                        left += [[p for p in some if p[0] - p[2] >= x and p[0] <= y] for x, y in gaps]
                open_ = [p for p in left if p]
            out += sorted(found) or [top]
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(phrases: dict[str, str], templates: dict[str, str]) -> Scanner:
    """The worker's scanner of these texts; the last one stays."""
    key = (tuple(phrases.items()), tuple(templates.items()))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(phrases, templates)
    return _SCANNERS[key]


def _scanned(batches, with_spans: bool, phrases: dict[str, str], templates: dict[str, str]):
    s = scanner(phrases, templates)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in row_chunks(offsets):
            chunk, off = lower_ascii(data[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
            starts, ends, doc = spans(chunk, off, PUNCTUATED)
            ids = s.word_ids(span_hashes(chunk, starts, ends))
            border = np.searchsorted(doc, np.arange(j - i + 1))
            known = ids >= 0
            head = known.copy()
            head[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
            tail = known.copy()
            tail[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
            a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
            long = b - a >= min(len(t) for t in s.texts)
            places: dict[int, list] = {}
            matches: dict[int, list] = {}
            for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
                d = int(doc[x])
                s.scan(ids[x:y].tolist(), x - int(border[d]), places.setdefault(d, []), matches.setdefault(d, []))
            rows = []
            for d in range(j - i):
                p, covered = places.get(d, ()), s.spans(matches[d]) if matches.get(d) else []
                whole = [c for c in covered if c[3] >= COVERED]
                base = {s.labels[k] for _, k in p}
                rows.append((int(border[d + 1] - border[d]), len(p), min((x for x, _ in p), default=None),
                             max((x for x, _ in p), default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | {s.labels[k] for *_, k, _ in whole})),
                             1.0 if p else max((c[3] for c in covered), default=0.0),
                             [{"label": s.labels[k], "first": x, "end": y, "covered": c} for x, y, k, c in whole]))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            n = 8 if with_spans else 7
            yield pa.record_batch([batch.column(0).slice(i, j - i), *[pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False)]],
                                  names=["doc_id", *names[:n]])


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))


def scan(docs: DataFrame, with_spans: bool = True, templates: dict[str, str] | None = None,
         phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of whole
    phrases), first_word and last_word (smallest and largest start of those,
    else null), base_labels and labels (sorted, comma-joined, '' for none),
    score (1 with a phrase, else the largest covered share of a template) and,
    with ``with_spans``, the covered spans of the templates that gave a label.

    Null and empty texts have no words and score 0; repeated rows give
    repeated results; an empty table gives an empty result; further columns
    are ignored."""
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double" + ", spans array<struct<label: string, first: bigint, end: bigint, covered: double>>" * with_spans)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return map_arrow(rows, _scanned, schema, with_spans=with_spans, phrases=PHRASES if phrases is None else phrases,
                     templates=TEMPLATES if templates is None else templates)
