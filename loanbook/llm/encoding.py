"""Token ids of whole texts from the ``tokenizers`` library, with a memo of text units.

Both byte-level vocabularies used here split text at white space: no token
crosses a place where a white-space byte follows a character that isn't white
space, and what follows such a place is encoded independently of what stands
before it. A text is therefore cut at those places into units (white space
and the run after it), each distinct unit is encoded once by the library, and
the ids of the text are the concatenation. The tests compare the result with
the library's encoding of the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from loanbook.llm.arrowtext import span_hashes

#: memory bound of a worker's memo; a full memo starts anew (no effect on results)
MEMO_UNITS = 2_000_000


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the units: document starts, and white-space bytes after a
    character that certainly isn't white space (ASCII 0x21-0x7E, or a two-byte
    character above U+00FF's first block, i.e. lead byte 0xC3-0xDF)."""
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n:
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D) & (data != 0x0B) & (data != 0x0C))
        plain = (data >= 0x21) & (data <= 0x7E)
        cut[1:] = space[1:] & plain[:-1]
        lead = (data >= 0xC3) & (data <= 0xDF)
        cut[2:] |= space[2:] & (data[1:-1] >= 0x80) & lead[:-2]
        first = offsets[:-1]
        cut[first[(first < n) & (offsets[1:] > first)]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Encodes batches of texts; keeps the ids of every unit it has met."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(counts.sum()))
        begin = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, hashes)  # both ascending
        self.slot = np.insert(self.slot, at, np.arange(len(self.begin), len(self.begin) + len(lists)))
        self.keys = np.insert(self.keys, at, hashes)
        self.begin = np.concatenate([self.begin, begin])
        self.count = np.concatenate([self.count, counts])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        return np.where(found, self.slot[at] if len(self.slot) else 0, -1)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit starts, slot of each unit's ids)."""
        starts = unit_starts(data, offsets)
        if not len(starts):
            return starts, np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        distinct, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_UNITS:
            self._forget()
        slots = self._find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._learn(distinct[new], [data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in one[new]])
            slots = self._find(distinct)
        return starts, slots[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit starts, tokens of each unit)."""
        starts, slots = self.units(data, offsets)
        return starts, self.count[slots] if len(slots) else slots

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each followed by ``end_id``; first id of each document and the end)."""
        starts, slots = self.units(data, offsets)
        counts = self.count[slots] if len(slots) else np.zeros(0, np.int64)
        total = int(counts.sum())
        first = np.cumsum(counts) - counts
        place = np.repeat((self.begin[slots] if len(slots) else first) - first, counts) + np.arange(total)
        body = self.ids[place] if total else np.zeros(0, np.uint32)
        running = np.concatenate([[0], np.cumsum(counts)])
        border = running[np.searchsorted(starts, offsets)]
        n = len(offsets) - 1
        out = np.full(total + n, end_id, np.uint32)
        where = np.arange(total) + np.repeat(np.arange(n), np.diff(border))
        out[where] = body
        return out, border + np.arange(n + 1)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(vocabulary: str) -> UnitEncoder:
    """The worker's encoder; its memo lives as long as the worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = UnitEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def vocabulary_path(name: str) -> str:
    """Path of an installed public vocabulary, as a default of the queries."""
    import public_tokenizers
    return public_tokenizers.path(name)
