"""Edit-aware token counts.

A document is kept as leaves, runs of whole pre-token units with at least
``LEAF_BYTES`` bytes, under a segment tree of sums (bytes and tokens). An edit
finds its leaves by descending on byte sums, re-encodes only those leaves (and
a neighbour, where the edit touches the characters next to a border), and
updates the sums up to the root. Leaf borders are places that no token
crosses (see ``encoding``), so the root always equals the count of the whole
text encoded anew.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import row_chunks, utf8
from loanbook.llm.encoding import UnitEncoder, encoder
from loanbook.llm.tables import map_arrow, only

LEAF_BYTES = 512

#: what the registered query masks: network addresses, mail addresses, long numbers
MASKED = (r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})|(?P<mail>[\w.+-]{1,64}@[\w-]{1,255}\.[\w.-]{1,255})|(?P<number>\d{9,})")


class TokenTree:
    """Segment tree of one document: ``bytes_`` and ``tokens`` are heaps whose
    node i sums nodes 2i and 2i + 1; the leaves' texts stand beside them."""

    def __init__(self, leaves: list[bytes], tokens: list[int]):
        size = 1
        while size < max(1, len(leaves)):
            size *= 2
        self.size, self.leaves = size, leaves + [b""] * (size - len(leaves))
        self.bytes_ = [0] * size + [len(x) for x in self.leaves]
        self.tokens = [0] * size + list(tokens) + [0] * (size - len(tokens))
        for i in range(size - 1, 0, -1):
            self.bytes_[i] = self.bytes_[2 * i] + self.bytes_[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> bytes:
        return b"".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first byte) of the byte ``at``; the end belongs to the last leaf with bytes."""
        at = min(at, max(0, self.bytes_[1] - 1))
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.bytes_[i]:
                before += self.bytes_[i]
                i += 1
        return i - self.size, before

    def _set(self, leaf: int, text: bytes, tokens: int) -> None:
        i = leaf + self.size
        self.leaves[leaf], self.bytes_[i], self.tokens[i] = text, len(text), tokens
        i //= 2
        while i:
            self.bytes_[i] = self.bytes_[2 * i] + self.bytes_[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def edit(self, start: int, end: int, new: bytes, count) -> int:
        """Replace bytes [start, end) and recount; ``count`` gives the tokens of
        a byte string. Returns the bytes re-encoded."""
        total = self.bytes_[1]
        first, begin = self._leaf(start)
        if begin and start <= begin:  # the border's white space isn't left of the edit
            first, begin = self._leaf(begin - 1)
        # the character before the right border must stay: it ends two bytes behind the edit at least
        last, at = self._leaf(min(total, end + 1) if total else 0)
        region_end = at + self.bytes_[last + self.size]
        if end + 2 > region_end and region_end < total:
            last, at = self._leaf(region_end)
            region_end = at + self.bytes_[last + self.size]
        old = b"".join(self.leaves[first:last + 1])
        text = old[:start - begin] + new + old[end - begin:]
        self._set(first, text, count(text))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, b"", 0)
        return len(text)


def count_text(enc: UnitEncoder, text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(enc.counts(data, np.array([0, len(data)]))[1].sum())


def build_tree(data: np.ndarray, starts: np.ndarray, tokens: np.ndarray, leaf_bytes: int = LEAF_BYTES) -> TokenTree:
    """Tree of one document from its unit starts and unit token counts."""
    if not len(starts):
        return TokenTree([], [])
    bucket = starts // leaf_bytes
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    borders = np.append(starts[head], len(data)).tolist()
    raw = data.tobytes()
    return TokenTree([raw[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)], np.add.reduceat(tokens, head).tolist())


def _edits_of(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in pattern.finditer(text)]


def _apply(tree: TokenTree, text: str, edits: list[tuple[int, int, str]], enc: UnitEncoder) -> int:
    """Edits by character offsets, from the last to the first, so that the
    offsets of the others stay valid. Returns the bytes re-encoded."""
    done, at, byte = 0, len(text), tree.bytes_[1]
    for start, end, new in sorted(edits, key=lambda e: e[:2], reverse=True):
        if not 0 <= start <= end <= at:
            raise ValueError("edits must not overlap or leave the text")
        byte -= len(text[end:at].encode())
        first = byte - len(text[start:end].encode())
        done += tree.edit(first, byte, (new or "").encode(), lambda t: count_text(enc, t))
        at, byte = start, first
    return done


def _counted(batches, vocabulary: str, pattern: str | None, with_text: bool):
    enc, found = encoder(vocabulary), re.compile(pattern, re.ASCII) if pattern else None
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id")
        edits = batch.column("edits").to_pylist() if pattern is None else None
        for i, j in row_chunks(offsets):
            chunk, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            starts, tokens = enc.counts(chunk, off)
            border = np.searchsorted(starts, off)
            rows = []
            for d in range(j - i):
                own = chunk[off[d]:off[d + 1]]
                own_starts, own_tokens = starts[border[d]:border[d + 1]] - off[d], tokens[border[d]:border[d + 1]]
                text = own.tobytes().decode("utf-8", "replace")
                todo = _edits_of(text, found) if found else [
                    (e["start"], e["end"], e["replacement"]) for e in edits[i + d] or [] if e is not None]
                before = int(own_tokens.sum())
                if todo:
                    tree = build_tree(own, own_starts, own_tokens)
                    again = _apply(tree, text, todo, enc)
                    rows.append((before, len(todo), tree.n_tokens, len(own), again, tree.text().decode() if with_text else None))
                else:
                    rows.append((before, 0, before, len(own), 0, text if with_text else None))
            cols = list(zip(*rows, strict=True))
            arrays = [ids.slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols[:5]]]
            names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_bytes", "reencoded_bytes"]
            if with_text:
                arrays, names = [*arrays, pa.array(cols[5], pa.string())], [*names, "edited_text"]
            yield pa.record_batch(arrays, names=names)


_SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_bytes long, reencoded_bytes long"


def edited_counts(docs: DataFrame, vocabulary: str, edits_col: str | None = None, pattern: str | None = None,
                  with_text: bool = True) -> DataFrame:
    """Tokens of every whole text before and after its edits.

    Edits come from ``edits_col`` (array of struct<start, end, replacement>
    with character offsets into the text) or from ``pattern``, whose matches
    are replaced by the name of the group that matched. Returns doc_id,
    n_tokens, n_edits, n_tokens_edited, n_bytes, reencoded_bytes and, with
    ``with_text``, the edited text. A null text is empty; no or null edits
    leave the counts equal; overlapping edits raise; an empty table gives an
    empty result; further columns are ignored.
    """
    if (edits_col is None) == (pattern is None):
        raise ValueError("give either edits_col or pattern")
    rows = only(docs, "doc_id", "text", *([edits_col] if edits_col else []))
    rows = rows.toDF("doc_id", "text", *["edits"] * bool(edits_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows, _counted, _SCHEMA + ", edited_text string" * with_text, vocabulary=vocabulary,
                     pattern=pattern, with_text=with_text)
