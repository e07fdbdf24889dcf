"""Cost-balanced packing of documents into fixed-length training sequences.

The cost of a piece of n tokens in its sequence is estimated as
``linear * n + quadratic * n**2`` (dense layers plus attention inside the
document). Each task packs its own documents, block by block: whole multiples
of the sequence length become full sequences; the rest of each document is
assigned, in descending cost, to the sequence of lowest cost with room for it.
What fits nowhere whole is cut. What a block's full sequences don't take is
carried to the next block, and the last tokens of a task fill sequences whose
lengths are powers of two, so no sequence needs padding. No shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import row_chunks, utf8
from loanbook.llm.encoding import encoder
from loanbook.llm.tables import map_arrow, only

#: a block is packed when it holds so many tokens (memory of a task)
BLOCK_TOKENS = 1 << 21
#: costs per token and per pair of tokens; equal at 4096 tokens
LINEAR, QUADRATIC = 4096.0, 1.0


def assign(lengths: list[int], room: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset) of pieces that fill
    sequences with ``room``; documents in descending length."""
    left, cost = room.astype(np.int64).copy(), np.zeros(len(room))
    out = []
    total_left = int(left.sum())
    for d in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        done, n = 0, lengths[d]
        while done < n and total_left:
            rest = n - done
            k = int(np.argmin(np.where(left >= rest, cost, np.inf)))
            if left[k] < rest:  # no sequence has room for all of it: cut
                k = int(np.argmin(np.where(left > 0, cost, np.inf)))
            m = min(rest, int(left[k]))
            out.append((d, done, m, k, int(room[k] - left[k])))
            left[k] -= m
            cost[k] += linear * m + quadratic * m * m
            total_left -= m
            done += m
    return out


class _Packer:
    def __init__(self, part: int, size: int, linear: float, quadratic: float, with_ids: bool):
        self.size, self.linear, self.quadratic, self.with_ids = size, linear, quadratic, with_ids
        self.next = part << 40
        self.rest: list[tuple[int | None, int, int, np.ndarray]] = []  # (doc, start, doc tokens, ids)
        self.held, self.rows = 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for a in range(0, whole, self.size):
            self._row(doc, a, len(ids), ids[a:a + self.size], self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.rest.append((doc, whole, len(ids), ids[whole:].copy()))
            self.held += len(ids) - whole

    def _row(self, doc, start, doc_tokens, ids, sequence, offset) -> None:
        raw = ids.astype("<u4").tobytes()
        self.rows.append((doc, start, len(ids), zlib.crc32(raw), doc_tokens, sequence, offset, raw if self.with_ids else None))

    def pack(self, last: bool) -> None:
        full, over = divmod(self.held, self.size)
        room = [self.size] * full
        if last:
            room += [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
        rest, self.rest, self.held = self.rest, [], 0
        taken = [0] * len(rest)
        if room:
            for d, a, m, k, offset in assign([len(r[3]) for r in rest], np.array(room), self.linear, self.quadratic):
                doc, start, tokens, ids = rest[d]
                self._row(doc, start + a, tokens, ids[a:a + m], self.next + k, offset)
                taken[d] = a + m
        self.next += len(room)
        for (doc, start, tokens, ids), t in zip(rest, taken, strict=True):
            if t < len(ids):
                self.rest.append((doc, start + t, tokens, ids[t:]))
                self.held += len(ids) - t

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_KINDS)
        self.rows = []
        out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))
        return out if self.with_ids else out.drop_columns(["ids"])


_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
          "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}


def _pieces(batches, vocabulary: str, end_id: int, size: int, linear: float, quadratic: float, with_ids: bool):
    enc = encoder(vocabulary)
    packer = _Packer(TaskContext.get().partitionId(), size, linear, quadratic, with_ids)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names = batch.column(0).to_pylist()
        for i, j in row_chunks(offsets):
            ids, border = enc.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], end_id)
            for d in range(j - i):
                packer.add(names[i + d], ids[border[d]:border[d + 1]])
            if packer.held >= BLOCK_TOKENS:
                packer.pack(False)
            if len(packer.rows) >= 10_000:
                yield packer.drain()
    packer.pack(True)
    if packer.rows:
        yield packer.drain()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, linear: float = LINEAR,
         quadratic: float = QUADRATIC, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset in the sequence, and with
    ``with_ids`` the ids as little-endian unsigned 32-bit integers.

    Every id of every document (with ``end_id`` after it) lies in exactly one
    piece; the pieces of a sequence leave no gap. Null texts are empty and
    give one piece of one id; rows that repeat are packed once each; an empty
    table gives no piece; further columns are ignored.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids binary" * with_ids)
    rows = only(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return map_arrow(rows, _pieces, schema, vocabulary=vocabulary, end_id=end_id, size=size, linear=linear,
                     quadratic=quadratic, with_ids=with_ids)
