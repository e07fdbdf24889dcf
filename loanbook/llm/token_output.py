"""Token-ID output in patched frame-of-reference (PFOR) blocks.

Documents are put in ascending id order by one range shuffle, encoded, and
written as segments of whole documents. A segment holds its ids in blocks of
128: the block's minimum is subtracted, the differences are packed at the
width that the 90th percentile of the block needs, and larger differences go
to an exception list. An index of block starts allows reading single blocks.
Segments travel in the binary column of a Parquet table, so Spark's committer
makes the files whole when executors are lost, and any store can hold them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import row_chunks, utf8
from loanbook.llm.encoding import encoder
from loanbook.llm.tables import kept, map_arrow, only

BLOCK = 128
PERCENTILE = 0.9
#: a segment closes after the document that fills it
SEGMENT_IDS = 1 << 16
_HEAD = struct.Struct("<4sQIQI")
_MAGIC = b"PFR1"

SEGMENTS = ("part int, segment int, first_id long, n_ids long, doc_ids array<bigint>, "
            "doc_lengths array<bigint>, payload binary")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width to rows of 2*width 64-bit words."""
    lanes = values.reshape(-1, 64).T.astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return words.T.reshape(-1, 2 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(-1, width).T
    out = np.empty((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return out.T.reshape(-1, BLOCK)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # exact below 2**53


def encode_blocks(ids: np.ndarray) -> bytes:
    """PFOR bytes of an id sequence (unsigned 32-bit)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return _HEAD.pack(_MAGIC, 0, 0, 0, 0)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    k = int(PERCENTILE * (BLOCK - 1))
    width = _bit_length(np.partition(delta, k, axis=1)[:, k])
    outlier = _bit_length(delta) > width[:, None]
    where, position = np.nonzero(outlier)
    starts = np.concatenate([[0], np.cumsum(2 * width)]).astype(np.uint64)
    body = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            body[starts[of].astype(np.int64)[:, None] + np.arange(2 * w)] = _pack(
                delta[of] & np.uint32((1 << int(w)) - 1), int(w))
    return b"".join([
        _HEAD.pack(_MAGIC, n, blocks, len(body), len(where)), starts.tobytes(), low.tobytes(),
        width.astype(np.uint8).tobytes(), np.bincount(where, minlength=blocks).astype(np.uint8).tobytes(),
        body.tobytes(), position.astype(np.uint8).tobytes(), delta[outlier].tobytes()])


def decode_blocks(payload: bytes) -> np.ndarray:
    magic, n, blocks, words, outliers = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a PFOR segment")
    at = _HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out
    if not blocks:
        return np.zeros(0, np.uint32)
    starts, low = take("<u8", blocks + 1).astype(np.int64), take("<u4", blocks)
    width, patched = take("u1", blocks), take("u1", blocks)
    body, position, value = take("<u8", words), take("u1", outliers), take("<u4", outliers)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            grid[of] = _unpack(body[starts[of][:, None] + np.arange(2 * int(w))], int(w)).astype(np.uint32)
    grid[np.repeat(np.arange(blocks), patched), position] = value
    grid += low[:, None]
    return grid.reshape(-1)[:n]


def _segments(batches, vocabulary: str, end_id: int):
    enc, part = encoder(vocabulary), TaskContext.get().partitionId()
    segment, first = 0, 0
    doc_ids, lengths, bodies, held = [], [], [], 0

    def flush():
        nonlocal segment, first, doc_ids, lengths, bodies, held
        ids = np.concatenate(bodies)
        row = pa.record_batch([
            pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
            pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int64())), pa.array([encode_blocks(ids)], pa.binary())],
            names=["part", "segment", "first_id", "n_ids", "doc_ids", "doc_lengths", "payload"])
        segment, first = segment + 1, first + len(ids)
        doc_ids, lengths, bodies, held = [], [], [], 0
        return row

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names = batch.column(0).to_pylist()
        for i, j in row_chunks(offsets):
            ids, border = enc.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], end_id)
            for d in range(j - i):
                a, b = int(border[d]), int(border[d + 1])
                doc_ids.append(names[i + d])
                lengths.append(b - a)
                bodies.append(ids[a:b])
                held += b - a
                if held >= SEGMENT_IDS:
                    yield flush()
    if bodies:
        yield flush()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each document, and write
    the ids in ascending id order (null ids first, equal ids by text) below
    ``path``. A null text is empty: its ids are the end id alone. An empty
    table writes no segment; further columns are ignored."""
    rows = only(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, _segments, SEGMENTS, vocabulary=vocabulary, end_id=end_id).write.parquet(path)


def _documents(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            ids = decode_blocks(batch.column("payload")[k].as_py())
            names, lengths = batch.column("doc_ids")[k].values, batch.column("doc_lengths")[k].values.to_numpy()
            ends = np.cumsum(lengths)
            start = ends - lengths + batch.column("first_id")[k].as_py() + batch.column("before")[k].as_py()
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.record_batch([names, pa.array(start, pa.int64()), pa.array(lengths, pa.int64()),
                                   pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written files: its id, the ids of all documents
    before it, its number of ids, and the CRC-32 of its ids as little-endian
    unsigned 32-bit integers."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one row per written part, as small as the file list; written first, so that its size
    # is known and the payloads meet it without a shuffle
    before = kept(files.groupBy("part").agg(F.sum("n_ids").alias("n"))
                  .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "before")
    segments = files.join(before, "part").select("doc_ids", "doc_lengths", "first_id", "before", "payload")
    return map_arrow(segments, _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
