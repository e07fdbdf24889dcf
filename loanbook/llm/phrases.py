"""Phrase collocations by top-order marginalisation.

Every word position gives one lead window: the word and the next four, padded
with 0 where the piece ends. Only these longest windows are counted; ``ROLLUP``
over the window columns then sums their prefixes, and the prefix of k words of
all windows is the count of every phrase of k words, so phrases of two, three
and more words are never exploded on their own.

Windows end early where that can't change a result: a phrase that occurs
``least`` times holds only words, pairs and triples that occur so often. Passes
before find these and send them to the tasks as bit sets of a bounded size.
Pairs and triples are counted there by a part of their hash, and a bit set may
let a rare one pass; neither ever stops a frequent one. So they only make
windows longer than they need be, and every count comes from the rollup.

Words are told apart by 64-bit hashes once the frequent ones are known; those
are counted by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import _odd_constants, lower_ascii, mix64, row_chunks, separator_table, span_hashes, spans, utf8
from loanbook.llm.tables import kept, map_arrow, only

#: words of the longest phrase
ORDER = 5
CHUNK = 1 << 22
_ENDS = separator_table([(0x0A, 0x0D), *[(ord(c),) * 2 for c in ".,;:!?"]])
_BREAKS = _ENDS | separator_table([(0x20, 0x20), (0x09, 0x09)])
_MULTIPLY = _odd_constants(909, ORDER + 2)
#: bits for each member of a filter, and the most bits of one (16 MB)
BITS_EACH, MOST_BITS = 16, 1 << 27
#: windows are trimmed at rare grams of up to so many words
TRIMMED = 3
#: grams counted at a time in a task, and about the bytes of text for a bucket of grams
COUNTED, BUCKET_BYTES = 1 << 22, 1 << 23


def _words(batches):
    """(language numbers, their names, word hashes, whether the next word
    belongs to the same piece, bytes, starts, ends) of the words of each chunk."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names, number = np.unique(np.array(["und" if x is None else x for x in batch.column(0).to_pylist()], object), return_inverse=True)
        for i, j in row_chunks(offsets, CHUNK):
            chunk, off = lower_ascii(data[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
            starts, ends, doc = spans(chunk, off, _BREAKS)
            if not len(starts):
                continue
            h = span_hashes(chunk, starts, ends)
            h[h == 0] = 1  # 0 is the padding
            piece = np.cumsum(_ENDS[chunk])[starts]
            joined = np.append((doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False)
            yield number[i:j][doc], names.tolist(), h, joined, chunk, starts, ends


def _language_keys(names: list[str]) -> np.ndarray:
    raw = [n.encode("utf-8", "surrogatepass") for n in names]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts = ends - [len(r) + 1 for r in raw]
    return np.array([span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)], np.uint64)


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        out = mix64(out + c * _MULTIPLY[k % len(_MULTIPLY)])
    return out


def _word_counts(batches):
    for language, names, h, _, chunk, starts, ends in _words(batches):
        _, first, n = np.unique(_combined([language.astype(np.uint64) + np.uint64(1), h]), return_index=True, return_counts=True)
        text = [chunk[starts[k]:ends[k]].tobytes() for k in first.tolist()]
        yield pa.record_batch([_named(language[first], names), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                              names=["lang", "word", "c"])


def _named(language: np.ndarray, names: list[str]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(language, pa.int32()), pa.array(names, pa.string())).cast(pa.string())


def _hashed(batches):
    """Hash and filter key of words (lang, word)."""
    for batch in batches:
        names, number = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        raw = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        if not raw:
            continue
        border = np.cumsum([0, *[len(r) for r in raw]])
        h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), border[:-1], border[1:])
        h[h == 0] = 1
        key = _combined([_language_keys(names.tolist())[number], h])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(h.view(np.int64)), pa.array(key.view(np.int64))],
                              names=["lang", "word", "h", "key"])


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mix64(keys) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:max(0, len(x) - k)] = x[k:]
    return out


def _gram_keys(lang_key: np.ndarray, h: np.ndarray, at: np.ndarray, size: int, shift: int) -> np.ndarray:
    """The leading 64 - ``shift`` bits of the hashes of the grams at ``at``."""
    return _combined([lang_key[at], *[h[at + k] for k in range(size)]]) >> np.uint64(shift)


def _often(lang_key: np.ndarray, h: np.ndarray, joined: np.ndarray, filters) -> list[np.ndarray]:
    """For 1, 2, ... words: whether the gram that begins at each word may be frequent."""
    out = [_passes(filters[0][0].value, _combined([lang_key, h]))]
    for size, (bits, shift) in enumerate(filters[1:], 2):
        ok = out[-1] & _ahead(out[-1], 1) & joined
        at = np.flatnonzero(ok)
        ok[at] = _passes(bits.value, _gram_keys(lang_key, h, at, size, shift))
        out.append(ok)
    return out


def _gram_counts(batches, filters, shift):
    """Counts of the grams of one word more than the filters know, by the
    leading bits of their hash: per bucket the sorted low 32 bits, and the counts."""
    size, held, amount = len(filters) + 1, [], 0

    def out():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        low, n = keys.astype("<u4"), np.minimum(n, 0xFFFFFFFF).astype("<u4")
        cuts = list(zip(head, np.append(head[1:], len(keys)), strict=True))
        return pa.record_batch([pa.array(bucket[head]), pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
                                pa.array([n[a:b].astype("u1").tobytes() if n[a:b].max() < 256 else n[a:b].tobytes() for a, b in cuts], pa.binary())],
                               names=["bucket", "keys", "counts"])

    for language, names, h, joined, *_ in _words(batches):
        lang_key = _language_keys(names)[language]
        ok = _often(lang_key, h, joined, filters)[-1]
        at = np.flatnonzero(ok & _ahead(ok, 1) & joined)
        held.append(_gram_keys(lang_key, h, at, size, shift))
        amount += len(at)
        if amount >= COUNTED:
            yield out()
            held, amount = [], 0
    if amount:
        yield out()


def _frequent(batches, least):
    """Keys of the buckets, which stand together, with their number at least ``least``."""
    bucket, held = None, []

    def out():
        keys, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([c for _, c in held]))
        keys = keys[n >= least].astype(np.int64) + (bucket << 32)
        return pa.record_batch([pa.array(keys)], names=["key"])

    for batch in batches:
        for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != bucket and held:
                yield out()
                held = []
            keys, bucket = np.frombuffer(k, "<u4"), b
            held.append((keys, np.frombuffer(c, "u1" if len(c) == len(keys) else "<u4")))
    if held:
        yield out()


def _window_counts(batches, filters):
    labels = [f"w{k + 1}" for k in range(ORDER)]
    for language, names, h, joined, *_ in _words(batches):
        often = _often(_language_keys(names)[language], h, joined, filters)
        open_, columns = often[0], []
        for k in range(ORDER):  # the lead by k words, where all grams on the way may be frequent
            if k:
                known = min(k + 1, len(often))
                open_ = open_ & _ahead(often[known - 1], k + 1 - known)
            columns.append(np.where(open_, _ahead(h, k), np.uint64(0)))
        _, first, n = np.unique(_combined([language.astype(np.uint64) + np.uint64(1), *columns]), return_index=True, return_counts=True)
        yield pa.record_batch([_named(language[first], names), *[pa.array(c[first].view(np.int64)) for c in columns], pa.array(n, pa.int64())],
                              names=["lang", *labels, "c"])


def _marks(batches, bits):
    for batch in batches:
        at = mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
        yield pa.record_batch([pa.array(at.view(np.int64))], names=["at"])


def _filter(keys: DataFrame):
    """Broadcast bit set of the keys: at most ``MOST_BITS`` bits, whatever their number."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * keys.count()):
        bits *= 2
    at = map_arrow(keys.select("key"), _marks, "at long", bits=bits)
    words = (at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("v"))
             .toArrow())  # at most MOST_BITS / 64 numbers
    out = np.zeros(bits // 64, np.int64)
    out[words["i"].to_numpy()] = words["v"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (lang, gram: hashes of 1 to 5 words, f), totals (lang, n),
    words (lang, h, word)) of all phrases that occur ``least`` times."""
    rows = only(docs, "lang", "text")
    counted = map_arrow(rows, _word_counts, "lang string, word string, c long")
    words = counted.groupBy("lang", "word").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("lang", "word")
    words = kept(map_arrow(words, _hashed, "lang string, word string, h long, key long"), "words")
    # as many buckets as keep each small: the tasks' share of keys stays the same at every size
    spread = max(4, ((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES).bit_length())
    filters = [(_filter(words), 0)]
    for _ in range(TRIMMED - 1):
        grams = map_arrow(rows, _gram_counts, "bucket long, keys binary, counts binary", filters=filters, shift=32 - spread)
        grams = grams.repartition("bucket").sortWithinPartitions("bucket")
        filters = [*filters, (_filter(kept(map_arrow(grams, _frequent, "key long", least=least), "grams")), 32 - spread)]
    columns = [f"w{k + 1}" for k in range(ORDER)]
    windows = map_arrow(rows, _window_counts, "lang string, " + ", ".join(f"{c} long" for c in columns) + ", c long", filters=filters)
    # one row per longest window, then per prefix; the level is its number of words
    windows = windows.groupBy("lang", *columns).agg(F.sum("c").alias("c"))
    rolled = (windows.rollup("lang", *columns).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
              .withColumn("k", F.lit(ORDER) - F.bit_count("g").cast("int")).where((F.col("k") == 0) & F.col("lang").isNotNull()
                                                                                 | (F.col("k") > 0) & (F.col("f") >= least)))
    rolled = kept(rolled.select("lang", "k", F.slice(F.array(*columns), F.lit(1), F.greatest("k", F.lit(0))).alias("gram"), "f"), "rolled")
    phrases = rolled.where((F.col("k") > 0) & (F.element_at("gram", F.greatest("k", F.lit(1))) != 0)).select("lang", "gram", "f")
    totals = rolled.where("k = 0").select("lang", F.col("f").alias("n"))
    return phrases, totals, words.select("lang", "h", "word")


#: floor(1000 a n / (l r)) in whole decimals; exact while 1000 a n stays below 38 digits
SCORE = """(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0)))
           div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"""


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; further columns don't matter. A null language
    is ``und``; a null or empty text has no words and counts for nothing; rows
    that repeat a text count each. Of equal scores the more frequent phrase
    comes first, then the smaller by its UTF-8 bytes. An empty table, and a
    language without a candidate, give no row.
    """
    phrases, totals, words = frequent_phrases(docs, least)
    many = F.size("gram")
    # a phrase goes if one of one word more, that holds it, is as frequent; so do, through the steps between, those of longer ones
    longer = phrases.where(many > 2)
    inner = (longer.select("lang", F.explode(F.array(F.slice("gram", F.lit(1), many - 1), F.slice("gram", F.lit(2), many - 1))).alias("gram"),
                           F.col("f").alias("held")).groupBy("lang", "gram").agg(F.max("held").alias("held")))
    own = (phrases.where(many > 1).join(inner, ["lang", "gram"], "left").where("held IS NULL OR 100 * held < 100 * f")
           .select("lang", "gram", F.col("f").alias("a")))
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), many - 1)))
    cuts = cuts.select("*", F.slice("gram", F.lit(1), F.col("cut")).alias("first"),
                       F.slice("gram", F.col("cut") + 1, many - F.col("cut")).alias("rest"))
    first = phrases.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    scored = (cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
              .withColumn("score", F.expr(SCORE)))
    best = (scored.groupBy("lang", "gram").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
            .select("lang", "gram", "x.score", "x.a", "x.l", "x.r", "x.n"))
    # texts: each word of a phrase by its hash
    named = (best.select("lang", "gram", "score", "a", "l", "r", "n", F.posexplode("gram").alias("at", "h")).join(words, ["lang", "h"])
             .groupBy("lang", "gram", "score", "a", "l", "r", "n")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (named.withColumn("rank", place.cast("int")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
