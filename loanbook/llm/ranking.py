"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to ``OWNERS`` by weight: rare terms to the
first, the most common to the last. Each owner holds the posting lists of its
terms, cut by document segment, so that the list of a common term is many
short ones. A bundle of items carries sparse accumulators (document, score so
far) for each segment through the owners in turn; at each stage a ``cogroup``
on (bundle, segment) brings the accumulators to the posting lists, and integer
contributions are added. After a stage, a document leaves an item's
accumulators only if its score and all that the later owners could still add
stay below the item's tenth best score so far, which every final tenth best
score reaches. So the result is exact, and the many documents that share only
common words with an item are never carried between the stages.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import lower_ascii, row_chunks, separator_table, span_hashes, spans, utf8
from loanbook.llm.tables import kept, map_arrow, only, ship

#: the separators of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``
_BREAKS = separator_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: terms of at least such a weight belong to the first owner, the second ...; the last takes the rest
OWNERS = (5000, 2500, 0)
#: about so many items in a bundle
BUNDLE = 128
#: most documents, and about the most bytes, of a segment
SEGMENT, SEGMENT_BYTES = 4096, 1 << 23
#: a term's impact (1e9 tf) div (1000 tf + 8 m) is below this, for m > 0
MOST_IMPACT = 1_000_000
#: bits for each term in the filter of the documents' terms, and the most bits of it (4 MB)
BITS_EACH, MOST_BITS = 32, 1 << 25


def _terms(data: np.ndarray, off: np.ndarray):
    """(term hashes, document of each, terms of each document)."""
    chunk = lower_ascii(data[off[0]:off[-1]])
    starts, ends, doc = spans(chunk, off - off[0], _BREAKS)
    return span_hashes(chunk, starts, ends).view(np.int64), doc, np.bincount(doc, minlength=len(off) - 1)


def _item_terms(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        h, doc, _ = _terms(data, offsets)
        yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(h)], names=["item_id", "term"])


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _lists(flat: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(flat))


def _postings(batches, bits):
    """For each segment of documents one row without a term (ids and term
    counts, in order of id) and one row a term (documents' places and counts)."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids = batch.column(0)
        for i, j in row_chunks(offsets, SEGMENT_BYTES):
            for a in range(i, j, SEGMENT):
                b = min(j, a + SEGMENT)
                h, doc, many = _terms(data, offsets[a:b + 1])
                order = np.asarray(pa.compute.sort_indices(ids.slice(a, b - a), null_placement="at_end"))
                place = np.empty(b - a, np.int64)
                place[order] = np.arange(b - a)
                many = many[order]
                asked = _passes(bits.value, h)
                h, at = h[asked], place[doc[asked]]
                by = np.lexsort((at, h))
                h, at = h[by], at[by]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(h)))
                h, at = h[new], at[new]
                term = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                border = np.append(np.append(0, term), len(h))  # the first row has no list
                segment = (task << 32) | number
                number += 1
                yield pa.record_batch([
                    pa.array(np.full(len(term) + 1, segment)), pa.array(np.append(0, h[term]), pa.int64(), mask=np.append(True, np.zeros(len(term), bool))),
                    _lists(np.append(many, at).astype(np.int32), np.append(0, border[1:] + len(many))),
                    _lists(np.append(many, tf).astype(np.int32), np.append(0, border[1:] + len(many))),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(term) + 1, b - a)), pa.int32()),
                                             ids.slice(a, b - a).take(pa.array(order)).cast(pa.int64())),
                    _lists(np.append(many, many[at]).astype(np.int32), np.append(0, border[1:] + len(many))),
                    pa.array(np.full(len(term) + 1, b - a), pa.int32())],
                    names=["segment", "term", "docs", "tfs", "ids", "lengths", "size"])


def _filter(terms: DataFrame):
    """Broadcast bit set of the items' terms: of a bounded size, whatever their number."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * terms.count()):
        bits *= 2
    words = (terms.select(F.expr(f"term & {bits - 1}L").alias("at")).groupBy(F.shiftright("at", 6).alias("i"))
             .agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("v")).toArrow())  # at most MOST_BITS / 64 numbers
    out = np.zeros(bits // 64, np.int64)
    out[words["i"].to_numpy()] = words["v"].to_numpy()
    return terms.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _stage(documents: int, terms: int, top: int, last: bool):
    """The task function of one owner: accumulators and posting lists of one
    bundle and segment to the accumulators that can still reach the top."""

    def add(carried: pa.Table, lists: pa.Table) -> pa.Table:
        held = carried.select(["slot", "size"]).to_pylist()
        own = lists.select(["size", "users"]).to_pylist()
        if not held and not own:
            return None
        key = (carried if held else lists).select(["bundle", "segment"]).slice(0, 1).to_pylist()[0]
        size = (held or own)[0]["size"]
        slots = sorted({r["slot"] for r in held} | {u["slot"] for r in own for u in r["users"]})
        row = {s: k for k, s in enumerate(slots)}
        score = np.zeros((len(slots), size), np.int64)
        rest, least = np.full(len(slots), -1, np.int64), np.zeros(len(slots), np.int64)
        columns = [carried.column(c).combine_chunks() for c in ("docs", "scores")]
        for k, r in enumerate(held):
            at, found = (c[k].values.to_numpy() for c in columns)
            score[row[r["slot"]], at] = found
        columns = [lists.column(c).combine_chunks() for c in ("docs", "tfs", "lengths")]
        for k, r in enumerate(own):
            at, tf, many = (c[k].values.to_numpy().astype(np.int64) for c in columns)
            m = 25 + (75 * many * documents) // terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            for u in r["users"]:
                s = row[u["slot"]]
                score[s, at] += u["weight"] * impact
                rest[s], least[s] = u["rest"], u["least"]
        out_slot, out_docs, out_scores = [], [], []
        for s, slot in enumerate(slots):
            at = np.flatnonzero(score[s])
            found = score[s, at]
            if len(at) > top and (last or rest[s] >= 0):
                tenth = max(int(np.partition(found, len(found) - top)[len(found) - top]), int(least[s]))
                stays = found + (0 if last else rest[s]) >= tenth
                at, found = at[stays], found[stays]
            elif rest[s] >= 0:
                stays = found + (0 if last else rest[s]) >= least[s]
                at, found = at[stays], found[stays]
            if last and len(at) > top:
                best = np.lexsort((at, -found))[:top]
                at, found = at[best], found[best]
            if len(at):
                out_slot.append(slot)
                out_docs.append(at)
                out_scores.append(found)
        border = np.cumsum([0, *map(len, out_docs)])
        n = len(out_slot)
        return pa.table([pa.array([key["bundle"]] * n, pa.int32()), pa.array([key["segment"]] * n, pa.int64()), pa.array(out_slot, pa.int32()),
                         pa.array([size] * n, pa.int32()),
                         _lists(np.concatenate(out_docs).astype(np.int32) if n else np.zeros(0, np.int32), border),
                         _lists(np.concatenate(out_scores) if n else np.zeros(0, np.int64), border)],
                        names=["bundle", "segment", "slot", "size", "docs", "scores"])

    return add


_CARRIED = "bundle int, segment long, slot int, size int, docs array<int>, scores array<long>"


def rank(items: DataFrame, docs: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score.

    ``items`` has item_id and text, ``docs`` doc_id and text; further columns
    don't matter. A null or empty text has no terms: such a document is not
    counted and never found, such an item has no row. Rows that repeat an
    item_id are one item with the terms of all its rows; rows of ``docs`` that
    repeat an id are documents of their own, and so are those without an id,
    which come last among equal scores. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = map_arrow(only(items, "item_id", "text").select(F.col("item_id").cast("long"), "text"), _item_terms, "item_id long, term long")
    asked = kept(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    terms = asked.select("term").distinct()
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    lists = kept(map_arrow(rows, _postings, "segment long, term long, docs array<int>, tfs array<int>, ids array<long>, lengths array<int>, size int",
                           bits=_filter(terms)), "postings")
    segments = lists.where("term IS NULL").select("segment", "ids", F.col("docs").alias("many"))
    total = segments.select(F.expr("aggregate(many, 0L, (s, x) -> s + if(x > 0, 1, 0))").alias("n"),
                            F.expr("aggregate(many, 0L, (s, x) -> s + x)").alias("l")).agg(F.sum("n"), F.sum("l")).first()
    documents, length = total[0] or 0, max(1, total[1] or 0)
    # weights, owners, and what the owners after a term's can add to an item at most
    df = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(OWNERS) - 1)
    for k in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("w") >= OWNERS[k], k).otherwise(owner)
    n_bundles = max(1, -(-asked.select("item_id").distinct().count() // BUNDLE))
    weighed = (asked.join(df, "term").withColumn("w", weight).where("w > 0").withColumn("owner", owner)
               .withColumn("weight", F.col("w") * F.col("times")).withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int")))
    slot = F.dense_rank().over(Window.partitionBy("bundle").orderBy(F.col("item_id").asc_nulls_first()))
    later = F.sum(F.col("weight") * MOST_IMPACT).over(Window.partitionBy("bundle", "item_id").orderBy("owner"))
    all_ = F.sum(F.col("weight") * MOST_IMPACT).over(Window.partitionBy("bundle", "item_id"))
    plan = kept(weighed.withColumn("slot", slot).withColumn("rest", all_ - later)
                .select("bundle", "slot", "item_id", "term", "owner", "weight", "rest"), "plan")
    carried = spark.createDataFrame([], _CARRIED)
    least = spark.createDataFrame([], "bundle int, slot int, least long")
    order = Window.partitionBy("bundle", "slot")
    for k in range(len(OWNERS)):
        last = k == len(OWNERS) - 1
        user = F.struct("slot", "weight", "rest", F.coalesce("least", F.lit(0)).alias("least"))
        users = (plan.where(F.col("owner") == k).join(least, ["bundle", "slot"], "left").groupBy("term", "bundle")
                 .agg(F.collect_list(user).alias("users")))  # at most the items of a bundle
        own = (lists.join(users, "term").select("bundle", "segment", "size", "docs", "tfs", "lengths", "users"))
        carried = kept(carried.groupBy("bundle", "segment").cogroup(own.groupBy("bundle", "segment"))
                       .applyInArrow(_stage(documents, length, top, last), _CARRIED), "carried")
        if not last:
            best = carried.select("bundle", "slot", F.explode(F.slice(F.sort_array("scores", asc=False), 1, top)).alias("score"))
            best = best.withColumn("at", F.row_number().over(order.orderBy(F.desc("score")))).where(F.col("at") <= top)
            least = kept(best.where(F.col("at") == top).select("bundle", "slot", F.col("score").alias("least")), "least")
    found = carried.select("bundle", "segment", "slot", F.explode(F.arrays_zip("docs", "scores")).alias("x"))
    found = found.select("bundle", "segment", "slot", F.col("x.docs").alias("at"), F.col("x.scores").alias("score"))
    found = (found.join(segments.select("segment", "ids"), "segment")
             .select("bundle", "slot", F.col("ids")[F.col("at")].alias("doc_id"), "score"))
    found = (found.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())).cast("int"))
             .where(F.col("rank") <= top))
    return found.join(plan.select("bundle", "slot", "item_id").distinct(), ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
