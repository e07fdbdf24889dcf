"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target share of all words. A source that needs r words
per word it has takes each document floor(r) times, and once more with
probability r - floor(r). Which documents are taken once more is drawn by the
cube method: the vector of probabilities moves along directions of the null
space of the balancing constraints (number of documents, number of words)
until every coordinate but a few is 0 or 1; only those few are landed by
choosing the outcome nearest to the word total (a dozen units of a source are
kept for that).

The flight works on blocks of a source of bounded size. What is undecided in
a block (at most two documents) meets what is undecided in the others at the
next level, until each source has one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import SPACES, row_chunks, spans, utf8
from loanbook.llm.tables import kept, map_arrow, only, ship, unused
from loanbook.operators.sampling import dense_index

#: most rows of a flight's block
BLOCK_ROWS = 8192
#: units that are left to the landing, beside the two that the flight leaves
LANDING_UNITS = 12
#: no document is taken more often
MAX_COPIES = 3
#: weights of the sources in code-point order, repeating
WEIGHTS = (1, 2, 3)
_EPS = 1e-9


def _sizes(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        size = np.zeros(batch.num_rows, np.int64)
        for i, j in row_chunks(offsets):
            _, _, doc = spans(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], SPACES)
            size[i:j] = np.bincount(doc, minlength=j - i)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size)], names=["doc_id", "source", "size"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the words of each whole text (null: 0)."""
    rows = only(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return map_arrow(rows, _sizes, "doc_id long, source string, size long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last,
    weigh ``weights`` in turn and share the whole size; a target stops at
    ``most`` times its source's size, and the excess goes to the others by
    weight until none is above."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_index(sums.withColumn("__last", F.col("source").isNull()), ["__last", "source"], "__rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    s = kept(ranked.select("source", "source_size", w.alias("weight")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(most) * F.col("source_size")
    level, full = None, -1
    while True:  # one aggregate of a few numbers each round; ends when no further source is full
        is_full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(is_full, cap).otherwise(0)).alias("c"),
                  F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("w"),
                  F.count(F.when(is_full, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - r["c"]) / r["w"]
    level = 0.0 if level is None else level
    return s.select("source", "source_size",
                    F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def flight(size: np.ndarray, weight: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: probabilities moved to 0 or 1 but for at most two.

    Balances the sums of ``weight`` (documents of a unit) and of ``size``
    (words of a unit). Three undecided units at a time, large ones first:
    their null-space direction is the cross product of the two constraint
    rows; the end of the segment is drawn so that expectations stay."""
    p = p.copy()
    active: list[int] = []
    for k in np.lexsort((draw, -size)).tolist():
        if p[k] <= _EPS or p[k] >= 1 - _EPS:
            p[k] = round(p[k])
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (weight[b] * size[c] - weight[c] * size[b], weight[c] * size[a] - weight[a] * size[c],
             weight[a] * size[b] - weight[b] * size[a])
        if u == (0, 0, 0):  # the constraints are parallel here: move two against each other
            u = (weight[b], -weight[a], 0) if weight[a] or weight[b] else (1, 0, 0)
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(active, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(active, u, strict=True) if x)
        step = up if draw[k] * (up + down) < down else -down
        still = []
        for i, x in zip(active, u, strict=True):
            p[i] += step * x
            if p[i] <= _EPS or p[i] >= 1 - _EPS:
                p[i] = round(p[i])
            else:
                still.append(i)
        active = still
    return p


def land(size: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The outcome of the undecided units whose words come nearest to the
    expectation (ties: nearest number of documents, then the smaller units)."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        outcome = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        miss = outcome - p[open_]
        words, rows = np.abs(miss @ size[open_]), np.abs(miss @ weight[open_])
        p[open_] = outcome[np.lexsort((np.arange(len(outcome)), rows, np.round(words, 6)))[0]]
    return p


def _uniform(draw: np.ndarray) -> np.ndarray:
    return (draw.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _fly(group: pa.Table) -> pa.Table:
    """Flight of one block; of a source's only block, the landing too."""
    last = group["__last"][0].as_py()
    group = group.take(pc.sort_indices(group, [("draw", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]))  # as shuffled before
    rows = group["rows"].to_numpy().astype(object)
    words = group["size"].to_numpy().astype(object) * rows  # exact integers
    words_f, rows_f = words.astype(np.float64), rows.astype(np.float64)
    p, draw = group["p"].to_numpy().copy(), _uniform(group["draw"].to_numpy())
    fly = np.ones(len(p), dtype=bool)
    if last:  # a few small units wait for the landing, so that their words can meet the total
        undecided = np.flatnonzero((p > _EPS) & (p < 1 - _EPS) & (words_f > 0))
        fly[undecided[np.lexsort((draw[undecided], words_f[undecided]))[:LANDING_UNITS]]] = False
    p[fly] = flight(words_f[fly], rows_f[fly], p[fly], draw[fly])
    if last:
        p = land(words_f, rows_f, p)
    return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 17,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row.

    ``taken`` is ``copies * size``; copies are at most ``most``. The draw
    depends on ids, sizes, sources and the seed alone, so reruns agree. Null
    texts have size 0; a null source is a source of its own, the last. Rows
    with one id, source and size form one unit that is taken as a whole, so
    repeated rows get equal copies. Sources without words take nothing. An
    empty table gives an empty result; further columns are ignored.
    """
    ship(docs.sparkSession)
    sized = kept(word_sizes(docs), "sizes")
    targets = source_targets(sized, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
             .join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
             .withColumn("__r", F.least(ratio, F.lit(float(most))))
             .withColumn("base", F.floor("__r").cast("int"))
             .withColumn("p", F.col("__r") - F.col("base"))
             .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size", "source"))
             .drop("__s", "__r"))
    done, level = [], 0
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
        blocks = counts.select(F.col("source").alias("__s"), F.ceil(F.col("__n") / block_rows).alias("__blocks"))
        block = F.pmod(F.xxhash64(F.lit(seed + 1 + level), "draw"), F.col("__blocks"))
        moved = (units.join(blocks, F.col("source").eqNullSafe(F.col("__s")))
                 .withColumn("__block", block).withColumn("__last", F.col("__blocks") <= 1).drop("__s", "__blocks"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema)
        # a source of one block lands now, whatever the other sources still have to do
        flown = kept(moved.groupBy("source", "__block").applyInArrow(_fly, schema).drop("__block"), "flight")
        open_ = ~F.col("__last") & (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~open_).drop("__last"))
        units, level = flown.where(open_).drop("__last"), level + 1
        if units.isEmpty():
            break
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    copies = (F.col("base") + F.col("p").cast("int")).alias("copies")
    return (result.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select("doc_id", "size", "source", "source_size", "target", copies,
                    ((F.col("base") + F.col("p").cast("int")) * F.col("size")).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the
    columns of ``docs``."""
    chosen = (mix(docs, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("__copies"))
              .withColumnsRenamed({"doc_id": "__id", "source": "__source", "size": "__size"}))
    columns = docs.columns
    words, copy, id_, source, size_, copies = unused(docs, "__words", "__copy", "__id", "__source", "__size", "__copies")
    chosen = chosen.withColumnsRenamed({"__id": id_, "__source": source, "__size": size_, "__copies": copies})
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.withColumn(words, size)
    met = (F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source))
           & (F.col(words) == F.col(size_)))
    return (rows.join(chosen, met).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
            .select(*[F.col(f"`{c}`") for c in columns]))
