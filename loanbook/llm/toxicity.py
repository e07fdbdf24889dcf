"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier (numpy) learns from confirmed toxic documents and
unlabelled text. Its risk estimate corrects the unlabelled part by the class
prior: R = prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]), l the
logistic loss; where the second part goes below zero by more than its own
error (prior / sqrt(positives)), its gradient is climbed instead. The prior is the toxic share of all labels outside the held-out fold.

Features: the distinct words of a text (letters and digits, A-Z lower-cased)
and their first 4, 5 and 6 bytes, as hashes. Training reads a bounded sample
(``POSITIVES`` and ``UNLABELLED`` documents, by hash order of their ids); every
whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import PUNCTUATED, lower_ascii, row_chunks, span_hashes, spans, utf8
from loanbook.llm.tables import map_arrow, only

#: most confirmed toxic and most unlabelled documents that training reads
POSITIVES, UNLABELLED = 3000, 9000
#: features the classifier may use, and in how many toxic documents each must occur
FEATURES, LEAST_DOCS = 2048, 3
#: least G statistic of a feature
LEAST_EVIDENCE = 24.0
STEMS = (4, 5, 6)
FOLDS = 5
STEPS, RATE, SHRINK = 400, 0.1, 1e-3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _features(batch, column: int):
    """(first row, rows, document, feature) of each chunk; features repeat."""
    data, offsets = utf8(batch.column(column))
    for i, j in row_chunks(offsets):
        chunk, off = lower_ascii(data[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
        starts, ends, doc = spans(chunk, off, PUNCTUATED)
        found, of = [span_hashes(chunk, starts, ends) >> np.uint64(32)], [doc]
        for width in STEMS:
            longer = ends - starts > width
            s = starts[longer]
            found.append(span_hashes(chunk, s, s + width) >> np.uint64(32) ^ np.uint64(width))
            of.append(doc[longer])
        yield i, j - i, np.concatenate(of), np.concatenate(found).astype(np.uint32)


def _sampled(batches):
    for batch in batches:
        ids, positive = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, n, doc, feature in _features(batch, 2):
            both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | feature)
            border = np.searchsorted(both, np.arange(n + 1).astype(np.uint64) << np.uint64(32)).tolist()
            low = both.astype(np.uint32)
            yield pa.record_batch([
                pa.array(ids[first:first + n], pa.int64()), pa.array(positive[first:first + n], pa.bool_()),
                pa.array([low[a:b].tobytes() for a, b in zip(border[:-1], border[1:], strict=True)], pa.binary())],
                names=["doc_id", "positive", "features"])


def _evidence(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """G statistic of a word's documents in two samples."""
    out, share = np.zeros(len(a)), (a + b) / (n_a + n_b)
    for part, n in ((a, n_a), (b, n_b)):
        for have, p in ((part, share), (n - part, 1 - share)):
            out += 2 * have * np.log(np.maximum(have, 1e-9) / np.maximum(n * p, 1e-9))
    return out


def train(positive: np.ndarray, rows: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes ascending, weights, bias) of the nnPU classifier."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not 0 < prior < 1:
        return np.zeros(0, np.uint32), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))) if prior < 0.5 else -1.0
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, at = np.unique(np.concatenate(rows), return_inverse=True)
    in_p = np.bincount(at, weights=positive[doc], minlength=len(names))
    in_u = np.bincount(at, minlength=len(names)) - in_p
    gain = _evidence(in_p, n_p, in_u, n_u)
    chosen = np.flatnonzero((in_p >= LEAST_DOCS) & (gain >= LEAST_EVIDENCE) & (in_p * n_u > in_u * n_p))
    chosen = np.sort(chosen[np.lexsort((names[chosen], -gain[chosen]))[:FEATURES]])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[at] >= 0
    d, x = doc[use], place[at][use]
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    slack = prior / np.sqrt(n_p)  # the estimate's own error
    for step in range(1, STEPS + 1):
        f = b + np.bincount(d, weights=w[x], minlength=len(rows))
        s = 1 / (1 + np.exp(-f))  # l(f)' = s - 1 and l(-f)' = s
        risk_u = np.logaddexp(0, f[~positive]).mean() - prior * np.logaddexp(0, f[positive]).mean()
        negative = np.where(positive, -prior * s / n_p, s / n_u)
        g = np.where(positive, prior * (s - 1) / n_p, 0.0) + negative if risk_u >= -slack else -negative
        grad = np.append(np.bincount(x, weights=g[d], minlength=len(w)) + SHRINK * w / len(rows), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return names[chosen], w, float(b)


def _train(batches, prior: float):
    ids, positive, rows = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        positive += batch.column(1).to_pylist()
        rows += [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, rows[k].tobytes()))
    names, w, b = train(np.array([positive[k] for k in order], bool), [rows[k] for k in order], prior)
    yield pa.record_batch([pa.array(np.append(names.astype(np.int64), -1)), pa.array(np.append(w, b))], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier. Labels of the held-out fold are never read; documents of
    that fold aren't in the sample either. Without toxic labels it rejects
    nothing. Null labels and labels without a document are ignored."""
    known = (only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic")))
    seen = known.agg(F.avg(F.col("__toxic").cast("double")).alias("share")).first()
    prior = seen["share"] or 0.0
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = rows.select(F.col("doc_id").alias("__id")).distinct().join(known.where("__toxic = 1"), "__id", "left")
    positive = F.col("__toxic").isNotNull()
    drawn = [F.xxhash64("__id"), F.col("__id")]
    p = ids.where(positive).orderBy(*drawn).limit(POSITIVES).select("__id", F.lit(True).alias("__p"))
    u = ids.withColumn("__p", F.lit(False)).orderBy(*drawn).limit(UNLABELLED).select("__id", "__p")
    sample = p.union(u)  # at most POSITIVES + UNLABELLED ids: small enough to broadcast
    # one row an id (the smallest text), however often it stands: so the fit's rows are bounded too
    chosen = (rows.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "__p").agg(F.min("text").alias("text"))
              .select("doc_id", "__p", "text"))
    features = map_arrow(chosen, _sampled, "doc_id long, positive boolean, features binary").repartition(1)
    model = map_arrow(features, _train, "feature long, weight double", prior=float(prior)).toArrow()
    name, weight = model["feature"].to_numpy(), model["weight"].to_numpy()
    bias = float(weight[name < 0][0]) if (name < 0).any() else -1.0
    return name[name >= 0].astype(np.uint32), weight[name >= 0], bias


def _scored(batches, model):
    names, weights, bias = model.value
    for batch in batches:
        logit = np.full(batch.num_rows, bias)
        for first, n, doc, feature in _features(batch, 1):
            if not len(names):
                break
            at = np.searchsorted(names, feature)
            at[at == len(names)] = 0
            hit = names[at] == feature
            both = np.unique(doc[hit] * len(names) + at[hit])
            logit[first:first + n] += np.bincount(both // len(names), weights=weights[both % len(names)], minlength=n)
        yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. A null or empty
    text has no feature and gets the score of the bias; repeated rows get
    equal scores; an empty table gives an empty result; further columns are
    ignored (labels, language and source are never read)."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return (map_arrow(rows, _scored, "doc_id long, score double", model=sent)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns.
    The score is attached to the row itself, so repeated ids don't matter."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kinds = docs.schema
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            two = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            scores = np.concatenate([b.column(1).to_numpy() for b in _scored([two], sent)])
            yield batch.filter(pa.array(scores < 0.5))

    return map_arrow(docs, keep, kinds)
