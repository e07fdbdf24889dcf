"""Exact n-gram Jaccard self-join by prefixes and a prefix tree.

Every document is its set of distinct word 5-grams (64-bit hashes) in one
global order: frequent n-grams last. Two sets with Jaccard similarity t share
an n-gram among their first n - ceil(t n) + 1, so only these meet in a
shuffle. Candidates are stored in a trie of their ordered n-grams and searched
there (``prefix_tree``): the overlap of a shared path is counted once for all
sets below it, and subtrees that can't reach their overlap are left.

Passes over the text: counts for the order; prefixes; the sets of documents
that share a prefix n-gram. Equal sets are one node throughout.

The order only steers the work: any order gives the same links. The list of
frequent n-grams is bounded (``FREQUENT``) and travels to the tasks; what
isn't on it is ordered by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.arrowtext import SPACES, lower_ascii, row_chunks, shingle_hashes, span_hashes, spans, utf8
from loanbook.llm.components import components
from loanbook.llm.linking import checked, shared_entries, united
from loanbook.llm.tables import kept, map_arrow, only, ship, unused

WIDTH = 5
#: similarity in hundredths
PERCENT = 80
#: longest list of frequent n-grams that the order puts last
FREQUENT = 1 << 18
#: documents that make an n-gram frequent
FREQUENT_FROM = 8
#: n-grams a task counts at a time
COUNTED = 4_000_000
BUCKETS = 1024
#: bits of the filter that keeps the sets of most documents without partner off the shuffle
FILTER_BITS = 1 << 23


def _sets(batch, width: int):
    """(row, sorted distinct hashes) of each document of a batch (columns doc_id, text)."""
    data, offsets = utf8(batch.column(1))
    for i, j in row_chunks(offsets):
        chunk, off = lower_ascii(data[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
        starts, ends, doc = spans(chunk, off, SPACES)
        h, d = shingle_hashes(span_hashes(chunk, starts, ends), doc, j - i, width)
        border = np.searchsorted(d, np.arange(j - i + 1)).tolist()
        for k in range(j - i):
            own = np.sort(h[border[k]:border[k + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield i + k, own


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _counts(batches, width: int, percent: int):
    """Counts of the n-grams in twice the prefix of every set, in buckets by
    the leading bits; equal sets of a task count once."""
    seen, held, size = set(), [], 0

    def out():
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (tokens >> np.uint64(54)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        tail = np.append(head[1:], len(tokens))
        n = np.minimum(n, 0xFFFFFFFF).astype("<u4")
        return pa.record_batch([
            pa.array(bucket[head], pa.int32()),
            pa.array([tokens[a:b].tobytes() for a, b in zip(head, tail, strict=True)], pa.binary()),
            pa.array([b"" if n[a:b].max() == 1 else n[a:b].tobytes() for a, b in zip(head, tail, strict=True)], pa.binary()),
        ], names=["bucket", "tokens", "counts"])

    for batch in batches:
        for _, own in _sets(batch, width):
            if not len(own) or (node := _node(own)) in seen:
                continue
            seen.add(node)
            held.append(own[:2 * prefix_length(len(own), percent)])
            size += len(held[-1])
            if size >= COUNTED:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _frequent(batches, at_least: int):
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, t, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens = np.frombuffer(t, "<u8")
            held.setdefault(bucket, []).append((tokens, np.frombuffer(c, "<u4") if c else np.ones(len(tokens), "<u4")))
    for parts in held.values():
        tokens, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        of = np.flatnonzero(n >= at_least)
        yield pa.record_batch([pa.array(tokens[of].view(np.int64)), pa.array(n[of])], names=["token", "n"])


def frequent_ngrams(rows: DataFrame, width: int, percent: int, at_least: int, most: int) -> np.ndarray:
    """Frequent n-gram hashes in ascending frequency: at most ``most``, those
    of highest count. Bounded, so it may go to the driver and the tasks."""
    counted = map_arrow(rows, _counts, "bucket int, tokens binary, counts binary", width=width, percent=percent)
    counted = counted.repartition("bucket")
    top = (map_arrow(counted, _frequent, "token long, n long", at_least=at_least)
           .orderBy(F.desc("n"), "token").limit(most).toArrow())
    token, n = top["token"].to_numpy(), top["n"].to_numpy()
    return token[np.lexsort((token, n))].astype(np.int64).view(np.uint64)


def order_keys(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Global order of n-grams as ascending 63-bit keys: frequent ones last.
    ``frequent``: their hashes ascending, and their ranks."""
    keys = hashes >> np.uint64(2)
    known, rank = frequent
    if len(known):
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = known[at] == hashes
        keys[hit] = np.uint64(1 << 62) + rank[at[hit]]
        if hit.any():
            keys.sort()
    return keys


def _prefixes(batches, width: int, percent: int, frequent):
    seen, order = set(), frequent.value
    for batch in batches:
        keys, nodes, sizes, places = [], [], [], []
        for _, own in _sets(batch, width):
            if not len(own) or (node := _node(own)) in seen:
                continue
            seen.add(node)
            p = prefix_length(len(own), percent)
            keys.append(order_keys(own, order)[:p])
            nodes.append(node)
            sizes.append(len(own))
            places.append(p)
        if keys:
            yield pa.record_batch([
                pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), places)),
                pa.array(np.repeat(np.array(sizes, np.int32), places)),
                pa.array(np.concatenate([np.arange(p, dtype=np.int32) for p in places]))], names=["key", "node", "n", "pos"])


def _documents(batches, width: int, frequent, needed):
    """doc_id, node, n of every document; the ordered set where it may be needed."""
    seen, order, bits = set(), frequent.value, needed.value
    for batch in batches:
        nodes, sizes, sets = [], [], []
        for _, own in _sets(batch, width):
            node, content = (_node(own), None) if len(own) else (0, None)
            if len(own) and bits[(node % FILTER_BITS) >> 3] >> (node % 8) & 1 and node not in seen:
                seen.add(node)
                content = order_keys(own, order).astype("<u8").tobytes()
            nodes.append(node)
            sizes.append(len(own))
            sets.append(content)
        yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                               pa.array(sets, pa.binary())], names=["doc_id", "node", "n", "keys"])


def _key_sets(contents: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in contents]


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without space and \\x09-\\x0D, with A-Z lower-cased; a set
    holds the distinct n-grams of the whole text, or the whole sequence where
    it has fewer words. Null, empty and blank texts have the empty set and are
    linked with nothing. Equal sets are linked; rows that repeat an id count
    as one document in components. An empty table gives an empty result;
    further columns are ignored. N-grams and sets are told apart by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranked = frequent_ngrams(rows, width, percent, FREQUENT_FROM, FREQUENT)
    by_hash = np.argsort(ranked)
    order = spark.sparkContext.broadcast((ranked[by_hash], by_hash.astype(np.uint64)))
    nx, ny, both = F.col("x.n"), F.col("y.n"), F.col("x.n") + F.col("y.n")
    possible = ((F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent)
                & (F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) * (100 + percent) >= both * percent))
    entries = shared_entries(map_arrow(rows, _prefixes, "key long, node long, n int, pos int",
                                       width=width, percent=percent, frequent=order), possible)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    slot = F.pmod("node", F.lit(FILTER_BITS))
    bytes_ = (entries.select("node").distinct().groupBy(F.floor(slot / 8).alias("i"))
              .agg(F.expr("bit_or(shiftleft(1, int(pmod(node, 8))))").alias("v"))
              .toArrow())  # at most FILTER_BITS / 8 numbers
    bits[bytes_["i"].to_numpy()] = bytes_["v"].to_numpy().astype(np.uint8)
    documents = kept(map_arrow(rows, _documents, "doc_id long, node long, n long, keys binary", width=width,
                               frequent=order, needed=spark.sparkContext.broadcast(bits)), "documents")
    needed = entries.select("node").distinct()
    contents = kept(documents.where("keys is not null").select("node", "keys").dropDuplicates(["node"])
                    .join(needed, "node", "left_semi"), "sets")

    def verify(groups: DataFrame) -> DataFrame:
        return checked(groups, contents, _key_sets, percent)

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    roots = united(entries, verify, size_class, possible)
    classes = documents.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("__first"))
    # rows that repeat an id are one document: their sets are linked
    several = (documents.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id")
               .agg(F.min("node").alias("a"), F.max("node").alias("__hi")).where("a <> __hi").select("doc_id", "a"))
    own = kept(documents.where("n > 0").select("doc_id", F.col("node").alias("b")).join(several, "doc_id").select("a", "b"), "own")
    if not own.isEmpty():
        roots = components(own.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    labelled = kept(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    smallest = labelled.groupBy("root").agg(F.min("__first").alias("component_id"))
    of_node = labelled.join(smallest, "root").select("node", "component_id")
    linked = documents.where("n > 0").select("doc_id", "node", "n").join(of_node, "node")
    alone = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with
    all their columns. Rows that repeat an id stay or go together; rows with a
    null id or without words always stay."""
    name, = unused(docs, "__drop")
    drop = (ngram_components(docs, **options).where("doc_id <> component_id")
            .select(F.col("doc_id").alias(name)).distinct())
    return docs.join(drop, docs["doc_id"].cast("long") == F.col(name), "left_anti")
