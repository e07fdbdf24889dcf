"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Distinct vectors are dealt to shards by hash, as many shards as keep each
within a fixed size. A task builds a shard's hierarchical navigable small-world
graph as flat arrays (per level the sorted members, and a table of neighbour
numbers with a fixed number of columns, -1 where there are fewer) and at once
searches it for every query. The queries come as broadcast pieces of bounded
size, one in memory at a time, so that no vector moves more than once. Of each
task's finds only the best of a query are shuffled. Equal vectors are one graph
node that carries its smallest ids, so groups of copies neither crowd the graph
nor hide its other nodes.

The graph is searched by cosine in single precision; scores that are returned
are computed from the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanbook.llm.tables import kept, map_arrow, only, ship

#: neighbours of a node on the upper levels (twice as many on the lowest), and candidates while building and searching
NEIGHBOURS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 96
#: vectors and numbers that a shard holds at most, but for the spread of the hash
SHARD_VECTORS, SHARD_NUMBERS = 20_000, 1 << 23
#: numbers in the queries that a search task holds at a time
QUERY_NUMBERS = 1 << 20


class Graph:
    """HNSW over the rows of ``x`` (unit vectors); similarity is the dot product."""

    def __init__(self, x: np.ndarray, seed: int, m: int = NEIGHBOURS, beam: int = BUILD_BEAM):
        self.x, self.m = x, m
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(m)).astype(np.int64), 12)
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n if k == 0 else int((self.level >= k).sum()), (2 * m if k == 0 else m)), -1, np.int32)
                      for k in range(top + 1)]
        self.row = [np.arange(n)] + [np.cumsum(self.level >= k) - 1 for k in range(1, top + 1)]
        self.entry, self.height = 0, int(self.level[0]) if n else 0
        for i in range(1, n):
            self._insert(i, beam)

    def _neighbours(self, k: int, i: int) -> np.ndarray:
        row = self.links[k][self.row[k][i]]
        return row[row >= 0]

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], k: int, beam: int) -> list[tuple[float, int]]:
        """The ``beam`` best nodes of level k found from ``start``, (similarity, node)."""
        seen = np.zeros(len(self.x), dtype=bool)
        seen[[i for _, i in start]] = True
        open_ = [(-s, i) for s, i in start]
        best = list(start)
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = self._neighbours(k, i)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for t, j in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (t, j))
                    heapq.heappush(open_, (-t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                    heapq.heappush(open_, (-t, j))
        return best

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Neighbours in several directions: a candidate nearer to a chosen one
        than to the node waits; waiting ones fill up what is left."""
        found = sorted(found, reverse=True)
        own = np.array([j for _, j in found])
        between = self.x[own] @ self.x[own].T
        chosen, waiting = [], []
        for a, (s, _) in enumerate(found):
            if len(chosen) < m and (not chosen or between[a, chosen].max() < s):
                chosen.append(a)
            else:
                waiting.append(a)
        return own[(chosen + waiting)[:m]].tolist()

    def _connect(self, k: int, i: int, j: int) -> None:
        """Adds j to the neighbours of i; a full list is chosen anew."""
        row = self.links[k][self.row[k][i]]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = j
            return
        own = np.append(row, j)
        keep = self._choose(list(zip((self.x[own] @ self.x[i]).tolist(), own.tolist(), strict=True)), len(row))
        row[:] = -1
        row[:len(keep)] = keep

    def _insert(self, i: int, beam: int) -> None:
        q, level = self.x[i], int(self.level[i])
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for k in range(self.height, level, -1):
            at = [max(self._beam(q, at, k, 1))]
        for k in range(min(level, self.height), -1, -1):
            at = self._beam(q, at, k, beam)
            chosen = self._choose(at, self.m)
            row = self.links[k][self.row[k][i]]
            row[:len(chosen)] = chosen
            for j in chosen:
                self._connect(k, j, i)
        if level > self.height:
            self.entry, self.height = i, level

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        if not len(self.x):
            return []
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for k in range(self.height, 0, -1):
            at = [max(self._beam(q, at, k, 1))]
        return self._beam(q, at, 0, beam)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): without null ids, null, empty and zero
    vectors and those with null or non-finite components."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (only(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                                     F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
            .where(F.exists(v, lambda x: x != 0.0)))


def shard_count(vectors: DataFrame, least: int = 1) -> int:
    """Shards that keep the distinct vectors of each within ``SHARD_VECTORS``
    and ``SHARD_NUMBERS``."""
    distinct = usable(vectors).select(F.xxhash64("v").alias("node"), F.size("v").alias("dim")).distinct()
    n, numbers = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    return max(least, -(-n // SHARD_VECTORS), -(-numbers // SHARD_NUMBERS))


def shard_nodes(vectors: DataFrame, shards: int, copies: int) -> DataFrame:
    """shard, dim, node, v, ids: the distinct vectors with their smallest ``copies`` ids."""
    rows = usable(vectors).withColumn("node", F.xxhash64("v")).distinct()
    first = Window.partitionBy("node", "v").orderBy("vec_id")
    few = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= copies)
    nodes = few.groupBy("node", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return nodes.select(F.pmod("node", F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "node", "v", "ids")


def _packed(batches, numbers):
    """Queries of one length as flat binary, in rows of bounded size."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dim in table["dim"].unique().to_pylist():
            own = table.filter(pc.equal(table["dim"], dim))
            step = max(1, numbers // dim)
            for a in range(0, own.num_rows, step):
                part = own.slice(a, step)
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([part["vec_id"].to_numpy().tobytes()], pa.binary()),
                                       pa.array([_matrix(part["v"]).tobytes()], pa.binary())], names=["dim", "ids", "v"])


def query_pieces(queries: DataFrame, numbers: int) -> list[Broadcast]:
    """The distinct queries as broadcasts of about ``numbers`` numbers, each a
    list of (dim, ids, vectors); the driver holds one piece and a partition."""
    asked = usable(queries).distinct().withColumn("dim", F.size("v"))
    sc, held, amount, out = queries.sparkSession.sparkContext, [], 0, []
    for dim, ids, v in map_arrow(asked, _packed, "dim int, ids binary, v binary", numbers=numbers).toLocalIterator():
        if held and amount + len(v) // 8 > numbers:
            out.append(sc.broadcast(held))
            held, amount = [], 0
        held.append((dim, bytes(ids), bytes(v)))
        amount += len(v) // 8
    return out + [sc.broadcast(held)] if held else out


def _opened(piece: Broadcast) -> list:
    """A piece's value, which isn't held beyond its use."""
    value = piece.value
    piece.__dict__.pop("_value", None)  # value is read from the task's file again when next asked for
    return value


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, scaled against overflow."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return np.clip((x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())), -1.0, 1.0)


def _search(g: Graph, x: np.ndarray, ids: list[list[int]], names: list[int], q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    out_q, out_v, out_s = [], [], []
    unit = _unit(q)
    for n in range(len(names)):
        near = [i for _, i in g.search(unit[n], max(beam, 2 * k))]
        scores = _cosines(q[n], x[near])
        best = sorted(((-s, v) for s, i in zip(scores.tolist(), near, strict=True) for v in ids[i] if v != names[n]))[:k]
        out_q += [names[n]] * len(best)
        out_v += [v for _, v in best]
        out_s += [-s for s, _ in best]
    return pa.record_batch([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                           names=["query_id", "vec_id", "score"])


def _searcher(pieces: list[Broadcast], k: int, beam: int):
    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).sort_by("node")
        x, ids = _matrix(group["v"]), group["ids"].to_pylist()
        del group
        g = Graph(_unit(x), seed=int(key[0].as_py()))
        for piece in pieces:
            for dim, names, q in _opened(piece):
                if dim == x.shape[1]:
                    yield _search(g, x, ids, np.frombuffer(names, np.int64).tolist(), np.frombuffer(q).reshape(-1, dim), k, beam)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shards: int = 12, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by cosine
    among all other ids, ties to the smaller id (all candidates, if fewer).
    ``shards`` is the least number of shards.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, as candidates or queries; nor do null ids. Vectors are
    compared only with those of the same length. Repeated rows count once.
    Empty tables give an empty result; further columns are ignored.
    """
    ship(vectors.sparkSession)
    nodes = shard_nodes(vectors, shard_count(vectors, shards), k + 1)
    pieces = query_pieces(queries, QUERY_NUMBERS)
    found = nodes.groupBy("shard", "dim").applyInArrow(_searcher(pieces, k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = kept(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    for piece in pieces:
        piece.destroy()
    return best
