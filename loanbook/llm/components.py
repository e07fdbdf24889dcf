"""Connected components: distributed union-find.

The links are dealt to tasks of bounded size; each unites its own with a
path-halving union-find and passes on one link per node, to its root. While
there are several tasks, a round over the contracted graph follows: every
root takes its smallest neighbour as parent, parents are jumped once, and
links are replaced by links between roots. The links are never gathered in
one place; a hot root is only met by aggregates with partial sums and by joins
that adaptive execution may split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.llm.tables import forget, kept, map_arrow

#: links united by a task
TASK_LINKS = 250_000


def _unite(batches):
    parent: dict[int, int] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; no nulls): the
    root is the smallest node of the component."""
    steps = []  # (a, p) tables: a's root after the step
    links = kept(links.select("a", "b"), "links")
    while True:
        tasks = -(-links.count() // TASK_LINKS)
        if tasks <= 1:
            last = map_arrow(links.coalesce(1), _unite, "a long, b long")
            break
        united = kept(map_arrow(links.repartition(tasks), _unite, "a long, b long"), "local")
        local = united.where("a <> b").distinct()
        both = kept(local.union(local.select("b", "a")), "both")
        forget(links, united)
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = kept(parent.join(up, "p").select("a", F.col("pp").alias("p")), "parent")
        steps.append(parent)
        of_a, of_b = parent.withColumnsRenamed({"p": "x"}), parent.withColumnsRenamed({"a": "b", "p": "y"})
        links = kept(both.join(of_a, "a").join(of_b, "b").where("x <> y")
                     .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        forget(both)
    last = last.withColumnsRenamed({"b": "p"})
    if not steps:
        roots = kept(last.withColumnsRenamed({"a": "node", "p": "root"}), "roots")
        forget(links)
        return roots
    roots = steps[0].withColumnsRenamed({"a": "node", "p": "root"})
    for step in [*steps[1:], last]:
        roots = (roots.join(step.withColumnsRenamed({"a": "root"}), "root", "left")
                 .select("node", F.coalesce("p", "root").alias("root")))
    roots = kept(roots, "roots")
    forget(links, *steps)
    return roots
