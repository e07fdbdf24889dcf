"""From candidate groups to verified components, without all pairs of a group.

Nodes that share a key (a rare n-gram of their prefixes, a band of a
signature) may be similar. In leader rounds every node of a key is compared
only with one leader of the key that isn't in its component yet, another
leader in each round; the links found unite nodes. For the last round, the
keys with several components left are put in bags by their leader, and the
members of a bag are compared block by block. Every pair that shares a key is
then either united or was compared, so no link is lost, and no row per pair
of a group is ever made.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.components import components
from loanbook.llm.prefix_tree import block_links
from loanbook.llm.tables import forget, kept, map_arrow

#: members in a block of a bag
BLOCK = 512
#: partners that one verification task group holds beside its hub
HUB_PARTNERS = 128
#: most leader rounds; further ones are left out once fewer than one in
#: ``ENOUGH_LINKS`` of a round's pairs is a link (both steer the work, not the result)
LEADER_ROUNDS = 3
ENOUGH_LINKS = 20
#: groups are verified together until their contents are so long (no effect on results)
AT_ONCE = 1 << 18


def shared_entries(entries: DataFrame, possible: Column | None = None) -> DataFrame:
    """The rows of ``entries`` (key, node, ...) whose key has several nodes, and
    with ``possible`` (on the aliases x and y) only those with a possible
    partner. One exchange on the key serves the counting and the join: the
    counting reads all columns, so that both sides are the same."""
    dealt = entries.repartition("key")
    rest = [c for c in entries.columns if c not in ("key", "node")]
    several = dealt.groupBy("key").agg(F.min("node").alias("__lo"), F.max("node").alias("__hi"),
                                       *[F.max(c).alias(f"__{c}") for c in rest])
    wanted = F.col("__lo") != F.col("__hi")
    for c in rest:
        wanted = wanted | F.col(f"__{c}").isNull()
    shared = kept(dealt.join(several.where(wanted).select("key").hint("shuffle_hash"), "key"), "entries")
    return shared if possible is None else promising(shared, possible)


def promising(shared: DataFrame, possible: Column) -> DataFrame:
    """The rows of a kept table (key, node, ...) with a possible partner of
    the same key; the table itself goes."""
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & possible
    out = kept(shared.alias("x").join(shared.alias("y"), met, "left_semi"), "entries")
    forget(shared)
    return out


def united(entries: DataFrame, verify: Callable[[DataFrame], DataFrame],
           class_of: Column | None = None, possible: Column | None = None,
           sift: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes with a link. ``entries`` come from
    ``shared_entries``; ``verify`` takes groups (bag, i, j, node, root, side)
    and returns the links (a, b) between the rows of side 1 and 0 of a group,
    or among those of side 2; ``class_of`` splits a key among leaders;
    ``possible`` is a condition on the aliases x and y of two entries; ``sift``
    takes pairs (hub, node) and leaves out ones that can't be links; ``known``
    are links found before (a kept table, which goes)."""
    columns = entries.columns
    every = entries.withColumn("__class", F.lit(0) if class_of is None else class_of)
    e = every.withColumn("root", F.col("node"))
    founds, met = [], F.col("x.root") != F.col("y.root")

    def mixed(e, roots):
        """The rows of keys that have several components."""
        told = e.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = (told.groupBy("key").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"))
                   .where("__lo <> __hi").select("key"))
        return kept(told.join(several, "key"), "mixed")

    if known is not None:
        founds, roots = [known], components(known)
        e = mixed(e, roots)
        if e.isEmpty():
            forget(e, known)
            return roots
    if possible is not None:
        met = met & possible
    for turn in range(LEADER_ROUNDS):
        leader = F.min(F.struct(F.xxhash64("node", F.lit(turn)), *columns, "root")).alias("__l")
        leaders = e.groupBy(F.col("key").alias("__k"), F.col("__class").alias("__c")).agg(leader)
        leaders = leaders.select("__c", *[F.col(f"__l.{c}") for c in columns], "__l.root")
        pairs = (e.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.__class") == F.col("y.__c")) & met)
                 .select(F.col("y.node").alias("hub"), F.col("x.node").alias("node")).distinct())
        pairs = kept(pairs if sift is None else sift(pairs), "pairs")
        founds.append(kept(verify(hub_groups(pairs)), "found"))
        roots = components(functools.reduce(DataFrame.union, founds))
        # a key whose lines are united stays so: only the others go on
        before, e = e, mixed(e, roots)
        enough = founds[-1].count() * ENOUGH_LINKS < pairs.count()
        forget(pairs, before)
        if enough:
            break
    if possible is not None:
        before, e = e, kept(e.alias("x").join(e.alias("y"), (F.col("x.key") == F.col("y.key")) & met, "left_semi"), "mixed")
        forget(before)
    bags = (e.join(e.groupBy(F.col("key").alias("__k")).agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("__l")),
                   F.col("key") == F.col("__k")).select(F.col("__l.node").alias("bag"), "node", "root").distinct())
    bags = kept(bags, "bags")
    forget(e)
    founds.append(kept(verify(block_groups(bags)), "found"))
    if not founds[-1].isEmpty():
        before, roots = roots, components(functools.reduce(DataFrame.union, founds))
        forget(before)
    forget(bags, *founds)
    return roots


def _checked(batches, sets_of, percent: int, compare):
    """Links of the groups, which stand together in each task's rows."""
    key, held, begins, amount = None, ([], [], [], []), [], 0

    def links():
        return _spanning(compare(*held[:3], sets_of(held[3]), begins, percent), dict(zip(held[0], held[1], strict=True)))

    for batch in batches:
        out = []
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        border = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if batch.num_rows else []
        columns = [batch.column(c).to_pylist() for c in range(3, 7)]
        for a, b in zip(border, [*border[1:], batch.num_rows], strict=True):
            own = tuple(keys[:, a].tolist())
            if own != key:
                if amount >= AT_ONCE:
                    out += links()
                    held, begins, amount = ([], [], [], []), [], 0
                key = own
                begins.append(len(held[0]))
            for c, values in zip(held, columns, strict=True):
                c += values[a:b]
            amount += sum(map(len, columns[3][a:b]))
        if out:
            yield _link_batch(out)
    if held[0]:
        yield _link_batch(links())


def _spanning(links: list[tuple[int, int]], root: dict[int, int]) -> list[tuple[int, int]]:
    """The links that unite something yet apart: among near copies a few, not
    one for every pair, and with the same components."""
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in links:
        x, y = find(root[a]), find(root[b])
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def tree_links(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], begins: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of groups that begin at ``begins``, by a prefix tree per group."""
    out = []
    for a, b in zip(begins, [*begins[1:], len(sets)], strict=True):
        out += block_links(nodes[a:b], roots[a:b], sides[a:b], sets[a:b], percent)
    return out


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def checked(groups: DataFrame, contents: DataFrame, sets_of: Callable, percent: int, compare: Callable = tree_links) -> DataFrame:
    """Links (a, b) of the groups. ``contents`` has node and one column more,
    a list of which ``sets_of`` turns into key sets for ``compare``, which is
    given many groups at once."""
    column = next(c for c in contents.columns if c != "node")
    rows = groups.join(contents, "node").select("bag", "i", "j", "node", "root", "side", column)
    rows = rows.repartition("bag", "i", "j").sortWithinPartitions("bag", "i", "j")
    return map_arrow(rows, _checked, "a long, b long", sets_of=sets_of, percent=percent, compare=compare)


def hub_groups(pairs: DataFrame) -> DataFrame:
    """Groups that compare each hub with its partners, in parts of bounded size."""
    size = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PARTNERS).alias("__parts"))
    p = (pairs.join(size, "hub").select(F.col("hub").alias("bag"), F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int").alias("i"),
                                        F.lit(-1).alias("j"), "node", F.col("node").alias("root"), F.lit(0).alias("side")))
    own = (p.select("bag", "i", "j").distinct()
           .select("bag", "i", "j", F.col("bag").alias("node"), F.col("bag").alias("root"), F.lit(1).alias("side")))
    return p.union(own)


def block_groups(bags: DataFrame) -> DataFrame:
    """Groups that compare all members of a bag (bag, node, root) with each
    other, block by block: the rows of a pair of blocks, never of a pair of
    members."""
    size = bags.groupBy("bag").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int")
    return (bags.join(size, "bag").withColumn("__b", own)
            .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            .select("bag", F.least("__b", "__o").alias("i"), F.greatest("__b", "__o").alias("j"), "node", "root",
                    F.when(F.col("__b") == F.col("__o"), 2).when(F.col("__b") < F.col("__o"), 1).otherwise(0).alias("side")))
