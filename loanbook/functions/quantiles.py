"""Exact quantiles that scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a global median over a very large column ends up in
one task. Here the exact order statistics are found by narrowing:

1. one aggregate gives the non-null count, minimum and maximum of every column;
2. each pass cuts the value range of every open order statistic into
   ``CELLS`` cells and counts them (with the smallest and largest value of
   each cell) in one partial aggregate; the cell that holds the rank is the
   next range;
3. an order statistic is found once its range is a single value.

A pass counts all columns together, so the number of jobs depends on the
values, not on the number of columns or rows. Every pass puts the ends of a
range in different cells, so it always ends. At most ``CELLS`` rows an order
statistic reach the driver.

The interpolation is Spark's own, (hi - pos) x lower + (pos - lo) x upper, so
the result equals ``percentile`` bit for bit. Nulls and NaN are left out;
infinities count as the largest finite values.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: cells of a range in a pass
CELLS = 4096


def _finite(c: Column) -> Column:
    v = c.cast("double")
    top = F.lit(sys.float_info.max)
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, top), -top))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], between: bool = True) -> dict[str, float | None]:
    """The quantile of every ``name: (column expression, q)``; None without
    values. ``between=False`` gives the value of rank floor(q (n - 1)) itself,
    with no interpolation; q may be a Fraction. Equal columns share a pass."""
    names = list(wanted)
    if not names:
        return {}
    texts = [str(wanted[k][0]) for k in names]
    column = [texts.index(x) for x in texts]  # names on one column: the first of them stands for it
    d = df.select(*[_finite(wanted[names[i]][0]).alias(f"v{i}") for i in sorted(set(column))])
    r = d.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in sorted(set(column))
                for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}  # (column, rank): range, values below it
    spots = {}
    for k, i in zip(names, column, strict=True):
        if r[f"n{i}"]:
            pos = wanted[k][1] * (r[f"n{i}"] - 1)
            spots[k] = (i, pos, math.floor(pos), math.ceil(pos) if between else math.floor(pos))
            for rank in spots[k][2:]:
                open_[i, rank] = (r[f"lo{i}"], r[f"hi{i}"], 0)
    while True:
        found.update({key: lo for key, (lo, hi, _) in open_.items() if lo == hi})
        open_ = {key: x for key, x in open_.items() if x[0] != x[1]}
        if not open_:
            break
        keys = list(open_)
        ranges = {r: t for t, r in enumerate(sorted({(i, lo, hi) for (i, _), (lo, hi, _) in open_.items()}))}
        cells = []
        for i in sorted({i for i, _, _ in ranges}):  # one row a column, whatever its number of ranges: they don't overlap
            own = [(lo, hi, t) for (k, lo, hi), t in ranges.items() if k == i]
            v = F.col(f"v{i}")
            at = F.size(F.filter(F.array(*[F.lit(x[0]) for x in own]), lambda lo: lo <= v))

            def of(values):
                return F.try_element_at(F.array(*[F.lit(x) for x in values]), at)

            lo, hi = of([x[0] for x in own]), of([x[1] for x in own])
            cell = F.least(((v / 2 - lo / 2) / of([x[1] / 2 - x[0] / 2 for x in own]) * CELLS).cast("int"), F.lit(CELLS - 1))
            cells.append(F.when((at > 0) & (v <= hi), F.struct((at + (own[0][2] - 1)).alias("t"), cell.alias("c"), v.alias("v"))))
        rows = d.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select("x.*")
        table: dict[int, list] = {}
        for x in rows.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            table.setdefault(x.t, []).append(x)
        for i, rank in keys:
            lo, hi, below = open_[i, rank]
            for x in sorted(table[ranges[i, lo, hi]], key=lambda x: x.c):
                if below + x.n > rank:
                    open_[i, rank] = (x.lo, x.hi, below)
                    break
                below += x.n
    out: dict[str, float | None] = dict.fromkeys(names)
    for k, (i, pos, lo_r, hi_r) in spots.items():
        lower, upper = found[i, lo_r], found[i, hi_r]
        out[k] = lower if lo_r == hi_r else (hi_r - pos) * lower + (pos - lo_r) * upper
    return out


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    return exact_quantiles(df, {"v": (F.col(col), q)})["v"]
