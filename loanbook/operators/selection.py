"""Committee selection (Q8): maximise profit under RWA, EL and EAD limits.

Re-aimed from an exact binary program to a Lagrangian dual that scales, with a
certificate of how much of the answer is proved:

1. Weights count in whole ten-thousandths, rounded up, and limits rounded down
   (values first rounded to 1e-7). So every sum is exact and independent of the
   partitioning, and what fits in units fits.
2. ``dual_prices``: projected subgradient on the three prices. One aggregate
   values a whole line of step lengths at once. The dual value is an upper
   bound on the profit of any feasible set. It stops at a stated tolerance.
3. ``select``: loans of positive profit in the order of profit per priced
   weight; a histogram over log-score buckets gives prefix sums of the three
   weights; whole buckets are kept while all prefixes fit, and only the
   marginal bucket is ranked row by row, by distributed running sums. Further
   rounds fill the capacity that is left, until a round adds nothing or the
   profit is within ``gap`` of the bound.
4. ``certify``: a loan whose reduced profit exceeds the distance between the
   bound and a feasible profit keeps its side in every best selection, as
   flipping it would push the bound below that profit. Such loans are fixed,
   the bound is taken anew over the loans that are left and the capacity that
   is left, and so on until nothing more is fixed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.operators.pricing import rwa_proxy
from loanbook.operators.sampling import running_sums
from loanbook.session import cut_lineage, reuse

BUCKETS_PER_OCTAVE = 256
#: units of a weight or limit
UNIT = 10_000
#: step lengths valued in one pass, each half of the one before
STEPS = 8


def _units(c: Column) -> Column:
    return F.ceil(F.rint(F.coalesce(c, F.lit(0.0)) * UNIT * 1000) / 1000).cast("long")


def limit_units(limits) -> list[int]:
    if min(limits) < 0:
        raise ValueError("a negative limit admits no feasible selection")
    return [math.floor(round(x * UNIT, 3)) for x in limits]


def _scaled(c: Column, limit: int) -> Column:
    if limit > 0:
        return c / F.lit(float(limit))
    # a zero limit admits only loans with zero weight
    return F.when(c > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def items(report: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """(id, p, w0..w2, a0..a2): profit, the weights (RWA, EL, EAD) in units, and
    as shares of their limits. Loans without a profit take no part."""
    raw = [_units(rwa_proxy()), _units(F.col("Expected_Loss")), _units(F.col("EAD"))]
    it = report.filter(F.col("Expected_Profit").isNotNull()).select(
        "id", F.col("Expected_Profit").alias("p"), *[raw[k].alias(f"w{k}") for k in range(3)])
    return it.select("*", *[_scaled(F.col(f"w{k}"), lim).alias(f"a{k}") for k, lim in enumerate(limit_units(limits))])


def reduced_profit(lam: list[float]) -> Column:
    return F.col("p") - sum((F.lit(float(lam[k])) * F.col(f"a{k}") for k in range(3) if lam[k] > 0), F.lit(0.0))


def _values(it: DataFrame, lines: list[list[float]]) -> list[tuple[float, list[float]]]:
    """(dual value, constraint use of the loans taken) of each price vector, in one pass."""
    out = []
    for j, lam in enumerate(lines):
        red = reduced_profit(lam)
        out.append(F.sum(F.greatest(red, F.lit(0.0))).alias(f"v{j}"))
        out += [F.sum(F.when(red > 0, F.col(f"a{k}")).otherwise(0.0)).alias(f"u{j}_{k}") for k in range(3)]
    r = it.agg(*out).first()
    return [((r[f"v{j}"] or 0.0) + sum(lam), [r[f"u{j}_{k}"] or 0.0 for k in range(3)]) for j, lam in enumerate(lines)]


def dual_prices(it: DataFrame, tol: float = 1e-6, start: list[float] | None = None) -> tuple[list[float], float]:
    """(prices, upper bound): projected subgradient on the dual. Each pass
    values ``STEPS`` step lengths from the best prices so far and keeps the
    best. Steps start shorter after a pass that gains less than ``tol``
    (relative), and the search ends when three passes in a row did; the bound
    holds wherever it ends."""
    best_lam = list(start or [0.0, 0.0, 0.0])
    (best, use), = _values(it, [best_lam])
    reach, stale = 1.0, 0
    while stale < 3:
        g = [1.0 - u for u in use]
        if all(x >= 0 for x in g) and all(best_lam[k] == 0 or abs(g[k]) < 1e-12 for k in range(3)):
            break  # feasible and complementary: the relaxation is solved
        g2 = sum(x * x for x in g if math.isfinite(x)) or 1.0
        g = [x if math.isfinite(x) else -1.0 for x in g]
        eta = reach * max(best, 1e-9) / g2
        lines = [[max(0.0, best_lam[k] - eta / 4 ** j * g[k]) for k in range(3)] for j in range(STEPS)]
        at, (value, used) = min(enumerate(_values(it, lines)), key=lambda x: x[1][0])
        gained = best - value
        if gained > 0:
            best_lam, best, use = lines[at], value, used
            reach = reach / 4 ** at * 4
        if gained < tol * max(abs(best), 1e-9):
            stale += 1
            reach /= 4 ** (STEPS // 2)
        else:
            stale = 0
    return best_lam, best


def _prefix_pick(cand: DataFrame, limits: list[int]) -> DataFrame:
    """The longest prefix of ``cand`` in (score desc, id) order whose three
    running weight sums fit the limits: whole histogram buckets, then a
    row-by-row pass over the one marginal bucket. Returns (id, p, w0, w1, w2)."""
    hist = cand.groupBy("bucket").agg(*[F.sum(f"w{k}").alias(f"s{k}") for k in range(3)])
    w = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over buckets
    hist = hist.select("bucket", *[F.sum(f"s{k}").over(w).alias(f"c{k}") for k in range(3)])
    fits = (F.col("c0") <= limits[0]) & (F.col("c1") <= limits[1]) & (F.col("c2") <= limits[2])
    mb = hist.filter(~fits).agg(F.max("bucket")).first()[0]  # the marginal bucket (none: all fit)
    cols = ["id", "p", "w0", "w1", "w2"]
    if mb is None:
        return cand.select(*cols)
    whole = cand.filter(F.col("bucket") > mb)
    used = whole.agg(*[F.sum(f"w{k}") for k in range(3)]).first()
    base = [x or 0 for x in used]
    edge = cand.filter(F.col("bucket") == mb).select(*cols, (-F.col("score")).alias("neg_score"))
    rs = running_sums(edge, ["neg_score", "id"], ["w0", "w1", "w2"])
    edge = rs.filter(reduce(lambda a, b: a & b, [F.col(f"cum_w{k}") + base[k] <= limits[k] for k in range(3)]))
    return whole.select(*cols).unionByName(edge.select(*cols))


def select(report: DataFrame, limits: tuple[float, float, float], prices: list[float] | None = None,
           rounds: int | None = None, gap: float = 1e-7) -> tuple[DataFrame, float]:
    """Q8: the report with a boolean ``selected``, and the dual bound.

    After the first prefix pick, more picks run over the loans not yet chosen
    with the capacity that is left (the loan that stopped the previous prefix
    no longer fits and drops out), until a round adds no loan, the profit is
    within ``gap`` (relative) of the bound, or ``rounds`` are done. A loan of
    negative profit is never selected. ``prices`` skips the dual search."""
    it = reuse(items(report, limits))
    lam, bound = (prices, _values(it, [prices])[0][0]) if prices else dual_prices(it)
    price = sum((F.lit(lam[k] + 1e-9) * F.col(f"a{k}") for k in range(3)), F.lit(1e-12))
    base = it.filter(F.col("p") > 0).withColumn("score", F.col("p") / price)
    base = base.withColumn("bucket", F.floor(F.log2("score") * BUCKETS_PER_OCTAVE).cast("long"))
    remaining, picks, profit = limit_units(limits), [], 0.0
    while rounds is None or len(picks) < rounds:
        # each round starts from the cached base minus the frozen earlier picks,
        # so plans stay flat however many rounds run
        pool = base if not picks else base.join(reduce(lambda a, b: a.unionByName(b), picks), "id", "left_anti")
        # a loan whose own weight exceeds what is left can never be chosen
        fit_alone = reduce(lambda a, b: a & b, [F.col(f"w{k}") <= F.lit(remaining[k]) for k in range(3)])
        pick = cut_lineage(_prefix_pick(pool.filter(fit_alone), remaining))
        used = pick.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), *[F.sum(f"w{k}").alias(f"u{k}") for k in range(3)]).first()
        if not used.n:
            break
        picks.append(pick.select("id"))
        profit += used.p
        remaining = [remaining[k] - used[f"u{k}"] for k in range(3)]
        if bound - profit <= gap * max(abs(bound), 1e-9):
            break
    if not picks:
        return report.withColumn("selected", F.lit(False)), bound
    chosen = reduce(lambda a, b: a.unionByName(b), picks).withColumn("selected", F.lit(True))
    return report.join(chosen, "id", "left").fillna(False, ["selected"]), bound


def certify(selected: DataFrame, limits: tuple[float, float, float]) -> tuple[DataFrame, dict]:
    """The loans of a feasible selection (a report with ``selected``) that are
    proved: (id, proved: true = in every best selection, false = in none).
    And a summary: profit, bound, gap, n_in, n_out, n_open, rounds.

    Sides are proved with a margin for rounding of the double sums. Loans of
    no profit column or open ones aren't listed."""
    it = items(selected, limits).join(selected.select("id", "selected"), "id")
    it = cut_lineage(it)
    low = it.filter("selected").agg(F.sum("p")).first()[0] or 0.0
    lam, bound = dual_prices(it)
    found, fixed_p, room, rounds, free, n = [], 0.0, [1.0, 1.0, 1.0], 0, it, it.count()
    done = 0
    while True:
        rounds += 1
        # prices of the shares that are left: a loan's flip costs the bound its reduced profit
        red = reduced_profit(lam)
        margin = (bound - low) + 1e-9 * max(abs(bound), 1.0)
        sure = cut_lineage(free.withColumn("r", red).filter(F.abs("r") > margin)
                           .select("id", "p", "a0", "a1", "a2", (F.col("r") > 0).alias("proved")))
        t = sure.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("proved"), F.col("p"))).alias("p"),
                     *[F.sum(F.when(F.col("proved"), F.col(f"a{k}"))).alias(f"u{k}") for k in range(3)]).first()
        if not t.n:
            break
        found.append(sure.select("id", "proved"))
        done += t.n
        fixed_p += t.p or 0.0
        room = [max(0.0, room[k] - (t[f"u{k}"] or 0.0)) for k in range(3)]
        free = cut_lineage(free.join(sure.select("id"), "id", "left_anti"))
        if done == n:
            break
        # the rest is a smaller problem: its shares are of the room that is left
        inner = free.select("id", "p", *[(F.when(F.col(f"a{k}") > 0, F.col(f"a{k}") / room[k] if room[k] > 0 else F.lit(float("inf")))
                                          .otherwise(0.0)).alias(f"a{k}") for k in range(3)])
        inner_lam, inner_bound = dual_prices(reuse(inner), start=[lam[k] * room[k] for k in range(3)])
        if fixed_p + inner_bound >= bound:
            continue_bound = bound
        else:
            continue_bound, lam = fixed_p + inner_bound, [inner_lam[k] / room[k] if room[k] > 0 else lam[k] for k in range(3)]
        bound = min(bound, continue_bound)
    spark = selected.sparkSession
    sides = reduce(lambda a, b: a.unionByName(b), found) if found else spark.createDataFrame([], "id LONG, proved BOOLEAN")
    n_in = sides.filter("proved").count() if found else 0
    return sides, {"profit": low, "bound": bound, "gap": bound - low, "n_in": n_in, "n_out": done - n_in, "n_open": n - done, "rounds": rounds}


def selection_totals(sel: DataFrame, limits: tuple[float, float, float], bound: float) -> DataFrame:
    """Totals of the selected loans, the limits, the dual bound and the gap."""
    s = sel.filter("selected")
    out = s.agg(F.coalesce(F.sum("Expected_Profit"), F.lit(0.0)).alias("profit"),
                F.coalesce(F.sum(rwa_proxy()), F.lit(0.0)).alias("rwa"),
                F.coalesce(F.sum("Expected_Loss"), F.lit(0.0)).alias("el"),
                F.coalesce(F.sum("EAD"), F.lit(0.0)).alias("ead"),
                F.count(F.lit(1)).alias("granted"))
    return out.select("*", F.lit(float(limits[0])).alias("rwa_limit"),
                      F.lit(float(limits[1])).alias("provision_limit"),
                      F.lit(float(limits[2])).alias("cash_limit"),
                      F.lit(float(bound)).alias("dual_bound"),
                      (F.lit(float(bound)) - F.col("profit")).alias("gap"))
