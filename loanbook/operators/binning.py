"""Weight-of-evidence binning (M3 fit, M4 transform).

Fitting reads the data once per stage with partial aggregates:
pre-bin edges come from ``approxQuantile`` (at most ``n_prebins`` + 1
numbers per feature), then a single grouped count over the features
stacked into (feature, bin, label) gives good/bad counts per bin. Merging
adjacent bins to a monotone event rate runs on that count table (a few
dozen rows per feature). The transform is a column expression per feature
(bin lookup over a literal edge array, WoE by index) inside codegen.

WoE_i = ln(((good_i + 0.5) / good) / ((bad_i + 0.5) / bad)); a higher WoE
is safer. IV = sum((good_i + 0.5) / good - (bad_i + 0.5) / bad) x WoE_i.
Missing and unseen values get WoE 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.5


def bin_index(value: Column, edges: list[float]) -> Column:
    """Bin = number of edges <= value (bins (-inf,e1), [e1,e2), ..., [ek,inf)); null stays null."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(value.isNull(), F.lit(None)).otherwise(F.size(F.filter(arr, lambda e: e <= value)))


def bin_counts(df: DataFrame, label: str, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, n_good, n_bad) for every feature, one grouped aggregate
    over the features stacked into rows."""
    feats = list(edges)
    stacked = df.select(
        F.col(label).cast("int").alias("__y"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                     bin_index(F.col(f).cast("double"), edges[f]).alias("bin"))
                            for f in feats])).alias("__s"))
    return (stacked.filter(F.col("__s.bin").isNotNull())
                   .groupBy(F.col("__s.feature").alias("feature"), F.col("__s.bin").alias("bin"))
                   .agg(F.count_if(F.col("__y") == 0).alias("n_good"),
                        F.count_if(F.col("__y") == 1).alias("n_bad")))


def woe_table(df: DataFrame, label: str, edges: dict[str, list[float]]) -> DataFrame:
    """M3 for given edges: (feature, bin, lower, upper, n_good, n_bad, woe, iv)."""
    c = bin_counts(df, label, edges)
    spark = df.sparkSession
    bounds = []
    for f, e in edges.items():
        lo = [None] + [float(x) for x in e]
        hi = [float(x) for x in e] + [None]
        bounds += [(f, i, lo[i], hi[i]) for i in range(len(e) + 1)]
    b = spark.createDataFrame(bounds, "feature STRING, bin INT, lower DOUBLE, upper DOUBLE")
    t = b.join(c, ["feature", "bin"], "left").fillna(0, ["n_good", "n_bad"])
    tot = df.agg(F.count_if(F.col(label) == 0).alias("G"), F.count_if(F.col(label) == 1).alias("B"))
    g, bb = tot.select("G").scalar(), tot.select("B").scalar()
    sg = (F.col("n_good") + SMOOTH) / g
    sb = (F.col("n_bad") + SMOOTH) / bb
    t = t.withColumn("woe", F.log(sg / sb))
    return t.withColumn("iv", (sg - sb) * F.col("woe"))


@dataclass
class WoEModel:
    """Fitted bins: per feature, the edges and the WoE of each bin."""
    edges: dict[str, list[float]]
    woe: dict[str, list[float]]
    iv: dict[str, float] = field(default_factory=dict)

    def woe_column(self, f: str) -> Column:
        idx = bin_index(F.col(f).cast("double"), self.edges[f])
        arr = F.array(*[F.lit(float(w)) for w in self.woe[f]])
        # try_element_at: a null index must give null (element_at on a literal
        # array returns its last element for a null index)
        return F.coalesce(F.try_element_at(arr, idx + 1), F.lit(0.0))

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        """M4: add one WoE column per fitted feature (missing -> 0)."""
        return df.select("*", *[self.woe_column(f).alias(f + suffix) for f in self.edges])

    def table(self, spark) -> DataFrame:
        rows = [(f, i, float(w)) for f, ws in self.woe.items() for i, w in enumerate(ws)]
        return spark.createDataFrame(rows, "feature STRING, bin INT, woe DOUBLE")


def model_from_table(tbl: DataFrame, edges: dict[str, list[float]]) -> WoEModel:
    """Build the transform from a WoE table (a few rows per feature)."""
    rows = tbl.select("feature", "bin", "woe", "iv").collect()  # bins x features: bounded
    woe = {f: [0.0] * (len(e) + 1) for f, e in edges.items()}
    iv = {f: 0.0 for f in edges}
    for r in rows:
        woe[r.feature][r.bin] = r.woe
        iv[r.feature] += r.iv
    return WoEModel(edges, woe, iv)


def _monotone_merge(counts: list[tuple[int, int]], edges: list[float], min_share: float):
    """Merge adjacent bins until the event rate is monotone and every bin
    holds at least ``min_share`` of the rows. Works on the count list."""
    bins = [[g, b] for g, b in counts]
    e = list(edges)
    total = sum(g + b for g, b in bins) or 1

    def rate(x):
        return (x[1] + SMOOTH) / (x[0] + x[1] + 2 * SMOOTH)

    changed = True
    while changed and len(bins) > 1:
        changed = False
        for i, x in enumerate(bins):  # small bins into a neighbour
            if (x[0] + x[1]) / total < min_share:
                j = i + 1 if i + 1 < len(bins) else i - 1
                lo, hi = min(i, j), max(i, j)
                bins[lo] = [bins[lo][0] + bins[hi][0], bins[lo][1] + bins[hi][1]]
                del bins[hi]
                del e[lo]
                changed = True
                break
        if changed:
            continue
        up = rate(bins[-1]) >= rate(bins[0])
        for i in range(len(bins) - 1):
            a, b = rate(bins[i]), rate(bins[i + 1])
            if (up and b < a) or (not up and b > a):
                bins[i] = [bins[i][0] + bins[i + 1][0], bins[i][1] + bins[i + 1][1]]
                del bins[i + 1]
                del e[i]
                changed = True
                break
    return bins, e


def fit(df: DataFrame, label: str, features: list[str], n_prebins: int = 20,
        min_share: float = 0.05, rel_error: float = 1e-4) -> WoEModel:
    """M3: quantile pre-bins, monotone merge, WoE per bin."""
    probs = [i / n_prebins for i in range(1, n_prebins)]
    qs = df.approxQuantile(features, probs, rel_error)
    pre = {f: sorted(set(v for v in q if v is not None)) for f, q in zip(features, qs)}
    counts = bin_counts(df, label, pre).collect()  # features x bins: bounded
    tot = df.agg(F.count_if(F.col(label) == 0).alias("G"), F.count_if(F.col(label) == 1).alias("B")).first()
    edges, woe, iv = {}, {}, {}
    for f in features:
        cnt = [(0, 0)] * (len(pre[f]) + 1)
        for r in counts:
            if r.feature == f:
                cnt[r.bin] = (r.n_good, r.n_bad)
        bins, e = _monotone_merge(cnt, pre[f], min_share)
        edges[f] = e
        ws = [math.log(((g + SMOOTH) / tot.G) / ((b + SMOOTH) / tot.B)) for g, b in bins]
        woe[f] = ws
        iv[f] = sum(((g + SMOOTH) / tot.G - (b + SMOOTH) / tot.B) * w for (g, b), w in zip(bins, ws))
    return WoEModel(edges, woe, iv)
