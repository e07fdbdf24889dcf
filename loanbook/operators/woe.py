"""Optimal weight-of-evidence binning as an ML estimator.

``WoEBinner`` fits the bins of numeric and categorical columns against a 0/1
label; its model adds a WoE column for each. Both are ``pyspark.ml`` stages,
so they stand in a ``Pipeline``, are tuned with it and are saved and read back
with it. The state of a model is two tables: its bins, and the level map of
the categorical columns.

Fitting, in passes over the data with partial aggregates; the label and the
fitted columns are kept for these passes, whatever plan they come from:

1. numeric columns: exact order statistics cut each column into ``prebins``
   of equal size (values themselves, ties together); one grouped count gives
   good and bad rows of every pre-bin;
2. categorical columns: one grouped count of (column, level). Levels below
   ``rareShare`` are pooled, the others stand in order of event rate. At most
   1 / ``rareShare`` levels a column are left, whatever the column holds;
3. on these small count tables, dynamic programming finds the contiguous
   grouping of greatest information value under the wanted shape of the event
   rate, the least share of a bin and the most bins.

WoE_i = ln(((good_i + 0.5) / good) / ((bad_i + 0.5) / bad)), IV = sum of
((good_i + 0.5) / good - (bad_i + 0.5) / bad) WoE_i. Null, NaN and unseen
values get WoE 0. Numeric bins are looked up in an expression; levels by a
join, so a column of any number of levels never passes the driver.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from loanbook.functions.quantiles import exact_quantiles
from loanbook.operators.binning import SMOOTH, bin_index
from loanbook.session import cut_lineage

#: directions of the event rate, in the order they may follow each other
SHAPES = {"ascending": [(1,)], "descending": [(-1,)], "monotone": [(1,), (-1,)], "peak": [(1, -1)], "valley": [(-1, 1)],
          "auto": [(1, -1), (-1, 1)], "any": [()]}
BINS = "feature STRING, kind STRING, bin INT, lower DOUBLE, upper DOUBLE, n_good LONG, n_bad LONG, woe DOUBLE, iv DOUBLE"


def woe_iv(good: int, bad: int, all_good: int, all_bad: int) -> tuple[float, float]:
    g, b = (good + SMOOTH) / all_good, (bad + SMOOTH) / all_bad
    w = math.log(g / b)
    return w, (g - b) * w


def best_bins(counts: list[tuple[int, int]], all_good: int, all_bad: int, trend: str = "monotone",
              min_share: float = 0.05, max_bins: int = 8) -> list[int]:
    """Ends (exclusive) of the bins of greatest information value over the
    contiguous groupings of ``counts`` (good, bad) whose bins hold ``min_share``
    of the rows each and whose event rates follow ``trend``. Of equal values
    fewer bins win, then earlier ends. Without an admissible grouping, one bin.

    A partial grouping is told apart by its last bin, its number of bins and
    how far it has come along the shape; only its best value goes on.
    """
    n = len(counts)
    good, bad = [0], [0]
    for g, b in counts:
        good.append(good[-1] + g)
        bad.append(bad[-1] + b)
    least = min_share * (good[-1] + bad[-1])
    segment = {}
    for i in range(n):
        for j in range(i + 1, n + 1):
            g, b = good[j] - good[i], bad[j] - bad[i]
            if g + b >= least and g + b > 0:
                segment[i, j] = (g, b, woe_iv(g, b, all_good, all_bad)[1])
    best = None
    for shape in SHAPES[trend]:
        ending: dict[int, dict] = {j: {} for j in range(n + 1)}  # end -> (start, bins, phase) -> (value, ends)
        for (i, j), (g, b, iv) in sorted(segment.items()):
            here = ending[j]
            if i == 0:
                for phase in range(max(1, len(shape))):
                    here[0, 1, phase] = (iv, (j,))
                continue
            for (h, k, phase), (value, ends) in ending[i].items():
                if k == max_bins:
                    continue
                gp, bp, _ = segment[h, i]
                turn = b * (gp + bp) - bp * (g + b)  # sign of the step in the event rate
                sign = (turn > 0) - (turn < 0)
                for after in {phase, min(phase + 1, len(shape) - 1)} if shape else {0}:
                    if shape and sign and sign != shape[after]:
                        continue
                    key, new = (i, k + 1, after), (value + iv, (*ends, j))
                    old = here.get(key)
                    if old is None or (new[0], [-e for e in new[1]]) > (old[0], [-e for e in old[1]]):
                        here[key] = new
        for value, ends in ending[n].values():
            rank = (value, -len(ends), [-e for e in ends])
            if best is None or rank > best[0]:
                best = (rank, ends)
    return list(best[1]) if best else [n]


class _WoEParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "columns taken as strings", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    suffix = Param(Params._dummy(), "suffix", "ending of the WoE columns", TypeConverters.toString)
    prebins = Param(Params._dummy(), "prebins", "pre-bins of a numeric column", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a column", TypeConverters.toInt)
    minShare = Param(Params._dummy(), "minShare", "least share of a bin", TypeConverters.toFloat)
    rareShare = Param(Params._dummy(), "rareShare", "levels of a smaller share are pooled", TypeConverters.toFloat)
    trend = Param(Params._dummy(), "trend", "shape of the event rate of numeric columns", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], labelCol="label", suffix="_woe", prebins=20, maxBins=8,
                         minShare=0.05, rareShare=0.01, trend="monotone")

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


def _stacked(df: DataFrame, label: str, cells: list[tuple[str, Column]], name: str) -> DataFrame:
    """(feature, cell, n_good, n_bad), all columns in one grouped count."""
    rows = df.select(F.col(label).cast("int").alias("y"), F.explode(F.array(
        *[F.struct(F.lit(f).alias("feature"), c.alias(name)) for f, c in cells])).alias("s"))
    return (rows.where(F.col(f"s.{name}").isNotNull()).groupBy("s.feature", f"s.{name}")
            .agg(F.count_if(F.col("y") == 0).alias("n_good"), F.count_if(F.col("y") == 1).alias("n_bad")))


class WoEBinner(Estimator, _WoEParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``WoEModel``: see the module's text."""

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, labelCol=None, suffix=None, prebins=None, maxBins=None,
                 minShare=None, rareShare=None, trend=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> WoEModel:
        spark, label = df.sparkSession, self.get("labelCol")
        read = dict.fromkeys([label, *self.get("numericCols"), *self.get("categoricalCols")])
        df = df.where(F.col(label).isNotNull()).select(*[df[c] for c in read]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            t = df.agg(F.count_if(F.col(label) == 0).alias("g"), F.count_if(F.col(label) == 1).alias("b")).first()
            if not t.g or not t.b:
                raise ValueError("both classes are needed")
            rows = [*self._numeric(df, t.g, t.b)]
            levels, more = self._levels(df, t.g, t.b)
        finally:
            df.unpersist()
        bins = spark.createDataFrame([*rows, *more], BINS)
        return self._copyValues(WoEModel(bins, levels))

    def _bins(self, feature, kind, counts, t_g, t_b, trend):
        """Rows of the bins of one column, and the bin of each of its counts."""
        ends = best_bins(counts, t_g, t_b, trend, self.get("minShare"), self.get("maxBins"))
        of, rows, a = [], [], 0
        for k, b in enumerate(ends):
            g, d = sum(x for x, _ in counts[a:b]), sum(x for _, x in counts[a:b])
            rows.append((feature, kind, k, g, d, *woe_iv(g, d, t_g, t_b)))
            of += [k] * (b - a)
            a = b
        return rows, of, ends

    def _numeric(self, df, t_g, t_b):
        names, n = self.get("numericCols"), self.get("prebins")
        if not names:
            return
        value = {f: F.nullif(F.col(f).cast("double"), F.lit(float("nan"))) for f in names}
        cuts = exact_quantiles(df, {f"{i} {f}": (F.col(f), Fraction(i, n)) for f in names for i in range(1, n)}, between=False)
        edges = {f: sorted({cuts[f"{i} {f}"] for i in range(1, n)} - {None}) for f in names}
        counts = {f: [(0, 0)] * (len(edges[f]) + 1) for f in names}
        for r in _stacked(df, self.get("labelCol"), [(f, bin_index(value[f], edges[f])) for f in names], "bin").collect():  # names x prebins
            counts[r.feature][r.bin] = (r.n_good, r.n_bad)
        for f in names:
            rows, _, ends = self._bins(f, "numeric", counts[f], t_g, t_b, self.get("trend"))
            bounds = [None, *[edges[f][e - 1] for e in ends[:-1]], None]
            for k, (_, _, _, g, b, w, iv) in enumerate(rows):
                yield (f, "numeric", k, bounds[k], bounds[k + 1], g, b, w, iv)

    def _levels(self, df, t_g, t_b):
        """(level map (feature, level, bin, woe), rows of the bins)."""
        names = self.get("categoricalCols")
        spark = df.sparkSession
        if not names:
            return spark.createDataFrame([], "feature STRING, level STRING, bin INT, woe DOUBLE"), []
        counted = cut_lineage(_stacked(df, self.get("labelCol"), [(f, F.col(f).cast("string")) for f in names], "level"))
        size = F.col("n_good") + F.col("n_bad")
        whole = counted.groupBy("feature").agg(F.sum(size).alias("n"))
        common = counted.join(whole, "feature").withColumn("rare", size < F.col("n") * self.get("rareShare"))
        # one row for each common level and one for all rare ones: at most 1 / rareShare + 1 a column
        few = (common.groupBy("feature", "rare", F.when(~F.col("rare"), F.col("level")).alias("level"))
               .agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad")).collect())
        found, rows = [], []
        for f in names:
            own = [r for r in few if r.feature == f]
            own.sort(key=lambda r: (Fraction(r.n_bad, max(1, r.n_good + r.n_bad)), r.rare, r.level or ""))
            if not own:
                continue
            bins, of, _ = self._bins(f, "level", [(r.n_good, r.n_bad) for r in own], t_g, t_b, "any")
            rows += [(f, "level", k, None, None, g, b, w, iv) for _, _, k, g, b, w, iv in bins]
            found += [(f, r.rare, r.level, k, bins[k][5]) for r, k in zip(own, of, strict=True)]
        told = spark.createDataFrame(found, "feature STRING, rare BOOLEAN, level STRING, bin INT, woe DOUBLE")
        c, m = common.alias("c"), told.alias("m")
        same = (F.col("c.feature") == F.col("m.feature")) & (F.col("c.rare") == F.col("m.rare"))
        levels = c.join(m, same & (F.col("c.rare") | (F.col("c.level") == F.col("m.level")))).select("c.feature", "c.level", "m.bin", "m.woe")
        return cut_lineage(levels), rows


class WoEModel(Model, _WoEParams, MLReadable, MLWritable):
    """Adds a WoE column for each fitted column. ``bins``: (feature, kind, bin,
    lower, upper, n_good, n_bad, woe, iv); ``levels``: (feature, level, bin, woe)."""

    def __init__(self, bins: DataFrame | None = None, levels: DataFrame | None = None):
        super().__init__()
        self.bins, self.levels = bins, levels

    def _transform(self, df: DataFrame) -> DataFrame:
        numeric: dict[str, list] = {}
        for r in self.bins.where("kind = 'numeric'").orderBy("feature", "bin").collect():  # columns x maxBins
            numeric.setdefault(r.feature, []).append(r)
        out, suffix = df, self.get("suffix")
        for f in self.get("categoricalCols"):
            own = self.levels.where(F.col("feature") == f).select(F.col("level").alias(f"{f}{suffix} level"), F.col("woe").alias(f"{f}{suffix}"))
            out = (out.join(own, out[f].cast("string") == own[f"{f}{suffix} level"], "left").drop(f"{f}{suffix} level")
                   .withColumn(f"{f}{suffix}", F.coalesce(F.col(f"{f}{suffix}"), F.lit(0.0))))
        added = {}
        for f in self.get("numericCols"):
            rows = numeric.get(f, [])
            at = bin_index(F.nullif(F.col(f).cast("double"), F.lit(float("nan"))), [r.lower for r in rows[1:]])
            woe = F.array(*[F.lit(r.woe) for r in rows]) if rows else F.array(F.lit(0.0))
            added[f"{f}{suffix}"] = F.coalesce(F.try_element_at(woe, at + 1), F.lit(0.0))
        return out.withColumns(added) if added else out

    def woe_columns(self) -> list[str]:
        return [f"{f}{self.get('suffix')}" for f in [*self.get("numericCols"), *self.get("categoricalCols")]]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.bins.write.parquet(f"{path}/bins")
        self.instance.levels.write.parquet(f"{path}/levels")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/levels"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
