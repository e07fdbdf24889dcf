"""Initial review: decisions (M10), threshold sweep (A3), nearest threshold (A4).

The sweep never forms loans x thresholds: each loan's threshold index is
computed once (how many thresholds are <= its score), one grouped count by
(index, label) gives at most 2 x (points + 1) rows, and running sums over
that tiny table give every threshold's confusion counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.numeric import round_half_even


def thresholds(points: int = K.THRESHOLD_POINTS) -> list[float]:
    """The evenly spaced grid on [0, 1] (numpy's linspace doubles)."""
    return [float(x) for x in np.linspace(0, 1, points)]


def decide(df: DataFrame, prob: str = "probability", threshold: float = 0.5,
           out: str = "initial_prediction") -> DataFrame:
    """Reject (1) when the default probability is >= threshold."""
    return df.withColumn(out, (F.col(prob) >= F.lit(threshold)).cast("int"))


def threshold_index(prob: str | Column, grid: list[float]) -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    arr = F.array(*[F.lit(t) for t in grid])
    return F.size(F.filter(arr, lambda t: t <= p))


def strategy_table(scored: DataFrame, prob: str = "probability", label: str = "loan_status",
                   points: int = K.THRESHOLD_POINTS) -> DataFrame:
    """A3: per threshold: approval %, FP/FN/TP/TN counts, FP/FN % of total."""
    grid = thresholds(points)
    spark = scored.sparkSession
    counts = scored.groupBy(threshold_index(prob, grid).alias("idx")).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    # zero-filled counts for every index 0..points (equi-join on the grid)
    idx_df = spark.range(points + 1).select(F.col("id").cast("int").alias("idx"))
    full = idx_df.join(counts, "idx", "left").fillna(0, ["n0", "n1"])
    # predicted 1 at threshold j  <=>  idx > j: suffix sums over idx (<= points+1 rows)
    w = Window.orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy()  # the whole (<= points+1 row) count table
    suf = full.withColumn("tp", F.sum("n1").over(w).cast("long")) \
              .withColumn("fp", F.sum("n0").over(w).cast("long")) \
              .withColumn("p1", F.sum("n1").over(allw).cast("long")) \
              .withColumn("p0", F.sum("n0").over(allw).cast("long"))
    grid_df = spark.createDataFrame([(j + 1, t) for j, t in enumerate(grid)], "idx INT, t DOUBLE")
    out = grid_df.join(suf.select("idx", "tp", "fp", "p0", "p1"), "idx", "inner")
    out = out.withColumn("fn", F.col("p1") - F.col("tp")).withColumn("tn", F.col("p0") - F.col("fp")) \
             .withColumn("n", (F.col("p0") + F.col("p1")).cast("double"))
    n = F.col("n")
    return out.select(
        round_half_even("t", 4).alias("Threshold"),
        round_half_even((F.col("tn") + F.col("fn")) / n * 100, 2).alias("Approval %"),
        F.col("fp").alias("FP Count"), F.col("fn").alias("FN Count"),
        round_half_even(F.col("fp") / n * 100, 2).alias("FP % of Total"),
        round_half_even(F.col("fn") / n * 100, 2).alias("FN % of Total"),
        F.col("tp").alias("TP Count"), F.col("tn").alias("TN Count"))


def nearest_threshold(table: DataFrame, request: float = 0.5) -> DataFrame:
    """A4: the strategy row nearest to ``request`` (smaller threshold on ties)."""
    key = F.struct(F.abs(F.col("Threshold") - F.lit(request)).alias("d"), F.col("Threshold").alias("t"))
    row = table.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in table.columns]), key).alias("r"))
    return row.select(F.col("r.Threshold").alias("threshold_used"),
                      F.col("r.`Approval %`").alias("approval"),
                      F.col("r.`FP % of Total`").alias("fp"),
                      F.col("r.`FN % of Total`").alias("fn"))
