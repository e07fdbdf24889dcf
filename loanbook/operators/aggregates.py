"""Portfolio aggregates: KPIs (A1/A2), class balance (A6), model metrics (A9),
selection summary (A11). Every one is a single global or grouped partial
aggregate; nothing row-sized reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.functions.numeric import money_sum, round_half_even, safe_ratio

# --- fixed values: KPI names in report order ---------------------------------
KPI_NAMES = [
    "Total Exposure at Default (EAD)",
    "Total Expected Loss (EL)",
    "Total Expected Revenue",
    "Total Expected Profit",
    "Portfolio Loss Rate (%)",
    "Net Profit Margin (%)",
    "Average Probability of Default",
    "Average Credit Score",
    "Portfolio Yield (%)",
]


def kpi_values(report: DataFrame) -> DataFrame:
    """A1 as one wide row (sums of 2-dp money are exact decimal sums)."""
    t = report.agg(
        money_sum("EAD").alias("ead"), money_sum("Expected_Loss").alias("el"),
        money_sum("Expected_Revenue").alias("rev"), money_sum("Expected_Profit").alias("profit"),
        F.avg("probability_of_default").alias("avg_pd"), F.avg("credit_score").alias("avg_score"),
        F.count(F.lit(1)).alias("n"))
    return t.select(
        round_half_even("ead", 2).alias("v0"), round_half_even("el", 2).alias("v1"),
        round_half_even("rev", 2).alias("v2"), round_half_even("profit", 2).alias("v3"),
        round_half_even(safe_ratio("el", "ead") * 100, 2).alias("v4"),
        round_half_even(safe_ratio("profit", "rev") * 100, 2).alias("v5"),
        round_half_even("avg_pd", 4).alias("v6"),
        round_half_even("avg_score", 0).alias("v7"),
        round_half_even(safe_ratio("rev", "ead") * 100, 2).alias("v8"),
        "n")


def portfolio_kpis(report: DataFrame, empty_ok: bool = True) -> DataFrame:
    """A1/A2: nine KPIs as a long (Metric, Value) table.

    An empty input yields no rows (A2: no selection, no report)."""
    wide = kpi_values(report).filter(F.col("n") > 0)
    stack = ", ".join(f"'{n}', v{i}" for i, n in enumerate(KPI_NAMES))
    return wide.select(F.expr(f"stack({len(KPI_NAMES)}, {stack}) AS (Metric, Value)"))


def class_balance(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """Class counts and the imbalance ratio n0 / n1."""
    t = df.agg(F.count_if(F.col(label) == 0).alias("n_paid"),
               F.count_if(F.col(label) == 1).alias("n_default"))
    return t.withColumn("imbalance", F.col("n_paid") / F.col("n_default"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision = sum over distinct scores (descending) of
    precision at that score x recall gained there.

    Grouped by score first (partial aggregate); the running totals over the
    distinct scores use distributed running sums, since a continuous score
    has about as many distinct values as rows."""
    from loanbook.operators.sampling import running_sums
    g = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("tp"),
                                                   F.count(F.lit(1)).alias("n"))
    g = g.withColumn("neg_s", -F.col("s"))
    r = running_sums(g, ["neg_s"], ["tp", "n"])
    return r.agg((F.sum(F.col("tp") * (F.col("cum_tp") / F.col("cum_n"))) / F.sum("tp"))
                 .alias("average_precision"))


def log_loss(scored: DataFrame, prob: str = "probability", label: str = "label",
             eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return scored.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def mse(scored: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col(pred) - F.col(label), 2)).alias("mse"))


def selection_summary(sel: DataFrame, chosen: str = "selected", profit: str = "Expected_Profit") -> DataFrame:
    """Loans evaluated, loans granted and profit of the granted ones."""
    return sel.agg(F.count(F.lit(1)).alias("evaluated"),
                   F.count_if(F.col(chosen)).alias("granted"),
                   round_half_even(F.sum(F.when(F.col(chosen), F.col(profit)).otherwise(0.0)), 2)
                   .alias("total_profit"))
