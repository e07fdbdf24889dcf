"""Priced loan book with PD and LGD given as columns (no fitted model).

PD: the migration model's 12-step default probability (K3, 4 dp) for
ongoing loans, and the returned-line score (1 + returns) / (2 + lines) for
finished loans (FIXTURES.md). LGD: the K6 rule. From these the pricing
(Q1-Q4), scorecard points (M11) and loss/profit (Q5) follow per loan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.features import term_months
from loanbook.functions.numeric import round_half_even
from loanbook.operators import migration as M
from loanbook.operators import pricing as P


def given_pd(lb: DataFrame, tpm=None) -> DataFrame:
    pdt = M.state_pd_table(lb.sparkSession, tpm).withColumnRenamed("state", "__state")
    d = lb.join(F.broadcast(pdt), M.status_to_state("loan_status") == F.col("__state"), "left")
    sweep = (1 + F.coalesce("inq_last_6mths", F.lit(0.0))) / (2 + F.coalesce("num_tl_op_past_12m", F.lit(0.0)))
    pd = F.when(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL)), sweep) \
          .otherwise(round_half_even("horizon_pd", 4))
    return d.withColumn("pd", pd).drop("__state", "horizon_pd")


def priced_book(lb: DataFrame, tpm=None) -> DataFrame:
    """Per loan: pd, lgd, EAD, term_num, base rate, premium, int_rate."""
    d = given_pd(lb, tpm)
    d = d.withColumn("lgd", M.base_lgd()) \
         .withColumn("EAD", P.ead()) \
         .withColumn("term_num", term_months())
    d = P.base_rate(d)
    return P.final_price(d.drop("int_rate"), "pd")


def risk_report(lb: DataFrame, tpm=None) -> DataFrame:
    """Q5 report: id, probability_of_default, credit_score, LGD_pct, EAD,
    Expected_Loss, Expected_Revenue, Expected_Profit (+ int_rate, term_num)."""
    d = priced_book(lb, tpm).select(
        "id", F.col("pd").alias("probability_of_default"),
        P.score_from_pd("pd").alias("credit_score"),
        F.col("lgd").alias("LGD_pct"), "EAD", "int_rate", "term_num")
    return P.loss_and_profit(d)
