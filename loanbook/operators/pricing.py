"""Risk-based pricing, loss and profit (Q1-Q7, M11 from a PD, M12).

All per-loan steps are column expressions. The purpose-spread table is a
configuration of a dozen rows: it is applied as a literal map, or, when
read from a JSON config, broadcast after a size check.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.features import term_months
from loanbook.functions.numeric import clip, round_half_even

SCORE_FACTOR = K.SCORE_PDO / math.log(2)
SCORE_OFFSET = K.SCORE_BASE - SCORE_FACTOR * math.log(K.SCORE_BASE_ODDS)


# ------------------------------------------------------------ Q1 / J11
def spread_of(purpose: str | Column = "purpose", spreads: dict | None = None,
              default: float = K.DEFAULT_SPREAD) -> Column:
    p = F.col(purpose) if isinstance(purpose, str) else purpose
    spreads = spreads or K.PURPOSE_SPREADS
    m = F.create_map(*[x for k, v in spreads.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, p), F.lit(default))


def base_rate(df: DataFrame, spreads: dict | DataFrame | None = None,
              fed: float = K.FED_FUNDS_RATE, ops: float = K.OPERATIONAL_COST,
              default: float = K.DEFAULT_SPREAD) -> DataFrame:
    """Q1: base_interest_rate_pct = round((fed + ops + spread[purpose]) x 100, 2).

    ``spreads`` is a dict, or a (purpose, spread) DataFrame read from a JSON
    config of any size (J11: left join, default for unknown)."""
    if isinstance(spreads, DataFrame):
        sp = spreads.select(F.col("purpose").alias("__p"), F.col("spread").alias("__s"))
        d = df.join(sp, df["purpose"] == sp["__p"], "left")
        rate = (F.lit(fed) + F.lit(ops) + F.coalesce("__s", F.lit(default))) * 100
        return d.withColumn("base_interest_rate_pct", round_half_even(rate, 2)).drop("__p", "__s")
    rate = (F.lit(fed) + F.lit(ops) + spread_of("purpose", spreads, default)) * 100
    return df.withColumn("base_interest_rate_pct", round_half_even(rate, 2))


def read_rate_config(spark, path: str) -> tuple[dict, DataFrame]:
    """Rate config JSON -> (macro constants, purpose spread table)."""
    cfg = spark.read.option("multiLine", True).json(path)
    macro = cfg.select("macro_constants.*").first().asDict()
    sp = cfg.select(F.explode(F.from_json(F.to_json("purpose_spreads"), "map<string,double>"))
                    .alias("purpose", "spread"))
    return macro, sp


# ------------------------------------------------------------ Q3 / Q4
def final_price(df: DataFrame, pd: str = "pd", base: str = "base_interest_rate_pct") -> DataFrame:
    """Q3: premium = round(45 pd, 2); int_rate = min(round(base + premium, 2), 35.99)."""
    d = df.withColumn("risk_premium_rate", round_half_even(F.col(pd) * K.RISK_PREMIUM_FACTOR, 2))
    rate = round_half_even(F.col(base) + F.col("risk_premium_rate"), 2)
    return d.withColumn("int_rate", clip(rate, None, K.USURY_CAP))


def ead(loan_amnt: str = "loan_amnt", income: str = "annual_inc") -> Column:
    """Q4: EAD = round(lti_ratio x annual_inc, 2), lti_ratio = loan/(income+1)."""
    lti = F.col(loan_amnt) / (F.col(income) + 1)
    return round_half_even(lti * F.col(income), 2)


# ------------------------------------------------------------ M11 / Q5 / Q6
def score_from_logodds(logodds: Column) -> Column:
    """Scorecard points, round(offset - factor x log-odds of default)."""
    return F.rint(F.lit(SCORE_OFFSET) - F.lit(SCORE_FACTOR) * logodds)


def score_from_pd(pd: str | Column = "pd") -> Column:
    p = F.col(pd) if isinstance(pd, str) else pd
    return score_from_logodds(F.log(p / (1 - p)))


def loss_and_profit(df: DataFrame, pd: str = "probability_of_default", lgd: str = "LGD_pct",
                    ead_col: str = "EAD", rate: str = "int_rate", term: str = "term_num") -> DataFrame:
    """Q5: EL, revenue and profit, each rounded to 2 dp."""
    el = round_half_even(F.col(pd) * F.col(lgd) * F.col(ead_col), 2)
    rev = round_half_even(F.col(ead_col) * (F.col(rate) / 100) * (F.col(term) / 12), 2)
    return (df.withColumn("Expected_Loss", el)
              .withColumn("Expected_Revenue", rev)
              .withColumn("Expected_Profit", round_half_even(F.col("Expected_Revenue") - F.col("Expected_Loss"), 2)))


def rwa_proxy(pd: str = "probability_of_default", ead_col: str = "EAD") -> Column:
    """Q6: EAD x PD x 12.5."""
    return F.col(ead_col) * F.col(pd) * K.RWA_MULTIPLIER


# --- fixed values: committee limit factors (midpoints of the original ranges)
LIMIT_FACTORS = {"rwa": (0.60 + 0.75) / 2, "provision": (0.65 + 0.85) / 2, "cash": (0.50 + 0.70) / 2}


def committee_limits(kpis_wide: DataFrame, factors: dict | None = None) -> DataFrame:
    """Q7: RWA, provision and liquid-cash limits from portfolio totals.

    ``kpis_wide`` has v0 (EAD), v1 (EL), v2 (revenue) as produced by
    :func:`loanbook.operators.aggregates.kpi_values`."""
    f = dict(LIMIT_FACTORS, **(factors or {}))
    return kpis_wide.select(
        round_half_even(F.col("v0") * f["rwa"], 2).alias("RWA_Limit"),
        round_half_even(F.col("v1") * f["provision"], 2).alias("Provision_Limit"),
        round_half_even(F.col("v2") * f["cash"], 2).alias("Liquid_Cash_Limit"))


# ------------------------------------------------------------ M12
def realized_lgd(df: DataFrame) -> DataFrame:
    """Realised LGD of defaulted loans.

    EAD = loan_amnt - total_rec_prncp; net = recoveries - collection fee;
    LGD = 1 - net / EAD if EAD > 0 else 0 (a null EAD fails the test, so 0);
    clipped to [0, 1]; a null net recovery stays null."""
    e = F.col("loan_amnt") - F.col("total_rec_prncp")
    net = F.col("recoveries") - F.col("collection_recovery_fee")
    raw = F.when(e > 0, 1 - net / e).otherwise(F.lit(0.0))
    return df.withColumn("realized_ead", e).withColumn("realized_lgd", clip(raw, 0.0, 1.0))


# ------------------------------------------------------------ D4
def economic_lgd(loans: DataFrame, flows: DataFrame) -> DataFrame:
    """Economic LGD of defaulted loans: id, ead, default_d, n_flows, pv,
    economic_lgd.

    ``loans``: id, ead, default_d (date), rate (effective yearly rate, 0.07 for
    7 %). ``flows``: id, flow_d (date), recovery, cost. LGD = 1 - sum of
    (recovery - cost) / (1 + rate)^t over EAD, t in years of 365 days from the
    default, clipped to [0, 1]; 0 where EAD isn't positive. Flows before the
    default, without a date, or of no loan don't count; a null recovery or cost
    counts as 0; a loan without a flow has pv 0; a null EAD, rate or default
    date gives a null LGD.

    Flows of one day are added up before the join, so a loan with very many
    flows meets it with one row a day. Present values are summed in whole
    millionths, so the sum doesn't depend on the partitioning."""
    net = F.coalesce("recovery", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))
    daily = (flows.where("flow_d IS NOT NULL").groupBy("id", "flow_d")
             .agg(F.sum(F.rint(net * 1_000_000).cast("long")).alias("__net"), F.count(F.lit(1)).alias("__n"))
             .withColumnRenamed("id", "__id"))
    years = F.datediff("flow_d", "default_d") / 365.0
    known = loans.select("id", "ead", "default_d", "rate")
    dated = known.join(daily, (F.col("id") == F.col("__id")) & (F.col("flow_d") >= F.col("default_d")))
    pv = (dated.groupBy(F.col("id").alias("__id"))
          .agg(F.sum(F.rint(F.col("__net") / F.pow(1 + F.col("rate"), years)).cast("long")).alias("__pv"), F.sum("__n").alias("__n")))
    out = known.join(pv, F.col("id") == F.col("__id"), "left")
    value = F.coalesce(F.col("__pv"), F.lit(0)) / 1_000_000
    lgd = F.when(F.col("ead") <= 0, 0.0).otherwise(clip(1 - value / F.col("ead"), 0.0, 1.0))
    lgd = F.when(F.col("ead").isNotNull() & F.col("rate").isNotNull() & F.col("default_d").isNotNull(), lgd)
    return out.select("id", "ead", "default_d", F.coalesce("__n", F.lit(0)).alias("n_flows"), value.alias("pv"), lgd.alias("economic_lgd"))


def exposure_weighted_lgd(lgd: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: loans, exposure and the LGD weighted by exposure
    (loans of positive exposure and known LGD)."""
    d = lgd.where("ead > 0 AND economic_lgd IS NOT NULL")
    whole = F.sum(F.rint(F.col("ead") * F.col("economic_lgd") * 10_000).cast("long")) / 10_000
    ead_ = F.sum(F.rint(F.col("ead") * 10_000).cast("long")) / 10_000
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n_loans"), ead_.alias("exposure"), (whole / ead_).alias("weighted_lgd"))


__all__ = ["base_rate", "final_price", "ead", "loss_and_profit", "rwa_proxy",
           "committee_limits", "score_from_pd", "score_from_logodds", "realized_lgd",
           "economic_lgd", "exposure_weighted_lgd", "term_months", "SCORE_FACTOR", "SCORE_OFFSET", "read_rate_config"]
