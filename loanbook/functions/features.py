"""Engineered loan features X1-X8 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K


def term_months(term: str = "term", default: float | None = K.DEFAULT_TERM_MONTHS) -> Column:
    """First digit run of the term text as a number; numeric terms pass
    through; null (or no digits) becomes ``default`` (pricing rule)."""
    digits = F.regexp_extract(F.col(term).cast("string"), r"(\d+)", 1)
    v = F.when(digits == "", F.lit(None)).otherwise(digits).try_cast("double")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def engineer(df: DataFrame, fill_credit_date: bool = True, drop_sources: bool = True) -> DataFrame:
    """X1-X8. ``fill_credit_date`` is the pricing rule (bad date -> 2010-01-01);
    the PD flow leaves credit age null for a missing date."""
    cr = F.col("earliest_cr_line").cast("date")
    if fill_credit_date:
        cr = F.coalesce(cr, F.lit(K.CREDIT_AGE_FALLBACK).cast("date"))
    d = df.select(
        "*",
        (F.col("loan_amnt") / (F.col("annual_inc") + 1)).alias("lti_ratio"),
        (F.datediff(F.lit(K.CREDIT_AGE_REFERENCE).cast("date"), cr) / 365.25).alias("credit_age_years"),
        (F.col("avg_cur_bal") / (F.col("total_rev_hi_lim") + 1)).alias("total_utilization"),
        (F.col("inq_last_6mths") + F.col("num_tl_op_past_12m")).alias("credit_hunger"),
        term_months().alias("term_num"),
    )
    d = d.withColumn("monthly_installment_ratio",
                     (F.col("loan_amnt") / F.col("term_num")) / (F.col("annual_inc") / 12 + 1))
    if "bc_util" in d.columns and "bc_open_to_buy" in d.columns:
        d = d.withColumn("bc_util_to_open_ratio", F.col("bc_util") / (F.col("bc_open_to_buy") + 1))
    if drop_sources:  # X8
        d = d.drop(*[c for c in K.FEATURE_DROP_COLUMNS if c in d.columns])
    return d
