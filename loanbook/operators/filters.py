"""Filters, projections and schema routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K


def label_of(status: str = "loan_status") -> Column:
    """finished status string to 0 (paid) / 1 (default), else null."""
    c = F.col(status).cast("string")
    out = F.lit(None).cast("int")
    for s, v in reversed(list(K.FINISHED_STATUS_LABEL.items())):
        out = F.when(c == s, F.lit(v)).otherwise(out)
    return out


def is_binary_label(df: DataFrame, status: str = "loan_status") -> bool:
    """true when every non-null status is already 0/1 (one aggregate)."""
    c = F.col(status).cast("string")
    ok = df.agg(F.bool_and(F.coalesce(c.isin("0", "1", "0.0", "1.0"), F.lit(True))).alias("b")).first().b
    return bool(ok) if ok is not None else True


def finished(df: DataFrame, status: str = "loan_status", binary: bool | None = None) -> DataFrame:
    """F1 (+F6): finished loans with a 0/1 label in ``loan_status``.

    An already-binary label keeps every row (the rule used by the PD flow
    everywhere, see SURVEY 2.3)."""
    if binary is None:
        binary = is_binary_label(df, status)
    if binary:
        return df.withColumn(status, F.col(status).cast("double").cast("int"))
    return df.filter(F.col(status).isin(list(K.FINISHED_STATUS_LABEL))) \
             .withColumn(status, label_of(status))


def ongoing(df: DataFrame, status: str = "loan_status") -> DataFrame:
    """keep ongoing loans."""
    return df.filter(F.col(status).isin(K.ONGOING_STATUSES))


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """select the listed columns that exist, in list order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def approved(applications: DataFrame, decisions: DataFrame, key: str = "application_id") -> DataFrame:
    """applications whose review decision is 0 (approve), by key."""
    ok = decisions.filter(F.col("initial_prediction") == 0).select(key)
    return applications.join(ok, key, "left_semi")


def drop_rate(df: DataFrame) -> DataFrame:
    """F8: remove ``int_rate`` before pricing."""
    return df.drop("int_rate")


def ids_first(df: DataFrame, first: list[str] | None = None) -> DataFrame:
    """move id/priority columns first."""
    first = [c for c in (first or ["id"]) if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def defaulted(df: DataFrame, status: str = "loan_status") -> DataFrame:
    """defaulted loans only."""
    return df.filter(F.col(status).cast("string").isin(K.DEFAULTED_STATUSES))


def route(df: DataFrame, mode: str | None = None) -> str:
    """'train' when ``loan_status`` is present, else 'score'.
    An explicit ``mode`` wins. Decided from the schema, no job."""
    if mode:
        return mode
    return "train" if "loan_status" in df.columns else "score"


def review_route(df: DataFrame, mode: str | None = None) -> tuple[str, DataFrame]:
    """F5 for the initial review: more than 9 columns trains, exactly the 9
    master features scores; any other shape keeps the master columns that
    exist (label dropped)."""
    if mode == "train" or (mode is None and len(df.columns) > 9 and "loan_status" in df.columns):
        return "train", select_existing(df, K.REVIEW_FEATURES + ["loan_status"])
    if mode == "score" or len(df.columns) == 9:
        return "score", select_existing(df, K.REVIEW_FEATURES)
    return "score", select_existing(df, K.REVIEW_FEATURES)
