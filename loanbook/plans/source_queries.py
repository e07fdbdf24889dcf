"""Registered source and sink queries (S1-S7), each over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook.functions.numeric import round_half_even
from loanbook.operators import cleaning as CL
from loanbook.operators import filters as FL
from loanbook.operators import migration as M
from loanbook.operators.aggregates import class_balance
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, rint
from loanbook.sources import io as IO
from loanbook.sources.tables import loan_book, read_table, with_loanbook

_S1_COLS = ["id", "loan_amnt", "term", "dti", "issue_d", "loan_status", "purpose"]


@register("s1_csv_scan", with_loanbook(f"SELECT {', '.join(_S1_COLS)} FROM loanbook"))
def s1_csv_scan(spark, d):
    """S6 CSV sink, then S1 scan with the declared schema (+C8, C9 typing)."""
    path = IO.scratch_path(spark, "s1")
    IO.write_table(loan_book(spark, d).select(*_S1_COLS), path, "csv")
    back = IO.read_csv(spark, path, columns=_S1_COLS)
    return CL.parse_dates(CL.clean_id(back), ["issue_d"])


_S1_NAMES = ["id", "loan_amnt", "term", "revol_bal", "fico_range_low", "dti", "issue_d", "loan_status", "purpose", "open_acc"]
_BAD = "CASE WHEN id % 53 = 1 THEN 'short' WHEN id % 53 = 2 THEN 'long' WHEN id % 53 = 3 AND dti IS NOT NULL THEN 'type' ELSE 'fit' END"


@register("s1_quarantine", with_loanbook(
    f"SELECT CAST(id AS VARCHAR) AS id, {_BAD} AS route, "
    f"CASE WHEN {_BAD} = 'fit' THEN total_rev_hi_lim END AS revol_bal, CASE WHEN {_BAD} = 'fit' THEN fico_range_high END AS fico_range_low, "
    f"CASE WHEN {_BAD} = 'fit' THEN num_tl_op_past_12m END AS open_acc FROM loanbook"))
def s1_quarantine(spark, d):
    """A file whose rows are partly cut short, too long or of a wrong type;
    the rows that fit come back typed, the others as their text."""
    lb = loan_book(spark, d)
    bad = F.expr(_BAD)
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "id", "loan_amnt", "term", "total_rev_hi_lim", "fico_range_high", "dti", "issue_d", "loan_status", "purpose", "num_tl_op_past_12m")]
    values[5] = F.when(bad == "type", "n.a.").otherwise(values[5])
    line = F.concat_ws(",", *values)
    line = F.when(bad == "short", F.concat_ws(",", *values[:4])).when(bad == "long", F.concat(line, F.lit(",x,y"))).otherwise(line)
    path = IO.scratch_path(spark, "s1q")
    lb.select(line.alias("value")).write.text(path)
    good, held = IO.read_csv_quarantined(spark, path, names=_S1_NAMES)
    text = F.split(F.col(IO.CORRUPT), ",")
    n = F.size(text)
    why = F.when(n < len(_S1_NAMES), "short").when(n > len(_S1_NAMES), "long").otherwise("type")
    none = F.lit(None).cast("double")
    return good.select("id", F.lit("fit").alias("route"), "revol_bal", "fico_range_low", "open_acc").unionByName(
        held.select(text[0].alias("id"), why.alias("route"), none.alias("revol_bal"), none.alias("fico_range_low"), none.alias("open_acc")))


@register("s2_route_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def s2_route_parquet(spark, d):
    """S2 + S3: suffix routing to the Parquet reader, projected and filtered
    (the filter and the two columns reach the scan)."""
    df = IO.read_any(spark, f"{d.rstrip('/')}/orders.parquet")
    return df.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")


@register("s7_json_report", with_loanbook(
    f"SELECT count(*) FILTER (WHERE lbl = 0) AS n_paid, count(*) FILTER (WHERE lbl = 1) AS n_default, "
    f"count(*) FILTER (WHERE lbl = 0) / count(*) FILTER (WHERE lbl = 1) AS imbalance "
    f"FROM (SELECT {LABEL_CASE} AS lbl FROM loanbook WHERE {FINISHED_IN})"))
def s7_json_report(spark, d):
    """A one-row report written as JSON and read back."""
    report = class_balance(FL.finished(loan_book(spark, d).select("loan_status"), binary=False), "loan_status")
    path = IO.scratch_path(spark, "s7")
    IO.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


_EV = """
ev AS (SELECT user_id AS id, ts, event_id,
              CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
                              WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS state FROM events),
tr AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY id ORDER BY ts, event_id) AS to_state
       FROM ev WHERE state IS NOT NULL),
cnt AS (SELECT from_state, to_state, count(*) AS n FROM tr WHERE to_state IS NOT NULL GROUP BY ALL)
"""


@register("s5_matrix_json", f"WITH {_EV.strip()} SELECT from_state, to_state, "
          f"{rint('n / sum(n) OVER (PARTITION BY from_state)', 12)} AS p FROM cnt")
def s5_matrix_json(spark, d):
    """D1 estimate -> S7 JSON document -> S5 read back as a long table."""
    est = M.estimate_matrix(M.event_states(read_table(spark, d, "events")))
    doc = IO.matrix_json(IO.matrix_from_table(est))  # states x states numbers
    path = IO.scratch_path(spark, "s5")
    spark.createDataFrame([(doc,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
    back = IO.read_matrix(spark, path)
    return back.select("from_state", "to_state", round_half_even("p", 12).alias("p"))
