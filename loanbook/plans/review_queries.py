"""Registered review and encoder queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.operators import encoding as EN
from loanbook.operators import filters as FL
from loanbook.operators import review as RV
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, dbl, q, rint
from loanbook.sources.tables import loan_book, with_loanbook

SCORE_SQL = "(1 + coalesce(inq_last_6mths, 0)) / (2 + coalesce(num_tl_op_past_12m, 0))"


def sweep_score():
    return (1 + F.coalesce("inq_last_6mths", F.lit(0.0))) / (2 + F.coalesce("num_tl_op_past_12m", F.lit(0.0)))


def _scored(spark, d):
    """Finished loans with their 0/1 label and the sweep score as probability."""
    lb = loan_book(spark, d)
    fin = FL.finished(lb.select("id", "loan_status", "inq_last_6mths", "num_tl_op_past_12m"), binary=False)
    return fin.select("id", "loan_status", sweep_score().alias("probability"))


_GRID = RV.thresholds()
_GRID_SQL = "(VALUES " + ", ".join(f"({dbl(t)})" for t in _GRID) + ") AS g(t)"
_SC_CTE = f"sc AS (SELECT id, {LABEL_CASE} AS loan_status, {SCORE_SQL} AS probability FROM loanbook WHERE {FINISHED_IN})"
_A3_BODY = (
    f"SELECT {rint('t', 4)} AS \"Threshold\", "
    f"{rint('(tn + fn) / n * 100', 2)} AS \"Approval %\", fp AS \"FP Count\", fn AS \"FN Count\", "
    f"{rint('fp / n * 100', 2)} AS \"FP % of Total\", {rint('fn / n * 100', 2)} AS \"FN % of Total\", "
    f"tp AS \"TP Count\", tn AS \"TN Count\" FROM st")
_A3_CTES = (f"{_SC_CTE},\n"
            f"st AS (SELECT g.t, count(*) FILTER (WHERE s.probability >= g.t AND s.loan_status = 1) AS tp, "
            f"count(*) FILTER (WHERE s.probability >= g.t AND s.loan_status = 0) AS fp, "
            f"count(*) FILTER (WHERE s.probability < g.t AND s.loan_status = 1) AS fn, "
            f"count(*) FILTER (WHERE s.probability < g.t AND s.loan_status = 0) AS tn, count(*) AS n "
            f"FROM {_GRID_SQL}, sc s GROUP BY g.t)")


@register("a3_sweep", with_loanbook(_A3_BODY, _A3_CTES))
def a3_sweep(spark, d):
    return RV.strategy_table(_scored(spark, d))


@register("a4_nearest", with_loanbook(
    "SELECT \"Threshold\" AS threshold_used, \"Approval %\" AS approval, \"FP % of Total\" AS fp, "
    "\"FN % of Total\" AS fn FROM tbl ORDER BY abs(\"Threshold\" - 0.5), \"Threshold\" LIMIT 1",
    _A3_CTES + f",\ntbl AS ({_A3_BODY})"))
def a4_nearest(spark, d):
    return RV.nearest_threshold(RV.strategy_table(_scored(spark, d)), 0.5)


_DEC_CTE = (f"dec AS (SELECT id AS application_id, {SCORE_SQL} AS probability, "
            f"CAST({SCORE_SQL} >= {dbl(0.5)} AS INTEGER) AS initial_prediction FROM loanbook)")


def _decisions(spark, d):
    lb = loan_book(spark, d)
    return RV.decide(lb.select(F.col("id").alias("application_id"), sweep_score().alias("probability")),
                     "probability", 0.5)


@register("m10_decide", with_loanbook("SELECT * FROM dec", _DEC_CTE))
def m10_decide(spark, d):
    return _decisions(spark, d)


@register("f7_approved", with_loanbook(
    "SELECT id AS application_id, loan_amnt, purpose FROM loanbook WHERE id IN "
    "(SELECT application_id FROM dec WHERE initial_prediction = 0)", _DEC_CTE))
def f7_approved(spark, d):
    apps = loan_book(spark, d).select(F.col("id").alias("application_id"), "loan_amnt", "purpose")
    return FL.approved(apps, _decisions(spark, d))


_M1_COLS = K.REVIEW_CATEGORICAL


def _m1_sql() -> str:
    dict_ctes = ",\n".join(
        f"d_{c} AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS code FROM "
        f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS cat FROM tr))" for c in _M1_COLS)
    sel = ", ".join(f"coalesce(d_{c}.code, -1) AS {c}" for c in _M1_COLS)
    joins = " ".join(f"LEFT JOIN d_{c} ON coalesce(CAST(s.{c} AS VARCHAR), 'nan') = d_{c}.cat" for c in _M1_COLS)
    return with_loanbook(f"SELECT s.id, {sel} FROM loanbook s {joins}",
                         f"tr AS (SELECT * FROM loanbook WHERE {FINISHED_IN}),\n{dict_ctes}")


@register("m1_ordinal", _m1_sql())
def m1_ordinal(spark, d):
    """M1: dictionaries fitted on finished loans, applied to every loan."""
    lb = loan_book(spark, d)
    train = lb.filter(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL)))
    dic = EN.fit_ordinal(train, _M1_COLS)
    return EN.apply_ordinal(lb.select("id", *_M1_COLS), dic, _M1_COLS)


_M2_COLS = K.LGD_CATEGORICAL


def _m2_sql() -> str:
    cats = " UNION ".join(f"SELECT {q(c)} AS feature, CAST({c} AS VARCHAR) AS category FROM tr WHERE {c} IS NOT NULL" for c in _M2_COLS)
    rows = " UNION ALL ".join(f"SELECT id, {q(c)} AS feature, CAST({c} AS VARCHAR) AS category FROM loanbook" for c in _M2_COLS)
    return with_loanbook(
        "SELECT r.id, (SELECT count(*) FROM lv) AS size, string_agg(CAST(lv.index AS VARCHAR), ',' ORDER BY lv.index) AS nonzero, "
        "count(lv.index) AS n_nonzero FROM rw r LEFT JOIN lv USING (feature, category) GROUP BY r.id",
        f"tr AS (SELECT * FROM loanbook WHERE {FINISHED_IN}),\ncats AS ({cats}),\n"
        "lv AS (SELECT feature, category, row_number() OVER (ORDER BY feature, category) - 1 AS index FROM cats "
        f"WHERE (feature, category) NOT IN (SELECT feature, min(category) FROM cats GROUP BY feature)),\nrw AS ({rows})")


@register("m2_onehot", _m2_sql())
def m2_onehot(spark, d):
    """M2: one sparse vector a loan, baseline left out; its non-zeros listed."""
    lb = loan_book(spark, d)
    train = lb.filter(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL)))
    out = EN.apply_onehot(lb.select("id", *_M2_COLS), EN.fit_onehot(train, _M2_COLS), _M2_COLS)
    dense = vector_to_array("onehot")
    at = F.filter(F.transform(dense, lambda x, i: F.when(x == 1.0, i)), lambda i: i.isNotNull())
    return out.select("id", F.size(dense).cast("long").alias("size"),
                      F.when(F.size(at) > 0, F.concat_ws(",", at.cast("array<string>"))).alias("nonzero"), F.size(at).cast("long").alias("n_nonzero"))
