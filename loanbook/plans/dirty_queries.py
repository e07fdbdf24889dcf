"""Cleaning rules on a dirty loan book: every rule has rows to act on.

The dirty book is the loan book with faults put in by rules on the loan id,
as one set of SQL expressions that Spark and the twin share: repeated rows, rows
that are nearly empty, a column that mostly is, blanks, placeholders, edge
commas, minus signs, infinities, NaN and ids that are no numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.operators import capital as C
from loanbook.operators import cleaning as CL
from loanbook.operators import filters as FL
from loanbook.operators import migration as M
from loanbook.operators import sampling as S
from loanbook.plans.catalog import register
from loanbook.plans.cleaning_queries import s_null_policy, s_sanitize_number, s_sanitize_string
from loanbook.plans.sqlfrag import ONGOING_IN, clip_sql, rint
from loanbook.sources.tables import LOANBOOK_COLUMNS, LOANBOOK_TYPES, loan_book, with_loanbook

#: column -> faulty value by the loan's id (text valid in both dialects)
FAULTS = {
    "id": "CASE WHEN id % 31 = 0 THEN 'no-' || id WHEN id % 31 = 1 THEN id || '.0' WHEN id % 31 = 2 THEN NULL ELSE '' || id END",
    "purpose": "CASE WHEN id % 7 = 0 THEN '  ? ' WHEN id % 7 = 1 THEN ',,car, ' WHEN id % 7 = 2 THEN ' nan' ELSE purpose END",
    "title": "CASE WHEN id % 5 = 0 THEN '   ' WHEN id % 5 = 1 THEN '' ELSE title END",
    "addr_state": "CASE WHEN id % 41 = 0 THEN NULL WHEN id % 41 = 1 THEN 'n/a' ELSE addr_state END",
    "zip_code": "CASE WHEN id % 43 = 0 THEN ',' ELSE zip_code END",
    "dti": "CASE WHEN id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN id % 13 = 1 THEN -1 WHEN id % 13 = 2 THEN -0.5 ELSE dti END",
    "annual_inc": "CASE WHEN id % 47 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE annual_inc END",
    "loan_amnt": "CASE WHEN id % 53 = 0 THEN -1 ELSE loan_amnt END",
    "fico_range_high": "CASE WHEN id % 17 = 0 THEN NULL ELSE fico_range_high END",
    "bc_util": "CASE WHEN id % 3 > 0 THEN NULL ELSE bc_util END",
    "total_rev_hi_lim": "CASE WHEN id % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE total_rev_hi_lim END",
    "bc_open_to_buy": "CASE WHEN id % 59 = 0 THEN NULL ELSE bc_open_to_buy END",
    "issue_d": "CASE WHEN id % 61 = 0 THEN NULL ELSE issue_d END",
}
_COLS = [c for c, _ in LOANBOOK_COLUMNS]
_TYPES = {**LOANBOOK_TYPES, "id": "VARCHAR"}
_STR = [c for c in _COLS if _TYPES[c] == "VARCHAR"]
_FLOAT = [c for c in _COLS if _TYPES[c] == "DOUBLE"]


def _fault(c: str) -> str:
    """A nearly empty row keeps its id and status only."""
    e = FAULTS.get(c, c)
    return f"{e} AS {c}" if c in ("id", "loan_status") else f"CASE WHEN id % 37 = 0 THEN NULL ELSE {e} END AS {c}"


_SELECT = ", ".join(_fault(c) for c in _COLS)
# every tenth loan stands twice
_DIRTY = f"dirty0 AS (SELECT {_SELECT}, id % 10 AS tenth FROM loanbook),\n" + (
    f"dirty AS (SELECT {', '.join(_COLS)} FROM dirty0 UNION ALL SELECT {', '.join(_COLS)} FROM dirty0 WHERE tenth = 0)")
_NAN = "nan AS (SELECT " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c in _FLOAT else c for c in _COLS) + " FROM dirty)"
_FINITE = "fin AS (SELECT " + ", ".join(f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END AS {c}" if c in _FLOAT else c for c in _COLS) + " FROM nan)"


def dirty_book(spark, d):
    book = loan_book(spark, d).select(*_COLS)
    faulty = book.selectExpr(*[_fault(c) for c in _COLS], "id % 10 AS tenth")
    return faulty.drop("tenth").unionByName(faulty.where("tenth = 0").drop("tenth"))


def _finite(spark, d):
    return CL.infinities_to_null(CL.normalise_nan(dirty_book(spark, d)))


def dirty_sql(sql: str, *ctes: str) -> str:
    return with_loanbook(sql, ",\n".join([_DIRTY, _NAN, _FINITE, *ctes]))


_DATES = [c for c in _COLS if _TYPES[c] == "DATE"]


def _shown(cols) -> str:
    """Dates as text: some are missing here."""
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in _DATES else c for c in cols)


def _text_dates(df):
    return df.withColumns({c: F.col(c).cast("string") for c in _DATES})


# ------------------------------------------------------------ C1 - C4, C17
@register("c1_dirty", dirty_sql(f"SELECT DISTINCT {_shown(_COLS)} FROM fin"))
def c1_dirty(spark, d):
    """C1 over all columns: repeated rows go."""
    return _text_dates(CL.drop_duplicate_rows(_finite(spark, d)))


_FULL = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in _COLS)
_THRESH = int(len(_COLS) * K.ROW_NULL_THRESHOLD)


@register("c2_dirty", dirty_sql(f"SELECT {_shown(_COLS)} FROM fin WHERE {_FULL} >= {_THRESH}"))
def c2_dirty(spark, d):
    """C2 over all columns: nearly empty rows go."""
    return _text_dates(CL.drop_sparse_rows(_finite(spark, d)))


_KEPT3 = [c for c in _COLS if c != "bc_util"]


@register("c3_dirty", dirty_sql(f"SELECT {_shown(_KEPT3)} FROM fin"))
def c3_dirty(spark, d):
    """C3 itself: the mostly empty column goes, the crucial ones stay."""
    return _text_dates(CL.drop_sparse_columns(_finite(spark, d)))


@register("c4_rejects", dirty_sql(
    "SELECT 'no rows' AS input, 'empty table: no rows received' AS outcome UNION ALL "
    "SELECT 'no values', CASE WHEN (SELECT count(*) FROM fin WHERE id IS NULL) > 0 THEN 'table contains only null values' ELSE 'empty table: no rows received' END "
    "UNION ALL SELECT 'values', CAST((SELECT count(*) FROM fin) AS VARCHAR) || ' rows'"))
def c4_rejects(spark, d):
    """C4 on a table without rows, one without values (the missing ids) and the whole."""
    book = _finite(spark, d)
    cases = {"no rows": book.where("id = 'nobody'"), "no values": book.where("id IS NULL").select("id"), "values": book}
    out = []
    for name, df in cases.items():
        try:
            out.append((name, f"{CL.require_data(df).count()} rows"))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "input STRING, outcome STRING")


@register("c17_dirty", dirty_sql("SELECT id, dti, annual_inc, total_rev_hi_lim FROM fin"))
def c17_dirty(spark, d):
    """C17 (after the NaN rule): both infinities become null."""
    return _finite(spark, d).select("id", "dti", "annual_inc", "total_rev_hi_lim")


# ------------------------------------------------------------ C6, C7, C8, C13
@register("c6_dirty", dirty_sql("SELECT " + ", ".join(f"{s_sanitize_string(c)} AS {c}" for c in _STR) + " FROM dirty"))
def c6_dirty(spark, d):
    """Spaces, edge commas and placeholders."""
    return CL.sanitize_strings(dirty_book(spark, d).select(*_STR))


@register("c7_dirty", dirty_sql(f"SELECT id, {s_sanitize_number('dti', True)} AS dti, {s_sanitize_number('loan_amnt', False)} AS loan_amnt, "
                                f"{s_sanitize_number('avg_cur_bal', False)} AS avg_cur_bal FROM fin"))
def c7_dirty(spark, d):
    """-1 is missing everywhere, other negatives but in exempt columns."""
    return CL.sanitize_numbers(_finite(spark, d).select("id", "dti", "loan_amnt", "avg_cur_bal"))


@register("c8_dirty", dirty_sql(
    "SELECT rule, id, count(*) AS n FROM (SELECT 'zero' AS rule, coalesce(TRY_CAST(TRY_CAST(id AS DOUBLE) AS BIGINT), CAST(0 AS BIGINT)) AS id FROM dirty "
    "UNION ALL SELECT 'drop', TRY_CAST(TRY_CAST(id AS DOUBLE) AS BIGINT) FROM dirty WHERE TRY_CAST(id AS DOUBLE) IS NOT NULL) GROUP BY ALL"))
def c8_dirty(spark, d):
    """Ids that are no numbers become 0, or go."""
    ids = dirty_book(spark, d).select("id")
    both = CL.clean_id(ids).select(F.lit("zero").alias("rule"), "id").unionByName(CL.clean_id(ids, "drop").select(F.lit("drop").alias("rule"), "id"))
    return both.groupBy("rule", "id").agg(F.count(F.lit(1)).alias("n"))


@register("c13_dirty", dirty_sql("SELECT " + ", ".join(
    f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN NULL ELSE {c} END AS {c}" for c in _STR) + " FROM dirty"))
def c13_dirty(spark, d):
    """Empty and blank strings."""
    return CL.blanks_to_null(dirty_book(spark, d).select(*_STR))


# ------------------------------------------------------------ C11
def _c11(c: str) -> str:
    if c == "id":
        return f"coalesce(TRY_CAST(TRY_CAST({s_sanitize_string('id')} AS DOUBLE) AS BIGINT), CAST(0 AS BIGINT)) AS id"
    if _TYPES[c] == "VARCHAR":
        e = s_sanitize_string(c)
        return f"trim(regexp_replace({e}, '\\s+', ' ', 'g')) AS term" if c == "term" else f"{e} AS {c}"
    if _TYPES[c] == "DOUBLE":
        return f"{s_sanitize_number(c, c in K.NEGATIVE_EXEMPT)} AS {c}"
    return _shown([c])


_STEP = (f"once AS (SELECT DISTINCT * FROM fin),\nfull_ AS (SELECT * FROM once WHERE {_FULL} >= {_THRESH})")


@register("c11_dirty", dirty_sql(f"SELECT {', '.join(_c11(c) for c in _KEPT3)} FROM full_", _STEP))
def c11_dirty(spark, d):
    """C11: C1, C2, C3 and the value rules, all with work to do."""
    return _text_dates(CL.clean_accepted(_finite(spark, d)))


# ------------------------------------------------------------ C14, C16
_C14 = ["id", "loan_amnt", "annual_inc", "dti", "total_rev_hi_lim", "bc_open_to_buy", "fico_range_high", "home_ownership", "addr_state"]
_C14_CTES, _C14_LAST = s_null_policy("c14in", ["home_ownership", "addr_state"],
                                     [(c, "DOUBLE") for c in _C14 if _TYPES[c] == "DOUBLE"], K.MISSING_CRUCIAL)


@register("c14_dirty", dirty_sql(f"SELECT * FROM {_C14_LAST}", f"c14in AS (SELECT {', '.join(_C14)} FROM fin)", _C14_CTES))
def c14_dirty(spark, d):
    """C14: dropped strings, dropped crucial numbers, dropped frequent and filled rare nulls."""
    return CL.handle_missing(_finite(spark, d).select(*_C14))


_RV = K.REVIEW_FEATURES


@register("c16_dirty", dirty_sql(
    "SELECT loan_amnt, emp_length, coalesce(yr, (SELECT median(yr) FROM rv)) AS issue_d, title, zip_code, addr_state, "
    "coalesce(CASE WHEN dti IS NULL THEN NULL ELSE least(dti, (SELECT cap FROM st)) END, (SELECT med FROM st)) AS dti, "
    "coalesce(fico_range_high, CAST(-1 AS DOUBLE)) AS fico_range_high, policy_code FROM rv",
    f"rv AS (SELECT *, CAST(year(issue_d) AS DOUBLE) AS yr FROM (SELECT DISTINCT {', '.join(_RV)} FROM fin))",
    "st0 AS (SELECT quantile_cont(dti, 0.99) AS cap FROM rv)",
    "st AS (SELECT cap, (SELECT median(CASE WHEN dti IS NULL THEN NULL ELSE least(dti, cap) END) FROM rv) AS med FROM st0)"))
def c16_dirty(spark, d):
    """Repeated rows, missing years, debt ratios and scores."""
    return CL.review_clean(_finite(spark, d).select(*_RV))[0]


# ------------------------------------------------------------ C19, C21 on repeated ids
# every third ongoing loan stands three times: as it is, with half the balance, and with none
_REP = (f"rep AS (SELECT id, loan_status, out_prncp * f AS out_prncp, funded_amnt, recoveries * 40 * f AS recoveries, total_rec_prncp, total_pymnt, int_rate, installment, purpose "
        f"FROM (SELECT * FROM loanbook WHERE {ONGOING_IN}), (SELECT unnest([1.0, 0.5, NULL]) AS f) WHERE f = 1 OR id % 3 = 0)")


def _repeated(spark, d):
    ong = FL.ongoing(loan_book(spark, d)).select("id", "loan_status", "out_prncp", "funded_amnt", "recoveries", "total_rec_prncp",
                                                 "total_pymnt", "int_rate", "installment", "purpose")
    f = F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.5), F.lit(None).cast("double"))).otherwise(F.array(F.lit(1.0))))
    r = ong.withColumn("f", f)
    return r.withColumn("out_prncp", F.col("out_prncp") * F.col("f")).withColumn("recoveries", F.col("recoveries") * 40 * F.col("f")).drop("f")


@register("c19_repeated", with_loanbook(
    f"SELECT id, out_prncp, greatest({rint('out_prncp', 2)}, 0) AS provision_needed FROM "
    "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY out_prncp DESC) AS k FROM rep WHERE out_prncp IS NOT NULL) WHERE k = 1", _REP))
def c19_repeated(spark, d):
    """Of repeated ids the highest balance stays; rows without one go."""
    return M.clean_action_data(_repeated(spark, d)).select("id", "out_prncp", "provision_needed")


@register("c21_repeated", with_loanbook(
    f"SELECT id, out_prncp, {clip_sql('recoveries', 0.0, None)} AS recoveries FROM (SELECT id, coalesce(out_prncp, 0) AS out_prncp, "
    "CASE WHEN coalesce(recoveries, 0) > funded_amnt THEN funded_amnt ELSE coalesce(recoveries, 0) END AS recoveries, "
    "row_number() OVER (PARTITION BY id ORDER BY coalesce(out_prncp, 0) DESC, coalesce(recoveries, 0) DESC) AS k FROM rep WHERE funded_amnt > 0) WHERE k = 1", _REP))
def c21_repeated(spark, d):
    """Recoveries capped at the funded amount, the highest balance of an id stays."""
    book = _repeated(spark, d).withColumn("current_state", M.status_to_state("loan_status"))
    return C.clean(book).select("id", "out_prncp", "recoveries")


# ------------------------------------------------------------ F5, P4, P5
@register("f5_routes", with_loanbook(
    "SELECT 'all columns' AS input, 'train' AS route, 10 AS n_columns, count(*) AS n FROM loanbook UNION ALL "
    "SELECT 'nine features', 'score', 9, count(*) FROM loanbook UNION ALL SELECT 'other shape', 'score', 3, count(*) FROM loanbook UNION ALL "
    "SELECT 'forced score', 'score', 9, count(*) FROM loanbook"))
def f5_routes(spark, d):
    """every route on the loan book cut to its shape."""
    lb = loan_book(spark, d)
    inputs = {"all columns": (lb, None), "nine features": (lb.select(*_RV), None), "other shape": (lb.select("id", "dti", "title", "addr_state"), None),
              "forced score": (lb, "score")}
    out = None
    for name, (df, mode) in inputs.items():
        route, cut = FL.review_route(df, mode)
        one = cut.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("input"), F.lit(route).alias("route"),
                                                           F.lit(len(cut.columns)).alias("n_columns"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_H = S.draw_hash_sql(["id"], K.TRAIN_SEED)
_ONG = f"ong AS (SELECT id, loan_status, out_prncp FROM loanbook WHERE {ONGOING_IN})"


@register("p4_binding", with_loanbook(
    f"SELECT id, loan_status FROM (SELECT *, row_number() OVER (PARTITION BY loan_status ORDER BY {_H}, id) AS k FROM ong) WHERE k <= 200", _ONG))
def p4_binding(spark, d):
    """P4 with a cap below the strata."""
    return S.stratified_cap(FL.ongoing(loan_book(spark, d)).select("id", "loan_status"), "loan_status", 200, ["id"], K.TRAIN_SEED)


@register("p5_binding", with_loanbook(
    f"SELECT id, loan_status FROM (SELECT *, row_number() OVER (ORDER BY {_H}, id) AS k FROM ong) WHERE k <= 300", _ONG))
def p5_binding(spark, d):
    """P5 with a cap below the table."""
    return S.sample_n(FL.ongoing(loan_book(spark, d)).select("id", "loan_status"), 300, ["id"], K.TRAIN_SEED)
