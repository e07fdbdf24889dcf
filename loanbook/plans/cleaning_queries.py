"""Registered cleaning, filter and feature queries (C1-C17, F1-F10, X, A6-A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions import features as X
from loanbook.functions.numeric import round_half_even
from loanbook.operators import cleaning as CL
from loanbook.operators import filters as FL
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, dbl, in_list, rint
from loanbook.sources.tables import LOANBOOK_COLUMNS, LOANBOOK_TYPES, loan_book, with_loanbook

LB_COLS = [c for c, _ in LOANBOOK_COLUMNS]
LB_STR = [c for c, t in LOANBOOK_COLUMNS if t == "VARCHAR"]
LB_NUM = [c for c, t in LOANBOOK_COLUMNS if t in ("DOUBLE", "BIGINT")]


def _lb(spark, d):
    return loan_book(spark, d)


# ------------------------------------------------------------ SQL renderers
def s_sanitize_string(c: str) -> str:
    s1 = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    s2 = f"regexp_replace({s1}, '^,+|,+$', '', 'g')"
    return f"(CASE WHEN {s2} IN {in_list(K.STRING_PLACEHOLDERS)} THEN NULL ELSE {s2} END)"


def s_sanitize_number(c: str, exempt: bool) -> str:
    bad = f"{c} = -1" if exempt else f"({c} = -1 OR {c} < 0)"
    return f"(CASE WHEN {bad} THEN NULL ELSE {c} END)"


def s_sanitized_select(cols=LB_COLS, types=LOANBOOK_TYPES) -> str:
    out = []
    for c in cols:
        t = types[c]
        if t == "VARCHAR":
            e = s_sanitize_string(c)
            if c == "term":
                e = f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
        elif t in ("DOUBLE", "BIGINT"):
            e = s_sanitize_number(c, c in K.NEGATIVE_EXEMPT)
            if c == "id":
                e = f"coalesce({e}, CAST(0 AS BIGINT))"
        else:
            e = c
        out.append(f"{e} AS {c}")
    return ", ".join(out)


def s_null_policy(src: str, str_cols: list[str], num_cols: list[tuple[str, str]],
                  crucial: list[str], drop_share: float = K.MISSING_DROP_SHARE,
                  prefix: str = "np") -> tuple[str, str]:
    """Chained CTEs replaying the C14 policy column by column; returns
    (ctes, name of the final CTE)."""
    ctes = []
    cond = " AND ".join(f"{c} IS NOT NULL" for c in str_cols) or "TRUE"
    ctes.append(f"{prefix}0 AS (SELECT * FROM {src} WHERE {cond})")
    for j, (c, t) in enumerate(num_cols):
        cur, nxt, pj = f"{prefix}{j}", f"{prefix}{j + 1}", f"{prefix}p{j}"
        crucial_c = "TRUE" if c in crucial else "FALSE"
        ctes.append(
            f"{pj} AS (SELECT CASE WHEN n = 0 OR k = 0 THEN 'skip' "
            f"WHEN {crucial_c} OR k / n >= {dbl(drop_share)} THEN 'drop' ELSE 'fill' END AS act, med "
            f"FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS k, "
            f"median({c}) AS med FROM {cur}))")
        ctes.append(
            f"{nxt} AS (SELECT * REPLACE (CASE WHEN {c} IS NULL AND (SELECT act FROM {pj}) = 'fill' "
            f"THEN CAST((SELECT med FROM {pj}) AS {t}) ELSE {c} END AS {c}) FROM {cur} "
            f"WHERE NOT ((SELECT act FROM {pj}) = 'drop' AND {c} IS NULL))")
    return ",\n".join(ctes), f"{prefix}{len(num_cols)}"


# ------------------------------------------------------------ C1 - C4
_C1_COLS = ["addr_state", "home_ownership", "term", "purpose", "loan_status"]


@register("c1_dedup", with_loanbook(f"SELECT DISTINCT {', '.join(_C1_COLS)} FROM loanbook"))
def c1_dedup(spark, d):
    return CL.drop_duplicate_rows(_lb(spark, d).select(*_C1_COLS))


_C2_COLS = ["id", "dti", "out_prncp", "recoveries", "int_rate", "bc_util", "loan_amnt"]
_C2_NN = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in _C2_COLS)


@register("c2_row_nulls", with_loanbook(
    f"SELECT {', '.join(_C2_COLS)} FROM loanbook WHERE {_C2_NN} >= {int(len(_C2_COLS) * K.ROW_NULL_THRESHOLD)}"))
def c2_row_nulls(spark, d):
    return CL.drop_sparse_rows(_lb(spark, d).select(*_C2_COLS))


_SAN_CTE = f"san AS (SELECT {s_sanitized_select()} FROM loanbook)"
_KEEP = set(K.CRUCIAL_COLUMNS + K.ALWAYS_KEEP)
_C3_SQL = with_loanbook(
    "SELECT column_name, " + rint("null_share", 8) + " AS null_share, "
    f"(column_name IN {in_list(sorted(_KEEP))} OR null_share <= {dbl(K.COLUMN_NULL_LIMIT)}) AS kept "
    "FROM (UNPIVOT (SELECT " + ", ".join(
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS {c}" for c in LB_COLS)
    + " FROM san) ON COLUMNS(*) INTO NAME column_name VALUE null_share)",
    _SAN_CTE)


@register("c3_column_nulls", _C3_SQL)
def c3_column_nulls(spark, d):
    """C3 decision table (column, null share, kept) on the sanitized loan book."""
    san = CL.sanitize(_lb(spark, d))
    shares = CL.null_shares(san)
    long = shares.unpivot([], san.columns, "column_name", "null_share")
    return long.select(
        "column_name", round_half_even("null_share", 8).alias("null_share"),
        (F.col("column_name").isin(sorted(_KEEP)) | (F.col("null_share") <= K.COLUMN_NULL_LIMIT)).alias("kept"))


@register("a7_null_share", with_loanbook(
    "SELECT " + ", ".join(f"{rint(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE', 8)} AS {c}"
                          for c in LB_COLS) + " FROM loanbook"))
def a7_null_share(spark, d):
    sh = CL.null_shares(_lb(spark, d))
    return sh.select(*[round_half_even(c, 8).alias(c) for c in sh.columns])


# ------------------------------------------------------------ C6 - C13
@register("c6_strings", with_loanbook(
    "SELECT id, " + ", ".join(f"{s_sanitize_string(c)} AS {c}" for c in LB_STR) + " FROM loanbook"))
def c6_strings(spark, d):
    return CL.sanitize_strings(_lb(spark, d).select("id", *LB_STR))


@register("c7_numbers", with_loanbook(
    "SELECT " + ", ".join(f"{s_sanitize_number(c, c in K.NEGATIVE_EXEMPT)} AS {c}" for c in LB_NUM)
    + " FROM loanbook"))
def c7_numbers(spark, d):
    return CL.sanitize_numbers(_lb(spark, d).select(*LB_NUM))


@register("c8_ids", "SELECT coalesce(TRY_CAST(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS BIGINT), "
          "CAST(0 AS BIGINT)) AS id FROM orders")
def c8_ids(spark, d):
    from loanbook.sources.tables import read_table
    return CL.clean_id(read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id")))


@register("c9_dates", with_loanbook(
    "SELECT id, CAST(strptime(strftime(issue_d, '%b-%Y'), '%b-%Y') AS DATE) AS issue_d, "
    "earliest_cr_line FROM loanbook"))
def c9_dates(spark, d):
    raw = _lb(spark, d).select("id", F.date_format("issue_d", "MMM-yyyy").alias("issue_d"),
                               F.col("earliest_cr_line").cast("string").alias("earliest_cr_line"))
    return CL.parse_dates(raw)


@register("c10_term", with_loanbook(
    "SELECT id, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS term FROM loanbook"))
def c10_term(spark, d):
    return CL.normalise_term(_lb(spark, d).select("id", "term"))


@register("c11_accepted", with_loanbook(f"SELECT * FROM san", _SAN_CTE))
def c11_accepted(spark, d):
    return CL.clean_accepted(_lb(spark, d))


def _rejected_raw(spark, d):
    lb = _lb(spark, d)
    return lb.select(
        F.col("loan_amnt").alias("Amount Requested"),
        F.col("issue_d").cast("string").alias("Application Date"),
        F.col("title").alias("Loan Title"),
        F.col("fico_range_high").alias("Risk_Score"),
        F.concat(F.col("dti").cast("string"), F.lit("%")).alias("Debt-To-Income Ratio"),
        F.col("zip_code").alias("Zip Code"),
        F.col("addr_state").alias("State"),
        F.col("emp_length").alias("Employment Length"),
        F.col("policy_code").alias("Policy Code"))


_REJ_CTE = ("rej AS (SELECT DISTINCT loan_amnt, CAST(issue_d AS VARCHAR) AS issue_d, title, fico_range_high, "
            "CAST(dti AS VARCHAR) || '%' AS dti, zip_code, addr_state, emp_length, policy_code FROM loanbook)")
_C12_SQL = with_loanbook(
    "SELECT * FROM (SELECT "
    "CASE WHEN loan_amnt < 0 THEN NULL ELSE loan_amnt END AS loan_amnt, "
    f"CAST(TRY_CAST({s_sanitize_string('issue_d')} AS TIMESTAMP) AS DATE) AS issue_d, "
    f"{s_sanitize_string('title')} AS title, "
    "CASE WHEN fico_range_high < 0 THEN NULL ELSE fico_range_high END AS fico_range_high, "
    f"TRY_CAST(replace({s_sanitize_string('dti')}, '%', '') AS DOUBLE) AS dti, "
    f"{s_sanitize_string('zip_code')} AS zip_code, {s_sanitize_string('addr_state')} AS addr_state, "
    f"{s_sanitize_string('emp_length')} AS emp_length, policy_code FROM rej) "
    "WHERE NOT (loan_amnt IS NULL AND issue_d IS NULL AND title IS NULL AND fico_range_high IS NULL "
    "AND dti IS NULL AND zip_code IS NULL AND addr_state IS NULL AND emp_length IS NULL AND policy_code IS NULL)",
    _REJ_CTE)


@register("c12_rejected", _C12_SQL)
def c12_rejected(spark, d):
    return CL.clean_rejected(_rejected_raw(spark, d))


@register("c13_blanks", with_loanbook(
    "SELECT id, " + ", ".join(f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN NULL ELSE {c} END AS {c}"
                              for c in LB_STR) + " FROM loanbook"))
def c13_blanks(spark, d):
    return CL.blanks_to_null(_lb(spark, d).select("id", *LB_STR))


# ------------------------------------------------------------ C14
_PR_COLS = [c for c in K.PRICING_TRAIN_COLUMNS if c in LOANBOOK_TYPES]
_PR_TYPES = dict(LOANBOOK_TYPES, loan_status="INTEGER")
_PR_STR = [c for c in _PR_COLS if _PR_TYPES[c] == "VARCHAR" and c != "id"]
_PR_NUM = [(c, _PR_TYPES[c]) for c in _PR_COLS if _PR_TYPES[c] in ("DOUBLE", "BIGINT", "INTEGER")]
_NP_CTES, _NP_LAST = s_null_policy("prsan", _PR_STR, _PR_NUM, K.MISSING_CRUCIAL)
_C14_SQL = with_loanbook(
    f"SELECT * FROM {_NP_LAST}",
    f"prsan AS (SELECT " + ", ".join(
        f"{LABEL_CASE} AS loan_status" if c == "loan_status" else
        (f"{s_sanitize_number(c, c in K.NEGATIVE_EXEMPT)} AS {c}" if _PR_TYPES[c] in ("DOUBLE", "BIGINT")
         else (f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN NULL ELSE {c} END AS {c}"
               if _PR_TYPES[c] == "VARCHAR" else c))
        for c in _PR_COLS) + f" FROM loanbook WHERE {FINISHED_IN}),\n{_NP_CTES}")


def pricing_training_input(spark, d):
    """F1 + F4 + C7: finished loans with the pricing training selector."""
    lb = FL.finished(_lb(spark, d), binary=False)
    return CL.sanitize_numbers(FL.select_existing(lb, K.PRICING_TRAIN_COLUMNS))


@register("c14_null_policy", _C14_SQL)
def c14_null_policy(spark, d):
    return CL.handle_missing(pricing_training_input(spark, d))


# ------------------------------------------------------------ C16 / A8
_RV_COLS = [c for c in K.REVIEW_FEATURES]
_C16_SQL = with_loanbook(
    "SELECT loan_amnt, emp_length, coalesce(yr, (SELECT median(yr) FROM rv)) AS issue_d, title, zip_code, "
    "addr_state, coalesce(CASE WHEN dti IS NULL THEN NULL ELSE least(dti, (SELECT cap FROM st)) END, "
    "(SELECT med FROM st)) AS dti, coalesce(fico_range_high, CAST(-1 AS DOUBLE)) AS fico_range_high, "
    "policy_code FROM rv",
    "rv0 AS (SELECT DISTINCT " + ", ".join(_RV_COLS) + " FROM loanbook),\n"
    "rv AS (SELECT *, CAST(year(issue_d) AS DOUBLE) AS yr FROM rv0),\n"
    "st0 AS (SELECT quantile_cont(dti, 0.99) AS cap FROM rv),\n"
    "st AS (SELECT cap, (SELECT median(CASE WHEN dti IS NULL THEN NULL ELSE least(dti, cap) END) FROM rv) "
    "AS med FROM st0)")


@register("c16_review_clean", _C16_SQL)
def c16_review_clean(spark, d):
    out, _ = CL.review_clean(_lb(spark, d).select(*_RV_COLS))
    return out


@register("a8_quantiles", with_loanbook(
    f"SELECT {rint('quantile_cont(dti, 0.99)', 8)} AS dti_p99, {rint('median(dti)', 8)} AS dti_median, "
    f"{rint('median(annual_inc)', 8)} AS income_median FROM loanbook"))
def a8_quantiles(spark, d):
    """Exact quantiles by distributed order statistics (one value each)."""
    from loanbook.functions.quantiles import exact_quantile
    from loanbook.session import reuse
    lb = reuse(_lb(spark, d).select("dti", "annual_inc"))
    vals = {"dti_p99": exact_quantile(lb, "dti", 0.99), "dti_median": exact_quantile(lb, "dti", 0.5),
            "income_median": exact_quantile(lb, "annual_inc", 0.5)}
    return spark.range(1).select(*[round_half_even(F.lit(v).cast("double"), 8).alias(k) for k, v in vals.items()])


# ------------------------------------------------------------ F1 F4 F10 A6
@register("f1_finished", with_loanbook(
    f"SELECT id, {LABEL_CASE} AS loan_status FROM loanbook WHERE {FINISHED_IN}"))
def f1_finished(spark, d):
    return FL.finished(_lb(spark, d).select("id", "loan_status"))


@register("f4_select", with_loanbook(
    "SELECT " + ", ".join(c for c in K.PD_PREDICT_COLUMNS if c in LOANBOOK_TYPES) + " FROM loanbook"))
def f4_select(spark, d):
    return FL.select_existing(_lb(spark, d), K.PD_PREDICT_COLUMNS)


@register("f10_defaulted", with_loanbook(
    f"SELECT id, loan_status, recoveries FROM loanbook WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)}"))
def f10_defaulted(spark, d):
    return FL.defaulted(_lb(spark, d)).select("id", "loan_status", "recoveries")


@register("a6_imbalance", with_loanbook(
    f"SELECT count(*) FILTER (WHERE lbl = 0) AS n_paid, count(*) FILTER (WHERE lbl = 1) AS n_default, "
    f"count(*) FILTER (WHERE lbl = 0) / count(*) FILTER (WHERE lbl = 1) AS imbalance "
    f"FROM (SELECT {LABEL_CASE} AS lbl FROM loanbook WHERE {FINISHED_IN})"))
def a6_imbalance(spark, d):
    from loanbook.operators.aggregates import class_balance
    return class_balance(FL.finished(_lb(spark, d).select("loan_status"), binary=False), "loan_status")


# ------------------------------------------------------------ X1 - X8
_X_SQL = with_loanbook(
    "SELECT id, loan_amnt / (annual_inc + 1) AS lti_ratio, "
    "datediff('day', coalesce(earliest_cr_line, DATE '2010-01-01'), DATE '2019-01-01') / 365.25 AS credit_age_years, "
    "avg_cur_bal / (total_rev_hi_lim + 1) AS total_utilization, "
    "inq_last_6mths + num_tl_op_past_12m AS credit_hunger, "
    "coalesce(TRY_CAST(nullif(regexp_extract(term, '(\\d+)', 1), '') AS DOUBLE), CAST(36 AS DOUBLE)) AS term_num, "
    "(loan_amnt / coalesce(TRY_CAST(nullif(regexp_extract(term, '(\\d+)', 1), '') AS DOUBLE), CAST(36 AS DOUBLE))) "
    "/ (annual_inc / 12 + 1) AS monthly_installment_ratio, "
    "bc_util / (bc_open_to_buy + 1) AS bc_util_to_open_ratio FROM loanbook")


@register("x_features", _X_SQL)
def x_features(spark, d):
    out = X.engineer(_lb(spark, d))
    return out.select("id", "lti_ratio", "credit_age_years", "total_utilization", "credit_hunger",
                      "term_num", "monthly_installment_ratio", "bc_util_to_open_ratio")


@register("c17_infinities", with_loanbook(
    "SELECT id, CASE WHEN abs(r) = 'Infinity'::DOUBLE THEN NULL ELSE r END AS dti_per_line "
    "FROM (SELECT id, CASE WHEN num_tl_op_past_12m = 0 THEN 'Infinity'::DOUBLE "
    "ELSE dti / num_tl_op_past_12m END AS r FROM loanbook)"))
def c17_infinities(spark, d):
    lb = _lb(spark, d)
    r = F.when(F.col("num_tl_op_past_12m") == 0, F.lit(float("inf"))) \
         .otherwise(F.col("dti") / F.col("num_tl_op_past_12m"))
    return CL.infinities_to_null(lb.select("id", r.alias("dti_per_line")))


# ------------------------------------------------------------ C5 / U1 / W4 / D5
@register("c5_coerce", with_loanbook(
    "SELECT loan_amnt, TRY_CAST(regexp_replace(dti, '[%$,]', '', 'g') AS DOUBLE) AS dti, "
    "TRY_CAST(regexp_replace(amount_text, '[%$,]', '', 'g') AS DOUBLE) AS amount, title FROM rj",
    "rj AS (SELECT loan_amnt, CAST(dti AS VARCHAR) || '%' AS dti, "
    "'$' || CAST(loan_amnt AS VARCHAR) AS amount_text, title FROM loanbook)"))
def c5_coerce(spark, d):
    """C5 (optional coercion): '%', '$', ',' stripped, unparsable -> null."""
    raw = _lb(spark, d).select("loan_amnt", F.concat(F.col("dti").cast("string"), F.lit("%")).alias("dti"),
                               F.concat(F.lit("$"), F.col("loan_amnt").cast("string")).alias("amount_text"),
                               "title")
    out = CL.coerce_types(raw, {"dti": "double", "amount_text": "double", "title": "string"})
    return out.withColumnRenamed("amount_text", "amount")


@register("u1_stack", with_loanbook(
    f"SELECT loan_status, count(*) AS n FROM (SELECT id, loan_status FROM loanbook WHERE {FINISHED_IN} "
    f"UNION ALL SELECT id, loan_status FROM loanbook WHERE loan_status IN {in_list(K.ONGOING_STATUSES)}) "
    "GROUP BY loan_status"))
def u1_stack(spark, d):
    """Strata stacked by name (bag union), counted per status."""
    from loanbook.operators.joins import stack
    lb = _lb(spark, d).select("id", "loan_status")
    fin = lb.filter(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL)))
    return stack(fin, FL.ongoing(lb)).groupBy("loan_status").agg(F.count(F.lit(1)).alias("n"))


@register("w4_first_n", with_loanbook(
    f"SELECT id, loan_status, loan_amnt FROM loanbook WHERE loan_status IN {in_list(K.ONGOING_STATUSES)} "
    f"ORDER BY loan_amnt DESC, id LIMIT {K.UI_SAMPLE}"))
def w4_first_n(spark, d):
    """First n rows after a total order (a top-n report: the limit is the feature)."""
    ong = FL.ongoing(_lb(spark, d)).select("id", "loan_status", "loan_amnt")
    return ong.orderBy(F.col("loan_amnt").desc(), "id").limit(K.UI_SAMPLE)


@register("f9_ids_first", with_loanbook("SELECT id, loan_status, loan_amnt, purpose FROM loanbook"))
def f9_ids_first(spark, d):
    return FL.ids_first(_lb(spark, d).select("loan_amnt", "purpose", "loan_status", "id"), ["id", "loan_status"])


@register("f5_review_route", with_loanbook(f"SELECT {', '.join(_RV_COLS)}, loan_status, 'train' AS route FROM loanbook"))
def f5_review_route(spark, d):
    """the loan book has a label and more than the nine features: it trains."""
    route, out = FL.review_route(_lb(spark, d))
    return out.withColumn("route", F.lit(route))


@register("c4_guard", with_loanbook("SELECT loan_status, count(*) AS n FROM loanbook GROUP BY loan_status"))
def c4_guard(spark, d):
    """C4: the guard lets a table with values through unchanged (counted per status)."""
    return CL.require_data(_lb(spark, d)).groupBy("loan_status").agg(F.count(F.lit(1)).alias("n"))


CCF = 0.75


@register("d5_ccf_ead", with_loanbook(
    f"SELECT id, {rint(f'out_prncp + greatest(funded_amnt - out_prncp, 0) * {dbl(CCF)}', 2)} AS ead_ccf "
    "FROM loanbook WHERE out_prncp IS NOT NULL"))
def d5_ccf_ead(spark, d):
    """EAD with credit conversion = balance + undrawn x CCF (CCF a parameter)."""
    lb = _lb(spark, d).filter(F.col("out_prncp").isNotNull())
    undrawn = F.greatest(F.col("funded_amnt") - F.col("out_prncp"), F.lit(0.0))
    return lb.select("id", round_half_even(F.col("out_prncp") + undrawn * CCF, 2).alias("ead_ccf"))
