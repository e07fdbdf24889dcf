"""Registered sampling, split, donor and dedup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.operators import filters as FL
from loanbook.operators import migration as M
from loanbook.operators import sampling as S
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, ONGOING_IN, dbl, rint
from loanbook.sources.tables import loan_book, read_table, with_loanbook

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_REST = [c for c in LI_COLS if c not in LI_KEY]
LI_SCORE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_discount", "l_shipdate"]
H = S.draw_hash_sql
LI_ORDER = ", ".join(LI_KEY + LI_REST)
LI_KEYS_EQ = " AND ".join(f"t.{c} = l.{c}" for c in LI_KEY)


def _li(spark, d):
    return read_table(spark, d, "lineitem")


def _ongoing(spark, d):
    return FL.ongoing(loan_book(spark, d))


_TRAIN_CTE = (f"tr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
              f"(ORDER BY {H(LI_KEY, K.TRAIN_SEED)}, {LI_ORDER}) AS rn FROM lineitem) WHERE rn <= {K.TRAIN_SAMPLE}),\n"
              f"rest AS (SELECT * FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM tr t WHERE {LI_KEYS_EQ}))")


@register("p1_sample", f"WITH {_TRAIN_CTE} SELECT * FROM tr")
def p1_sample(spark, d):
    return S.sample_n(_li(spark, d), K.TRAIN_SAMPLE, LI_KEY, K.TRAIN_SEED)


@register("j10_holdout", f"WITH {_TRAIN_CTE} SELECT {', '.join(LI_KEY)} FROM rest")
def j10_holdout(spark, d):
    return S.sample_holdout(_li(spark, d), K.TRAIN_SAMPLE, LI_KEY, K.TRAIN_SEED).select(*LI_KEY)


@register("p7_disjoint", f"WITH {_TRAIN_CTE}, sc AS (SELECT *, row_number() OVER "
          f"(ORDER BY {H(LI_KEY, K.SCORE_SEED)}, {LI_ORDER}) AS rn FROM rest) "
          f"SELECT {', '.join(LI_SCORE_COLS)} FROM sc WHERE rn <= {K.SCORE_SAMPLE}")
def p7_disjoint(spark, d):
    _, score = S.disjoint_samples(_li(spark, d), K.TRAIN_SAMPLE, K.SCORE_SAMPLE, LI_KEY,
                                  LI_SCORE_COLS, K.TRAIN_SEED, K.SCORE_SEED)
    return score


# every line twice, as two rows with one key: rows, not keys, are drawn
_TWIN = "li AS (SELECT *, i AS copy FROM lineitem, (SELECT unnest([1, 2]) AS i))"
_TWIN_ORDER = f"{', '.join(LI_KEY)}, {', '.join(LI_REST)}, copy"


@register("p7_twins", f"WITH {_TWIN}, o AS (SELECT *, row_number() OVER (ORDER BY {H(LI_KEY, K.TRAIN_SEED)}, {_TWIN_ORDER}) AS rt FROM li), "
          f"sc AS (SELECT *, row_number() OVER (ORDER BY {H(LI_KEY, K.SCORE_SEED)}, {_TWIN_ORDER}) AS rs FROM o WHERE rt > {K.TRAIN_SAMPLE + 1}) "
          f"SELECT {', '.join(LI_KEY)}, copy, CASE WHEN rt <= {K.TRAIN_SAMPLE + 1} THEN 'train' ELSE 'score' END AS part FROM "
          f"(SELECT *, 0 AS rs FROM o WHERE rt <= {K.TRAIN_SAMPLE + 1} UNION ALL SELECT * FROM sc WHERE rs <= {K.SCORE_SAMPLE + 1})")
def p7_twins(spark, d):
    """P7 over rows that share keys: an odd sample size cuts a pair of twins."""
    li = _li(spark, d).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    li = li.select(*LI_KEY, *LI_REST, "copy")
    train, score = S.disjoint_samples(li, K.TRAIN_SAMPLE + 1, K.SCORE_SAMPLE + 1, LI_KEY, None, K.TRAIN_SEED, K.SCORE_SEED)
    return train.select(*LI_KEY, "copy", F.lit("train").alias("part")).unionByName(score.select(*LI_KEY, "copy", F.lit("score").alias("part")))


_ONG_CTE = f"ong AS (SELECT id, loan_status, loan_amnt, funded_amnt, out_prncp FROM loanbook WHERE {ONGOING_IN})"


@register("p3_stratified", with_loanbook(
    f"SELECT o.id, o.loan_status, o.loan_amnt, o.funded_amnt FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY loan_status ORDER BY {H(['id'], K.TRAIN_SEED)}, id) AS rn FROM ong) o "
    f"JOIN qt ON o.loan_status = qt.loan_status WHERE o.rn <= qt.k",
    f"""{_ONG_CTE},
st AS (SELECT loan_status, count(*) AS c FROM ong GROUP BY loan_status),
tt AS (SELECT count(*) AS total FROM ong),
mm AS (SELECT loan_status, {rint(f'least(CAST({K.UI_SAMPLE} AS DOUBLE), total) / total * c', 0)} AS m FROM st, tt),
qt AS (SELECT loan_status, greatest(least(m, {K.UI_SAMPLE} - coalesce(sum(m) OVER (ORDER BY loan_status
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS k FROM mm)"""))
def p3_stratified(spark, d):
    ong = _ongoing(spark, d).select("id", "loan_status", "loan_amnt", "funded_amnt")
    return S.stratified_fraction(ong, "loan_status", K.UI_SAMPLE, ["id"], K.TRAIN_SEED)


@register("p4_strata", with_loanbook(
    f"SELECT id, loan_status, out_prncp FROM (SELECT *, row_number() OVER (PARTITION BY loan_status "
    f"ORDER BY {H(['id'], K.TRAIN_SEED)}, id) AS rn FROM ong) WHERE rn <= {K.STRATUM_CAP}", _ONG_CTE))
def p4_strata(spark, d):
    ong = _ongoing(spark, d).select("id", "loan_status", "out_prncp")
    return S.stratified_cap(ong, "loan_status", K.STRATUM_CAP, ["id"], K.TRAIN_SEED)


@register("p5_monitor_cap", with_loanbook(
    f"SELECT id, loan_status FROM (SELECT *, row_number() OVER (ORDER BY {H(['id'], K.TRAIN_SEED)}, id) AS rn "
    f"FROM ong) WHERE rn <= {K.MONITOR_CAP}", _ONG_CTE))
def p5_monitor_cap(spark, d):
    ong = _ongoing(spark, d).select("id", "loan_status")
    return S.sample_n(ong, K.MONITOR_CAP, ["id"], K.TRAIN_SEED)


@register("p6_split", with_loanbook(
    f"SELECT id, loan_status, CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS split FROM "
    f"(SELECT f.*, row_number() OVER (PARTITION BY f.loan_status ORDER BY {H(['id'], K.TRAIN_SEED)}, id) AS rn, "
    f"ks.k FROM fin f JOIN ks ON f.loan_status = ks.loan_status)",
    f"fin AS (SELECT id, {LABEL_CASE} AS loan_status FROM loanbook WHERE {FINISHED_IN}),\n"
    f"ks AS (SELECT loan_status, {rint(f'count(*) * {dbl(0.8)}', 0)} AS k FROM fin GROUP BY loan_status)"))
def p6_split(spark, d):
    fin = FL.finished(loan_book(spark, d).select("id", "loan_status"), binary=False)
    return S.stratified_split(fin, "loan_status", 0.8, ["id"], K.TRAIN_SEED)


# ------------------------------------------------------------ P2 / J9
_APP_COLS = ["id"] + [c for c in K.REVIEW_FEATURES]
_DONOR_COLS = ["id", "term", "home_ownership", "annual_inc", "earliest_cr_line", "inq_last_6mths",
               "total_rev_hi_lim", "avg_cur_bal", "bc_open_to_buy", "bc_util", "num_tl_op_past_12m",
               "int_rate"]
_J9_EXTRA = [c for c in _DONOR_COLS if c not in ["application_id"] + K.REVIEW_FEATURES]


def _pick_sql(key: str, seed: int, n: str) -> str:
    return f"CAST('0x' || substr({H([key], seed)}, 1, 15) AS BIGINT) % {n}"


_J9_SQL = with_loanbook(
    "SELECT a.application_id, " + ", ".join(f"a.{c}" for c in K.REVIEW_FEATURES) + ", "
    + ", ".join(f"d.{c}" for c in _J9_EXTRA if c != "int_rate")
    + f" FROM app a JOIN dn d ON {_pick_sql('a.application_id', K.TRAIN_SEED, '(SELECT count(*) FROM dn)')} = d.idx",
    f"app AS (SELECT id AS application_id, {', '.join(K.REVIEW_FEATURES)} FROM loanbook WHERE {ONGOING_IN}),\n"
    f"dn AS (SELECT {', '.join(_DONOR_COLS)}, row_number() OVER (ORDER BY {H(['id'], K.TRAIN_SEED)}, id) - 1 AS idx "
    f"FROM loanbook WHERE {FINISHED_IN})")


@register("j9_donor", _J9_SQL)
def j9_donor(spark, d):
    """J9 + F8: approved applicants get donor features; int_rate dropped."""
    lb = loan_book(spark, d)
    apps = FL.ongoing(lb).select(F.col("id").alias("application_id"), *K.REVIEW_FEATURES)
    donors = lb.filter(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL))).select(*_DONOR_COLS)
    return FL.drop_rate(S.donor_attach(apps, donors, "application_id", ["id"], K.TRAIN_SEED))


@register("p2_replacement", with_loanbook(
    f"SELECT t.id, p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey FROM tg t JOIN pool p "
    f"ON {_pick_sql('t.id', K.TRAIN_SEED, '(SELECT count(*) FROM pool)')} = p.idx",
    f"tg AS (SELECT id FROM loanbook WHERE {FINISHED_IN}),\n"
    f"pool AS (SELECT {', '.join(LI_KEY)}, row_number() OVER (ORDER BY {H(LI_KEY, K.TRAIN_SEED)}, "
    f"{', '.join(LI_KEY)}) - 1 AS idx FROM lineitem)"))
def p2_replacement(spark, d):
    lb = loan_book(spark, d)
    tg = lb.filter(F.col("loan_status").isin(list(K.FINISHED_STATUS_LABEL))).select("id")
    pool = _li(spark, d).select(*LI_KEY)
    out = S.sample_with_replacement(tg, pool, "id", LI_KEY, K.TRAIN_SEED)
    return out.select("id", *LI_KEY)


# ------------------------------------------------------------ W1 / C1 on lineitem
_W1_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ["l_extendedprice"] +
                      [c for c in LI_COLS if c not in ("l_orderkey", "l_linenumber", "l_extendedprice")])


@register("w1_top_exposure",
          f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
          f"ORDER BY {_W1_ORDER}) AS rn FROM lineitem) WHERE rn = 1")
def w1_top_exposure(spark, d):
    return M.highest_per_key(_li(spark, d), ["l_orderkey", "l_linenumber"], "l_extendedprice")
