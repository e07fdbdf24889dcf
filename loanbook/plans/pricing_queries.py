"""Registered pricing, loss, KPI and join queries (Q1-Q7, M11, M12, A1, J*, U*)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.numeric import round_half_even
from loanbook.operators import aggregates as AG
from loanbook.operators import cleaning as CL
from loanbook.operators import filters as FL
from loanbook.operators import joins as J
from loanbook.operators import migration as M
from loanbook.operators import pricing as P
from loanbook.plans import risk as RK
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import (FINISHED_IN, LABEL_CASE, STATE_CASE, clip_sql, dbl, in_list,
                                    lgd_sql, pd_case, q, rint)
from loanbook.sources import io as IO
from loanbook.sources.tables import loan_book, read_table, with_loanbook

TERM_SQL = ("coalesce(TRY_CAST(nullif(regexp_extract(term, '(\\d+)', 1), '') AS DOUBLE), "
            f"{dbl(K.DEFAULT_TERM_MONTHS)})")
SPREAD_CASE = ("CASE purpose " + " ".join(f"WHEN {q(k)} THEN {dbl(v)}" for k, v in K.PURPOSE_SPREADS.items())
               + f" ELSE {dbl(K.DEFAULT_SPREAD)} END")
PD_SQL = (f"CASE WHEN {FINISHED_IN} THEN (1 + coalesce(inq_last_6mths, 0)) / (2 + coalesce(num_tl_op_past_12m, 0)) "
          f"ELSE {rint(pd_case(STATE_CASE), 4)} END")

RISK_CTES = f"""
pr0 AS (SELECT *, {PD_SQL} AS pd FROM loanbook),
pr1 AS (SELECT *, {lgd_sql()} AS lgd, {rint('loan_amnt / (annual_inc + 1) * annual_inc', 2)} AS EAD,
               {TERM_SQL} AS term_num,
               {rint(f'({dbl(K.FED_FUNDS_RATE)} + {dbl(K.OPERATIONAL_COST)} + {SPREAD_CASE}) * 100', 2)}
                 AS base_interest_rate_pct FROM pr0),
pr2 AS (SELECT *, {rint(f'pd * {dbl(K.RISK_PREMIUM_FACTOR)}', 2)} AS risk_premium_rate FROM pr1),
pr AS (SELECT * REPLACE ({clip_sql(rint('base_interest_rate_pct + risk_premium_rate', 2), None, K.USURY_CAP)}
                         AS int_rate) FROM pr2),
rr0 AS (SELECT id, pd AS probability_of_default,
               {rint(f'{dbl(P.SCORE_OFFSET)} - {dbl(P.SCORE_FACTOR)} * ln(pd / (1 - pd))', 0)} AS credit_score,
               lgd AS LGD_pct, EAD, int_rate, term_num FROM pr),
rr1 AS (SELECT *, {rint('probability_of_default * LGD_pct * EAD', 2)} AS Expected_Loss,
               {rint('EAD * (int_rate / 100) * (term_num / 12)', 2)} AS Expected_Revenue FROM rr0),
report AS (SELECT *, {rint('Expected_Revenue - Expected_Loss', 2)} AS Expected_Profit FROM rr1),
kt AS (SELECT CAST(sum(CAST(EAD AS DECIMAL(18,2))) AS DOUBLE) AS ead,
              CAST(sum(CAST(Expected_Loss AS DECIMAL(18,2))) AS DOUBLE) AS el,
              CAST(sum(CAST(Expected_Revenue AS DECIMAL(18,2))) AS DOUBLE) AS rev,
              CAST(sum(CAST(Expected_Profit AS DECIMAL(18,2))) AS DOUBLE) AS profit,
              avg(probability_of_default) AS avg_pd, avg(credit_score) AS avg_score, count(*) AS n
       FROM report),
kw AS (SELECT {rint('ead', 2)} AS v0, {rint('el', 2)} AS v1, {rint('rev', 2)} AS v2, {rint('profit', 2)} AS v3,
              {rint('(CASE WHEN ead IS NULL OR ead = 0 THEN 0 ELSE el / ead END) * 100', 2)} AS v4,
              {rint('(CASE WHEN rev IS NULL OR rev = 0 THEN 0 ELSE profit / rev END) * 100', 2)} AS v5,
              {rint('avg_pd', 4)} AS v6, {rint('avg_score', 0)} AS v7,
              {rint('(CASE WHEN ead IS NULL OR ead = 0 THEN 0 ELSE rev / ead END) * 100', 2)} AS v8, n FROM kt)
"""


def risk_sql(select: str) -> str:
    return with_loanbook(select, RISK_CTES)


def _lb(spark, d):
    return loan_book(spark, d)


def _priced(spark, d):
    return RK.priced_book(_lb(spark, d))


def _report(spark, d):
    return RK.risk_report(_lb(spark, d))


@register("q1_base_rate", risk_sql("SELECT id, purpose, base_interest_rate_pct FROM pr1"))
def q1_base_rate(spark, d):
    return P.base_rate(_lb(spark, d).select("id", "purpose"))


@register("j11_spread", risk_sql(f"SELECT purpose, {SPREAD_CASE} AS spread, count(*) AS n_loans "
                                 "FROM loanbook GROUP BY purpose"))
def j11_spread(spark, d):
    lb = _lb(spark, d)
    return lb.groupBy("purpose").agg(F.count(F.lit(1)).alias("n_loans")) \
             .withColumn("spread", P.spread_of("purpose"))


@register("j11_config_join", risk_sql("SELECT id, purpose, base_interest_rate_pct FROM pr1"))
def j11_config_join(spark, d):
    """S5 + J11: the rate config as a JSON document, read back and joined."""
    doc = json.dumps({"macro_constants": {"fed_funds_rate": K.FED_FUNDS_RATE, "operational_cost": K.OPERATIONAL_COST},
                      "purpose_spreads": K.PURPOSE_SPREADS})
    path = IO.scratch_path(spark, "rates")
    spark.createDataFrame([(doc,)], "value STRING").coalesce(1).write.text(path)
    macro, spreads = P.read_rate_config(spark, path)
    return P.base_rate(_lb(spark, d).select("id", "purpose"), spreads, macro["fed_funds_rate"], macro["operational_cost"])


@register("q3_price", risk_sql(
    "SELECT id, base_interest_rate_pct, risk_premium_rate, int_rate FROM pr"))
def q3_price(spark, d):
    return _priced(spark, d).select("id", "base_interest_rate_pct", "risk_premium_rate", "int_rate")


@register("q4_ead", risk_sql("SELECT id, EAD FROM pr1"))
def q4_ead(spark, d):
    return _lb(spark, d).select("id", P.ead().alias("EAD"))


@register("q5_loss_profit", risk_sql(
    "SELECT id, probability_of_default, credit_score, LGD_pct, EAD, Expected_Loss, Expected_Revenue, "
    "Expected_Profit FROM report"))
def q5_loss_profit(spark, d):
    return _report(spark, d).drop("int_rate", "term_num")


@register("m11_score", risk_sql("SELECT id, credit_score FROM report"))
def m11_score(spark, d):
    return _report(spark, d).select("id", "credit_score")


@register("q6_rwa_proxy", risk_sql(
    f"SELECT id, {rint(f'EAD * probability_of_default * {dbl(K.RWA_MULTIPLIER)}', 6)} AS rwa FROM report"))
def q6_rwa_proxy(spark, d):
    return _report(spark, d).select("id", round_half_even(P.rwa_proxy(), 6).alias("rwa"))


_KPI_SQL = risk_sql(" UNION ALL ".join(
    f"SELECT {q(n)} AS Metric, v{i} AS Value FROM kw WHERE n > 0" for i, n in enumerate(AG.KPI_NAMES)))


@register("a1_kpis", _KPI_SQL)
def a1_kpis(spark, d):
    return AG.portfolio_kpis(_report(spark, d))


_F_RWA = dbl(P.LIMIT_FACTORS["rwa"])
_F_PROV = dbl(P.LIMIT_FACTORS["provision"])
_F_CASH = dbl(P.LIMIT_FACTORS["cash"])


@register("q7_limits", risk_sql(
    f"SELECT {rint(f'v0 * {_F_RWA}', 2)} AS RWA_Limit, {rint(f'v1 * {_F_PROV}', 2)} AS Provision_Limit, "
    f"{rint(f'v2 * {_F_CASH}', 2)} AS Liquid_Cash_Limit FROM kw"))
def q7_limits(spark, d):
    return P.committee_limits(AG.kpi_values(_report(spark, d)))


@register("m12_lgd", with_loanbook(
    "SELECT id, loan_amnt - total_rec_prncp AS realized_ead, "
    + clip_sql("CASE WHEN loan_amnt - total_rec_prncp > 0 THEN 1 - (recoveries - collection_recovery_fee) / "
               "(loan_amnt - total_rec_prncp) ELSE 0 END", 0.0, 1.0)
    + f" AS realized_lgd FROM loanbook WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)}"))
def m12_lgd(spark, d):
    return P.realized_lgd(FL.defaulted(_lb(spark, d))).select("id", "realized_ead", "realized_lgd")


# ------------------------------------------------------------ joins
@register("j1_profiles", risk_sql(
    "SELECT a.id, a.pd, a.EAD AS ead, b.lgd, a.base_interest_rate_pct FROM pr1 a "
    "JOIN (SELECT id, lgd FROM pr1 WHERE out_prncp IS NOT NULL) b ON a.id = b.id"))
def j1_profiles(spark, d):
    """Initial risk report = PD profile x LGD profile on id."""
    pb = _priced(spark, d)
    pd_prof = pb.select("id", "pd", F.col("EAD").alias("ead"), "base_interest_rate_pct")
    lgd_prof = pb.filter(F.col("out_prncp").isNotNull()).select("id", "lgd")
    return J.profiles(pd_prof, lgd_prof)


_J2_RIGHT = ["id", "int_rate", "purpose", "addr_state", "annual_inc", "term"]


@register("j2_compile", risk_sql(
    "SELECT p.id, p.base_interest_rate_pct, p.risk_premium_rate, p.int_rate, f.purpose, f.addr_state, "
    "f.annual_inc, f.term FROM pr p LEFT JOIN loanbook f ON p.id = f.id"))
def j2_compile(spark, d):
    prices = _priced(spark, d).select("id", "base_interest_rate_pct", "risk_premium_rate", "int_rate")
    feats = _lb(spark, d).select(*_J2_RIGHT)
    return J.compile_left(prices, feats)


@register("j3_sync", with_loanbook(
    f"SELECT id, dti FROM loanbook WHERE dti IS NOT NULL AND id IN (SELECT id FROM loanbook "
    f"WHERE loan_status IN {in_list(K.ONGOING_STATUSES)})"))
def j3_sync(spark, d):
    lb = _lb(spark, d)
    a = lb.filter(F.col("dti").isNotNull()).select("id", "dti")
    b = FL.ongoing(lb).select("id", "loan_status")
    return J.sync_by_id(a, b)[0]


@register("j3_sync_other", with_loanbook(
    f"SELECT id, loan_status FROM loanbook WHERE loan_status IN {in_list(K.ONGOING_STATUSES)} AND id IN (SELECT id FROM loanbook WHERE dti IS NOT NULL)"))
def j3_sync_other(spark, d):
    """The second table, cut to the ids of the first."""
    lb = _lb(spark, d)
    return J.sync_by_id(lb.filter(F.col("dti").isNotNull()).select("id", "dti"), FL.ongoing(lb).select("id", "loan_status"))[1]


@register("j4_other_outputs", with_loanbook(
    f"SELECT 'lgd' AS part, CAST(id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS purpose FROM loanbook WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)} "
    f"AND id IN (SELECT id FROM loanbook WHERE {FINISHED_IN} AND dti > 10) "
    f"UNION ALL SELECT 'score', CAST(id AS VARCHAR), purpose FROM loanbook WHERE loan_status IN {in_list(K.ONGOING_STATUSES)}"))
def j4_other_outputs(spark, d):
    """The LGD training rows cut to the PD ids, and the ongoing set as it is."""
    lb = _lb(spark, d)
    pd_train = FL.finished(lb, binary=False).filter("dti > 10").select("id", "loan_status", "dti")
    _, lgd, score = J.sync_training(pd_train, FL.defaulted(lb).select("id"), FL.ongoing(lb).select("id", "purpose"))
    return lgd.select(F.lit("lgd").alias("part"), "id", F.lit(None).cast("string").alias("purpose")).unionByName(
        score.select(F.lit("score").alias("part"), "id", "purpose"))


@register("j4_train_sync", with_loanbook(
    f"SELECT CAST(id AS VARCHAR) AS id, {LABEL_CASE} AS loan_status, dti FROM loanbook "
    f"WHERE {FINISHED_IN} AND dti IS NOT NULL AND id IN (SELECT id FROM loanbook "
    f"WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)})"))
def j4_train_sync(spark, d):
    lb = _lb(spark, d)
    pd_train = FL.finished(lb, binary=False).filter(F.col("dti").isNotNull()).select("id", "loan_status", "dti")
    lgd_train = P.realized_lgd(FL.defaulted(lb)).select("id", "realized_lgd")
    lgd_pred = FL.ongoing(lb).select("id", "purpose")
    return J.sync_training(pd_train, lgd_train, lgd_pred)[0]


@register("j5_score_sync", with_loanbook(
    "SELECT id, purpose, addr_state, disbursement_method, term, int_rate FROM loanbook "
    "WHERE id IN (SELECT id FROM loanbook WHERE dti IS NOT NULL AND avg_cur_bal >= 0)"))
def j5_score_sync(spark, d):
    lb = _lb(spark, d)
    pd_clean = CL.sanitize_numbers(lb.select("id", "dti", "avg_cur_bal")).dropna()
    exog = FL.select_existing(lb, K.LGD_PREDICT_COLUMNS)
    return J.sync_scoring(pd_clean, exog)


@register("j6_financials", risk_sql(
    "SELECT r.id, r.probability_of_default, r.credit_score, e.int_rate, f.EAD, f.annual_inc "
    "FROM report r JOIN pr e ON r.id = e.id JOIN pr1 f ON r.id = f.id"))
def j6_financials(spark, d):
    rep = _report(spark, d).select("id", "probability_of_default", "credit_score")
    pb = _priced(spark, d)
    return J.financials(rep, pb.select("id", "int_rate"), pb.select("id", "EAD", "annual_inc"))


@register("j12_state_pd", with_loanbook(
    f"SELECT id, {STATE_CASE} AS current_state, {rint(pd_case(STATE_CASE), 10)} AS horizon_pd FROM loanbook "
    f"WHERE loan_status IN {in_list(K.ONGOING_STATUSES)}"))
def j12_state_pd(spark, d):
    lb = FL.ongoing(_lb(spark, d)).select("id", M.status_to_state("loan_status").alias("current_state"))
    pdt = M.state_pd_table(spark)
    out = lb.join(F.broadcast(pdt), F.col("current_state") == F.col("state"), "left")
    return out.select("id", "current_state", round_half_even("horizon_pd", 10).alias("horizon_pd"))


@register("u2_intersect", with_loanbook(
    f"SELECT id FROM loanbook WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)} "
    "INTERSECT SELECT id FROM loanbook WHERE out_prncp IS NOT NULL"))
def u2_intersect(spark, d):
    lb = _lb(spark, d)
    return J.intersect_ids(FL.defaulted(lb), lb.filter(F.col("out_prncp").isNotNull()))


@register("u3_except", with_loanbook(
    f"SELECT id, loan_status FROM loanbook WHERE id NOT IN (SELECT id FROM loanbook "
    f"WHERE loan_status IN {in_list(K.ONGOING_STATUSES)})"))
def u3_except(spark, d):
    lb = _lb(spark, d).select("id", "loan_status")
    return J.except_rows(lb, FL.ongoing(lb))



# ------------------------------------------------------------ D4
def _defaulted_flows(spark, d):
    """Defaulted loans with the day of the first shipment as default date, and a
    dated recovery (a tenth of the discount) with 10 % cost for every line."""
    lb = FL.defaulted(loan_book(spark, d)).select("id", "purpose", "loan_amnt", "int_rate")
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    first = li.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("default_d"))
    loans = (lb.join(first, lb["id"] == first["l_orderkey"], "left")
             .select("id", "purpose", F.col("loan_amnt").alias("ead"), "default_d", (F.col("int_rate") / 100).alias("rate")))
    got = F.rint(F.col("l_extendedprice") * F.col("l_discount") * 10_000) / 100_000
    flows = li.select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("flow_d"), got.alias("recovery"), (got / 10).alias("cost"))
    return loans, flows


_D4_CTES = f"""dl AS (SELECT id, purpose, loan_amnt AS ead, int_rate / 100 AS rate FROM loanbook WHERE loan_status IN {in_list(K.DEFAULTED_STATUSES)}),
fd AS (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS default_d FROM lineitem GROUP BY l_orderkey),
ln AS (SELECT dl.*, fd.default_d FROM dl LEFT JOIN fd ON dl.id = fd.l_orderkey),
fl AS (SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS flow_d,
              round_even(l_extendedprice * l_discount * 10000, 0) / 100000 AS rec FROM lineitem),
dy AS (SELECT id, flow_d, sum(CAST(round_even((rec - rec / 10) * 1000000, 0) AS BIGINT)) AS net, count(*) AS n FROM fl GROUP BY ALL),
pv AS (SELECT ln.id, sum(CAST(round_even(dy.net / pow(1 + ln.rate, date_diff('day', ln.default_d, dy.flow_d) / CAST(365 AS DOUBLE)), 0) AS BIGINT)) AS pv, sum(n) AS n
       FROM ln JOIN dy ON ln.id = dy.id AND dy.flow_d >= ln.default_d GROUP BY ln.id),
el AS (SELECT ln.id, ln.purpose, ln.ead, ln.default_d, CAST(coalesce(pv.n, 0) AS BIGINT) AS n_flows, coalesce(pv.pv, 0) / CAST(1000000 AS DOUBLE) AS pv,
              CASE WHEN ln.ead IS NULL OR ln.rate IS NULL OR ln.default_d IS NULL THEN NULL WHEN ln.ead <= 0 THEN 0
                   ELSE least(greatest(1 - coalesce(pv.pv, 0) / CAST(1000000 AS DOUBLE) / ln.ead, 0), 1) END AS lgd
       FROM ln LEFT JOIN pv ON ln.id = pv.id)"""


@register("d4_economic_lgd", with_loanbook(
    f"SELECT id, ead, default_d, n_flows, {rint('pv', 4)} AS pv, {rint('lgd', 8)} AS economic_lgd FROM el", _D4_CTES))
def d4_economic_lgd(spark, d):
    """Dated recoveries less costs, discounted to the default date, over EAD."""
    loans, flows = _defaulted_flows(spark, d)
    out = P.economic_lgd(loans, flows)
    return out.select("id", "ead", "default_d", "n_flows", round_half_even("pv", 4).alias("pv"),
                      round_half_even("economic_lgd", 8).alias("economic_lgd"))


@register("d4_segments", with_loanbook(
    f"SELECT purpose, count(*) AS n_loans, sum(CAST(round_even(ead * 10000, 0) AS BIGINT)) / CAST(10000 AS DOUBLE) AS exposure, "
    f"{rint('(sum(CAST(round_even(ead * lgd * 10000, 0) AS BIGINT)) / CAST(10000 AS DOUBLE)) / (sum(CAST(round_even(ead * 10000, 0) AS BIGINT)) / CAST(10000 AS DOUBLE))', 8)} AS weighted_lgd "
    f"FROM el WHERE ead > 0 AND lgd IS NOT NULL GROUP BY purpose", _D4_CTES))
def d4_segments(spark, d):
    """Economic LGD by purpose, weighted by exposure."""
    loans, flows = _defaulted_flows(spark, d)
    lgd = P.economic_lgd(loans, flows).join(loans.select("id", "purpose"), "id")
    out = P.exposure_weighted_lgd(lgd, "purpose")
    return out.select("purpose", "n_loans", "exposure", round_half_even("weighted_lgd", 8).alias("weighted_lgd"))
