"""Registered capital queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.normal import norm_cdf_sql, norm_ppf_sql
from loanbook.functions.numeric import round_half_even
from loanbook.operators import capital as C
from loanbook.operators import migration as M
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import STATE_CASE, clip_sql, dbl, lgd_sql, pd_case, rint
from loanbook.sources.tables import loan_book, with_loanbook

N = K.N_SCENARIOS


def _risk(spark, d):
    return C.risk_inputs(C.clean(C.gather(loan_book(spark, d))))


_R_SQL = (f"{dbl(K.CORR_LOW)} * (1 - exp({dbl(-K.CORR_DECAY)} * pd)) / (1 - exp({dbl(-K.CORR_DECAY)})) + "
          f"{dbl(K.CORR_HIGH)} * (1 - (1 - exp({dbl(-K.CORR_DECAY)} * pd)) / (1 - exp({dbl(-K.CORR_DECAY)})))")
_K_SQL = f"(lgd * n_z - lgd * pd) * {dbl(K.IRB_MATURITY_SCALE)}"

CAP_CTES = f"""
cg AS (SELECT id, loan_status,
              greatest(coalesce(out_prncp, 0), {dbl(0)}) AS out_prncp,
              greatest(coalesce(funded_amnt, 0), {dbl(1)}) AS funded_amnt,
              greatest(coalesce(recoveries, 0), {dbl(0)}) AS recoveries,
              int_rate, installment, coalesce(purpose, 'other') AS purpose,
              {STATE_CASE} AS current_state
       FROM loanbook WHERE ({STATE_CASE}) IS NOT NULL),
cc AS (SELECT id, loan_status, out_prncp, funded_amnt,
              CASE WHEN recoveries > funded_amnt THEN funded_amnt ELSE recoveries END AS recoveries,
              int_rate, installment, purpose, current_state
       FROM cg WHERE id IS NOT NULL AND funded_amnt > 0
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY out_prncp DESC) = 1),
cr0 AS (SELECT *, {clip_sql(pd_case('current_state'), K.CAPITAL_PD_FLOOR, K.CAPITAL_PD_CAP)} AS pd,
               {lgd_sql(lo=K.CAPITAL_LGD_FLOOR)} AS lgd, out_prncp AS ead FROM cc),
cr AS (SELECT *, pd * lgd * ead AS expected_loss, {_R_SQL} AS R FROM cr0),
crg AS (SELECT *, {norm_ppf_sql('pd')} AS g_pd FROM cr),
crz AS (SELECT *, (g_pd + sqrt(R) * {norm_ppf_sql(dbl(K.IRB_CONFIDENCE))}) / sqrt(1 - R) AS z_irb FROM crg),
crn AS (SELECT *, {norm_cdf_sql('z_irb')} AS n_z FROM crz),
crk AS (SELECT *, {_K_SQL} AS K FROM crn),
tot AS (SELECT sum(ead * {dbl(K.STANDARD_WEIGHT)}) AS rwa_standardized,
               sum(K * {dbl(K.RWA_MULTIPLIER)} * ead) * {dbl(K.IRB_SCALING)} AS rwa_irb,
               sum(expected_loss) AS expected_loss, sum(ead) AS total_ead, count(*) AS n_loans
        FROM crk),
cells AS (SELECT sum(ead * lgd) AS w, {norm_ppf_sql('pd')} AS g, sqrt(R) AS sr, sqrt(1 - R) AS s1r
          FROM cr GROUP BY pd, R),
scen AS (SELECT range AS scenario, {norm_ppf_sql(f'(CAST(range AS DOUBLE) + 0.5) / {N}')} AS z
         FROM range({N})),
loss AS (SELECT s.scenario, s.z,
                least(sum(c.w * {norm_cdf_sql('((c.g - c.sr * s.z) / c.s1r)')}),
                      (SELECT sum(ead) FROM cr)) AS loss
         FROM scen s, cells c GROUP BY s.scenario, s.z),
tail AS (SELECT quantile_cont(loss, {dbl(K.IRB_CONFIDENCE)}) AS var, count(*) AS n_scenarios FROM loss),
es AS (SELECT avg(loss) AS expected_shortfall FROM loss WHERE loss >= (SELECT var FROM tail))
"""


def cap_sql(select: str) -> str:
    return with_loanbook(select, CAP_CTES)


@register("c20_capital_gather", cap_sql(
    "SELECT id, out_prncp, funded_amnt, recoveries, purpose, current_state FROM cg"))
def c20_capital_gather(spark, d):
    return C.gather(loan_book(spark, d)).select(
        "id", "out_prncp", "funded_amnt", "recoveries", "purpose", "current_state")


@register("c21_capital_clean", cap_sql(
    "SELECT id, out_prncp, funded_amnt, recoveries, current_state FROM cc"))
def c21_capital_clean(spark, d):
    return C.clean(C.gather(loan_book(spark, d))).select(
        "id", "out_prncp", "funded_amnt", "recoveries", "current_state")


@register("r1_inputs", cap_sql(
    f"SELECT id, {rint('pd', 10)} AS pd, {rint('lgd', 10)} AS lgd, ead, "
    f"{rint('expected_loss', 6)} AS expected_loss FROM cr"))
def r1_inputs(spark, d):
    r = _risk(spark, d)
    return r.select("id", round_half_even("pd", 10).alias("pd"), round_half_even("lgd", 10).alias("lgd"),
                    "ead", round_half_even("expected_loss", 6).alias("expected_loss"))


@register("r2_standardized", cap_sql(
    f"SELECT {rint('rwa_standardized', 2)} AS rwa_standardized, n_loans FROM tot"))
def r2_standardized(spark, d):
    t = C.capital_totals(_risk(spark, d))
    return t.select(round_half_even("rwa_standardized", 2).alias("rwa_standardized"), "n_loans")


@register("r2_tags", cap_sql(
    f"SELECT {rint('sum(ead * CASE WHEN current_state IN (2, 3) THEN ' + dbl(K.STANDARD_WEIGHT_DISTRESSED) + ' ELSE ' + dbl(K.STANDARD_WEIGHT) + ' END)', 2)} "
    f"AS rwa_standardized, count(*) AS n_loans, count(*) FILTER (WHERE current_state IN (2, 3)) AS n_distressed FROM cr"))
def r2_tags(spark, d):
    """R2 with the distressed weight for loans tagged attention or warning."""
    risk = _risk(spark, d)
    t = C.capital_totals(risk, use_tags=True)
    n = risk.agg(F.count_if(M.risk_tag("current_state").isin(K.DISTRESSED_TAGS))).scalar()
    return t.select(round_half_even("rwa_standardized", 2).alias("rwa_standardized"), "n_loans", n.alias("n_distressed"))


@register("r3_correlation", cap_sql(
    f"SELECT id, {rint('R', 10)} AS R FROM cr"))
def r3_correlation(spark, d):
    return _risk(spark, d).select("id", round_half_even("R", 10).alias("R"))


@register("r4_irb", cap_sql(
    f"SELECT {rint('rwa_irb', 2)} AS rwa_irb, {rint('expected_loss', 2)} AS expected_loss FROM tot"))
def r4_irb(spark, d):
    t = C.capital_totals(_risk(spark, d))
    return t.select(round_half_even("rwa_irb", 2).alias("rwa_irb"),
                    round_half_even("expected_loss", 2).alias("expected_loss"))


@register("a10_el", cap_sql(f"SELECT {rint('expected_loss', 2)} AS portfolio_el FROM tot"))
def a10_el(spark, d):
    t = C.capital_totals(_risk(spark, d))
    return t.select(round_half_even("expected_loss", 2).alias("portfolio_el"))


@register("r5_scenarios", cap_sql(
    f"SELECT scenario, {rint('z', 8)} AS z, {rint('loss', 2)} AS loss FROM loss"))
def r5_scenarios(spark, d):
    loss = C.scenario_losses(_risk(spark, d), N)
    return loss.select("scenario", round_half_even("z", 8).alias("z"),
                       round_half_even("loss", 2).alias("loss"))


@register("r6_report", cap_sql(
    f"SELECT {rint('rwa_standardized', 2)} AS standardized_approach, "
    f"{rint('rwa_irb', 2)} AS irb_formula_approach, "
    f"{rint(f'greatest((SELECT var FROM tail) - expected_loss, {dbl(0)}) * {dbl(K.RWA_MULTIPLIER)}', 2)}"
    f" AS monte_carlo_stochastic_approach, "
    f"{rint('expected_loss', 2)} AS portfolio_expected_loss, 'USD' AS unit, "
    f"(SELECT n_scenarios FROM tail) AS simulations_performed FROM tot"))
def r6_report(spark, d):
    return C.capital_report(_risk(spark, d), N)


@register("d6_shortfall", cap_sql(
    f"SELECT {rint('var', 2)} AS var, {rint('expected_shortfall', 2)} AS expected_shortfall, "
    f"n_scenarios FROM tail, es"))
def d6_shortfall(spark, d):
    t = C.var_and_shortfall(C.scenario_losses(_risk(spark, d), N))
    return t.select(round_half_even("var", 2).alias("var"),
                    round_half_even("expected_shortfall", 2).alias("expected_shortfall"),
                    "n_scenarios")


@register("d7_capital_check", cap_sql(
    f"SELECT {rint('var', 2)} AS var, {rint('expected_shortfall', 2)} AS expected_shortfall, "
    f"{rint(f'rwa_standardized * {dbl(0.08)}', 2)} AS capital, "
    f"{rint(f'greatest(var - expected_loss, {dbl(0)})', 2)} AS unexpected_loss, "
    f"greatest(var - expected_loss, {dbl(0)}) > rwa_standardized * {dbl(0.08)} AS breach "
    f"FROM tot, tail, es"))
def d7_capital_check(spark, d):
    return C.capital_adequacy(_risk(spark, d))
