"""Registered monitoring queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.numeric import round_half_even
from loanbook.operators import migration as M
from loanbook.plans import monitoring as MON
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import (ONGOING_IN, STATE_CASE, action_case, clip_sql, dbl,
                                    lgd_sql, pd_case, rint, tag_case)
from loanbook.sources.tables import loan_book, read_table, with_loanbook


def _ongoing(spark, d):
    return MON.ongoing(loan_book(spark, d))


def _next_state_values() -> str:
    tpm = np.asarray(K.DEFAULT_TPM)
    rows = []
    for i in range(tpm.shape[0]):
        j = int(np.argmax(tpm[i]))
        rows.append(f"({i}, {j}, {dbl(tpm[i, j])})")
    return "(VALUES " + ", ".join(rows) + ") AS nx(from_state, predicted_next_state, probability)"


MON_CTES = f"""
ong AS (SELECT * FROM loanbook WHERE {ONGOING_IN}),
st AS (SELECT id, {STATE_CASE} AS status FROM ong),
st1 AS (SELECT id, status FROM st WHERE status IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY status) = 1),
sim AS (SELECT st1.id, st1.status AS current_state, nx.predicted_next_state, nx.probability
        FROM st1 LEFT JOIN {_next_state_values()} ON st1.status = nx.from_state),
risk AS (SELECT id, {tag_case('current_state')} AS status_tag,
                {rint(pd_case('current_state'), 4)} AS cumulative_pd FROM sim),
act0 AS (SELECT id, out_prncp, funded_amnt, recoveries,
                greatest({rint('coalesce(out_prncp, 0)', 2)}, {dbl(0)}) AS provision_needed
         FROM ong WHERE id IS NOT NULL AND out_prncp IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY out_prncp DESC) = 1),
rep0 AS (SELECT r.id, r.status_tag, r.cumulative_pd, a.provision_needed,
                {lgd_sql()} AS base_lgd
         FROM risk r JOIN act0 a ON r.id = a.id),
rep1 AS (SELECT *, {clip_sql(f'base_lgd * {dbl(K.LGD_LOWER_FACTOR)}', 0.0, 1.0)} AS lgd_lower,
                {clip_sql(f'base_lgd * {dbl(K.LGD_UPPER_FACTOR)}', 0.0, 1.0)} AS lgd_upper FROM rep0),
report AS (SELECT id, status_tag, cumulative_pd, provision_needed, base_lgd, lgd_lower, lgd_upper,
                  {action_case()} AS action,
                  {rint('provision_needed * cumulative_pd * base_lgd', 2)} AS ecl_base,
                  {rint('provision_needed * cumulative_pd * lgd_lower', 2)} AS ecl_lower,
                  {rint('provision_needed * cumulative_pd * lgd_upper', 2)} AS ecl_upper
           FROM rep1)
"""


def mon_sql(select: str) -> str:
    return with_loanbook(select, MON_CTES)


@register("f2_ongoing", mon_sql("SELECT id, loan_status, out_prncp, funded_amnt FROM ong"))
def f2_ongoing(spark, d):
    return _ongoing(spark, d).select("id", "loan_status", "out_prncp", "funded_amnt")


@register("f3_state", mon_sql("SELECT id, status FROM st"))
def f3_state(spark, d):
    return _ongoing(spark, d).select("id", M.status_to_state("loan_status").alias("status"))


@register("c18_first_state", mon_sql("SELECT id, status FROM st1"))
def c18_first_state(spark, d):
    return MON.predict_states(_ongoing(spark, d))


@register("c18_repeated_ids", """
SELECT id, CAST(status AS INT) AS status FROM (
    SELECT l_orderkey AS id, l_linenumber, CASE WHEN l_partkey % 5 < 4 THEN l_partkey % 5 END AS status FROM lineitem)
WHERE status IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_linenumber, status) = 1
""")
def c18_repeated_ids(spark, d):
    """C18 where ids repeat: line items in line order, a state from the part key."""
    state = F.when(F.col("l_partkey") % 5 < 4, F.col("l_partkey") % 5)
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", state.alias("status"))
    return M.clean_states(rows, "l_linenumber").select("id", "status")


@register("c19_provision_clean",
          mon_sql("SELECT id, out_prncp, funded_amnt, recoveries, provision_needed FROM act0"))
def c19_provision_clean(spark, d):
    return MON.action_inputs(_ongoing(spark, d)).select(
        "id", "out_prncp", "funded_amnt", "recoveries", "provision_needed")


@register("k2_next_state", mon_sql("SELECT id, current_state, predicted_next_state, probability FROM sim"))
def k2_next_state(spark, d):
    return M.next_state(MON.predict_states(_ongoing(spark, d)), None, "status")


@register("k3_pd12", mon_sql("SELECT id, cumulative_pd FROM risk"))
def k3_pd12(spark, d):
    return MON.risk_report(_ongoing(spark, d)).select("id", "cumulative_pd")


@register("k4_tags", mon_sql("SELECT id, status_tag FROM risk"))
def k4_tags(spark, d):
    return MON.risk_report(_ongoing(spark, d)).select("id", "status_tag")


@register("k6_lgd", mon_sql("SELECT id, base_lgd, lgd_lower, lgd_upper FROM rep1"))
def k6_lgd(spark, d):
    return MON.action_report(_ongoing(spark, d)).select("id", "base_lgd", "lgd_lower", "lgd_upper")


@register("k7_ecl", mon_sql("SELECT id, ecl_base, ecl_lower, ecl_upper FROM report"))
def k7_ecl(spark, d):
    return MON.action_report(_ongoing(spark, d)).select("id", "ecl_base", "ecl_lower", "ecl_upper")


@register("k8_actions", mon_sql("SELECT id, status_tag, action FROM report"))
def k8_actions(spark, d):
    return MON.action_report(_ongoing(spark, d)).select("id", "status_tag", "action")


@register("k9_late", mon_sql("SELECT id, action FROM report WHERE status_tag = 'late'"))
def k9_late(spark, d):
    return M.late_actions(MON.action_report(_ongoing(spark, d)))


@register("k10_report", mon_sql(
    "SELECT id, status_tag, cumulative_pd, provision_needed, base_lgd, lgd_lower, lgd_upper, "
    "action, ecl_base, ecl_upper FROM report"))
def k10_report(spark, d):
    return MON.action_report(_ongoing(spark, d)).drop("ecl_lower")


_A5_SQL = mon_sql(f"""
SELECT t.status_tag,
       {rint('coalesce(s.lower, 0)', 2)} AS lower,
       {rint('coalesce(s.base, 0)', 2)} AS base,
       {rint('coalesce(s.upper, 0)', 2)} AS upper
FROM (VALUES ('warning'), ('attention')) AS t(status_tag)
LEFT JOIN (SELECT status_tag,
                  CAST(sum(CAST(ecl_lower AS DECIMAL(18,2))) AS DOUBLE) AS lower,
                  CAST(sum(CAST(ecl_base AS DECIMAL(18,2))) AS DOUBLE) AS base,
                  CAST(sum(CAST(ecl_upper AS DECIMAL(18,2))) AS DOUBLE) AS upper
           FROM report WHERE status_tag IN ('warning', 'attention') GROUP BY status_tag) s
ON t.status_tag = s.status_tag""")


@register("a5_provisions", _A5_SQL)
def a5_provisions(spark, d):
    return M.provisioning_summary(MON.action_report(_ongoing(spark, d)))


@register("a12_monitored", mon_sql(
    "SELECT count(*) AS monitored, count(*) FILTER (WHERE status_tag <> 'stable') AS non_stable FROM report"))
def a12_monitored(spark, d):
    return M.monitored_counts(MON.action_report(_ongoing(spark, d)))


# ------------------------------------------------------------- D1 / D2 / D3
_EV_CTES = """
ev AS (SELECT user_id AS id, ts, event_id,
              CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
                              WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS state
       FROM events),
ev1 AS (SELECT * FROM ev WHERE state IS NOT NULL),
tr AS (SELECT id, state AS from_state,
              lead(state) OVER (PARTITION BY id ORDER BY ts, event_id) AS to_state, ts FROM ev1),
tr1 AS (SELECT * FROM tr WHERE to_state IS NOT NULL),
cnt AS (SELECT from_state, to_state, count(*) AS n FROM tr1 GROUP BY from_state, to_state)
"""


@register("d1_matrix", f"WITH {_EV_CTES.strip()}\n"
          "SELECT from_state, to_state, n, n / sum(n) OVER (PARTITION BY from_state) AS p FROM cnt")
def d1_matrix(spark, d):
    return M.estimate_matrix(M.event_states(read_table(spark, d, "events")))


@register("d2_early_warning", f"WITH {_EV_CTES.strip()},\n"
          "per AS (SELECT date_trunc('month', ts) AS period, count(*) AS n_from, "
          "count(*) FILTER (WHERE to_state = 2) AS n_to FROM tr1 WHERE from_state = 0 GROUP BY 1)\n"
          "SELECT period, n_from, n_to, n_to / n_from AS rate, "
          "n_to / n_from - lag(n_to / n_from) OVER (ORDER BY period) AS rate_change FROM per")
def d2_early_warning(spark, d):
    return M.early_warning(M.event_states(read_table(spark, d, "events")))


def _d3_sql() -> str:
    """Mean steps by value iteration: x = 1 + Q x over the four transient states."""
    four = range(4)
    cells = ", ".join(f"coalesce(max(CASE WHEN from_state = {i} AND to_state = {j} THEN p END), 0) AS q{i}{j}" for i in four for j in four)
    step = ", ".join(f"1 + {' + '.join(f'q{i}{j} * x{j}' for j in four)} AS x{i}" for i in four)
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS x{i}" for i in four)
    out = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS from_state, {rint(f'x{i}', 8)} AS mean_steps FROM it WHERE k = 3000" for i in four)
    return f"""WITH RECURSIVE ev AS (SELECT user_id AS id, ts, event_id,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS state FROM events),
tr AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY id ORDER BY ts, event_id) AS to_state FROM ev WHERE state IS NOT NULL),
cnt AS (SELECT from_state, to_state, count(*) AS n FROM tr WHERE to_state IS NOT NULL GROUP BY from_state, to_state),
est AS (SELECT from_state, to_state, n / sum(n) OVER (PARTITION BY from_state) AS p FROM cnt),
q AS (SELECT {cells} FROM est),
it AS (SELECT 0 AS k, {zero} UNION ALL SELECT k + 1, {step} FROM it, q WHERE k < 3000)
{out}"""


@register("d3_mean_steps", _d3_sql())
def d3_mean_steps(spark, d):
    """D3: mean steps to the absorbing state from a matrix estimated by D1.

    The counts are a Spark aggregate; the (states x states) inversion is
    constant-size driver math, returned as a table."""
    m = M.estimate_matrix(M.event_states(read_table(spark, d, "events")))
    rows = m.select("from_state", "to_state", "p").collect()  # <= 25 rows: states x states
    n = 1 + max([r.from_state for r in rows] + [r.to_state for r in rows])
    mat = np.zeros((n, n))
    for r in rows:
        mat[r.from_state, r.to_state] = r.p
    # the event panel has no absorbing state: make the last state absorbing
    mat[n - 1] = 0.0
    mat[n - 1, n - 1] = 1.0
    steps = M.mean_steps_to_default(mat, n - 1)
    out = spark.createDataFrame([(i, float(s)) for i, s in enumerate(steps)], "from_state INT, mean_steps DOUBLE")
    return out.select("from_state", round_half_even("mean_steps", 8).alias("mean_steps"))


@register("j7_actions", mon_sql(
    "SELECT r.id, r.status_tag, r.cumulative_pd, a.provision_needed, a.recoveries, a.funded_amnt "
    "FROM risk r JOIN act0 a ON r.id = a.id"))
def j7_actions(spark, d):
    """Risk report joined to the cleaned provisioning rows on id (the
    two-branch form of the fused action report)."""
    from loanbook.operators import joins as J
    ong = _ongoing(spark, d)
    prov = MON.action_inputs(ong).select("id", "provision_needed", "recoveries", "funded_amnt")
    return J.profiles(MON.risk_report(ong), prov)
