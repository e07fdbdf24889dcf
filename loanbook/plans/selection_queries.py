"""Registered selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook.operators import aggregates as AG
from loanbook.operators import pricing as P
from loanbook.operators import selection as SEL
from loanbook.plans import risk as RK
from loanbook.plans.catalog import register
from loanbook.plans.pricing_queries import _F_CASH, _F_PROV, _F_RWA, RISK_CTES
from loanbook.plans.sqlfrag import dbl, q, rint
from loanbook.session import reuse
from loanbook.sources.tables import loan_book, with_loanbook

#: prices of the three limits, as shares, for the selection that SQL repeats
GIVEN_PRICES = [1.0, 1.0, 1.0]


def limits_of(report) -> tuple[float, float, float]:
    """Q7 limits as three numbers (one row, three values)."""
    r = P.committee_limits(AG.kpi_values(report)).first()
    return float(r.RWA_Limit), float(r.Provision_Limit), float(r.Liquid_Cash_Limit)


def selection(spark, d, **options):
    """(report with ``selected``, limits, bound)."""
    rep = reuse(RK.risk_report(loan_book(spark, d)))
    lim = limits_of(rep)
    sel, bound = SEL.select(rep, lim, **options)
    return sel, lim, bound


@register("q8_selection")
def q8_selection(spark, d):
    """Q8: every loan with its ``selected`` flag, at the best prices."""
    return selection(spark, d)[0].select("id", "Expected_Profit", "Expected_Loss", "EAD", "selected")


@register("q8_totals")
def q8_totals(spark, d):
    """Q8 report: selected totals against the limits, dual bound and gap."""
    return SEL.selection_totals(*selection(spark, d))


@register("q8_certificate", with_loanbook(
    "SELECT count(*) AS n_loans, true AS within_bound, true AS gap_below_a_ten_thousandth, true AS nine_in_ten_proved FROM report WHERE Expected_Profit IS NOT NULL",
    RISK_CTES))
def q8_certificate(spark, d):
    """Q8: how many loans keep their side in every best selection."""
    sel, lim, _ = selection(spark, d)
    _, c = SEL.certify(sel, lim)
    return spark.createDataFrame([(c["n_in"] + c["n_out"] + c["n_open"], c["profit"] <= c["bound"] * (1 + 1e-9), c["gap"] <= 1e-4 * c["bound"],
                                   c["n_in"] + c["n_out"] >= 9 * c["n_open"])],
                                 "n_loans LONG, within_bound BOOLEAN, gap_below_a_ten_thousandth BOOLEAN, nine_in_ten_proved BOOLEAN")


def _unit(x: str) -> str:
    return f"CAST(ceil(round_even(coalesce({x}, 0) * {SEL.UNIT} * 1000, 0) / 1000) AS BIGINT)"


def _pick(n: int, pool: str) -> str:
    """CTEs of one prefix pick and of the room that it leaves."""
    sums = ", ".join(f"sum(w{k}) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c{k}" for k in range(3))
    room = ", ".join(f"l{k} - coalesce((SELECT sum(w{k}) FROM pick{n}), 0) AS l{k}" for k in range(3))
    return (f"pool{n} AS (SELECT pl.*, rm.* FROM ({pool}) pl, room{n - 1} rm WHERE w0 <= l0 AND w1 <= l1 AND w2 <= l2),\n"
            f"pick{n} AS (SELECT * FROM (SELECT *, {sums} FROM pool{n}) WHERE c0 <= l0 AND c1 <= l1 AND c2 <= l2),\n"
            f"room{n} AS (SELECT {room} FROM room{n - 1})")


_LIMITS = [rint(f"v0 * {_F_RWA}", 2), rint(f"v1 * {_F_PROV}", 2), rint(f"v2 * {_F_CASH}", 2)]
_PRICE = " + ".join([dbl(1e-12), *[f"{dbl(GIVEN_PRICES[k] + 1e-9)} * (w{k} / CAST(l{k} AS DOUBLE))" for k in range(3)]])
_RWA = f"EAD * probability_of_default * {dbl(P.K.RWA_MULTIPLIER)}"
_GIVEN_CTES = f"""{RISK_CTES.strip()},
room0 AS (SELECT {', '.join(f'CAST(floor(round_even({x} * {SEL.UNIT}, 3)) AS BIGINT) AS l{k}' for k, x in enumerate(_LIMITS))} FROM kw),
it AS (SELECT id, Expected_Profit AS p, {_unit(_RWA)} AS w0, {_unit('Expected_Loss')} AS w1, {_unit('EAD')} AS w2 FROM report WHERE Expected_Profit IS NOT NULL),
scored AS (SELECT id, p, w0, w1, w2, p / ({_PRICE}) AS score FROM it, room0 WHERE p > 0),
{_pick(1, 'SELECT * FROM scored')},
{_pick(2, 'SELECT * FROM scored WHERE id NOT IN (SELECT id FROM pick1)')},
chosen AS (SELECT * FROM report WHERE id IN (SELECT id FROM pick1 UNION ALL SELECT id FROM pick2))"""


def _given(spark, d):
    return selection(spark, d, prices=GIVEN_PRICES, rounds=2)[0]


@register("q8_given_prices", with_loanbook(
    "SELECT id, Expected_Profit, id IN (SELECT id FROM chosen) AS selected FROM report", _GIVEN_CTES))
def q8_given_prices(spark, d):
    """Q8 at given prices: two prefix picks in the order of profit per price."""
    return _given(spark, d).select("id", "Expected_Profit", "selected")


_KPIS = RISK_CTES[RISK_CTES.index("kt AS ("):].strip().replace("kt AS (", "kt2 AS (").replace("FROM report)", "FROM chosen)").replace(
    "kw AS (", "kw2 AS (").replace("FROM kt)", "FROM kt2)")


@register("a2_selected_kpis", with_loanbook(" UNION ALL ".join(
    f"SELECT {q(n)} AS Metric, v{i} AS Value FROM kw2 WHERE n > 0" for i, n in enumerate(AG.KPI_NAMES)), f"{_GIVEN_CTES},\n{_KPIS}"))
def a2_selected_kpis(spark, d):
    """A2: the nine KPIs over the selected loans (no rows if none selected)."""
    return AG.portfolio_kpis(_given(spark, d).filter("selected"))


@register("a11_selection_summary", with_loanbook(
    "SELECT (SELECT count(*) FROM report) AS evaluated, (SELECT count(*) FROM chosen) AS granted, "
    f"{rint('(SELECT CAST(sum(CAST(Expected_Profit AS DECIMAL(18,2))) AS DOUBLE) FROM chosen)', 2)} AS total_profit", _GIVEN_CTES))
def a11_selection_summary(spark, d):
    """Evaluated / granted / profit of the committee selection (Q8)."""
    return AG.selection_summary(_given(spark, d))
