"""Monitoring flow: ongoing loans -> states -> migration -> PD -> actions.

One lazy plan; the loan table is read once per call and both the predict
branch and the action branch are keyed by ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.operators import migration as M


def ongoing(df: DataFrame, status_col: str = "loan_status") -> DataFrame:
    """keep ongoing loans."""
    return df.filter(F.col(status_col).isin(K.ONGOING_STATUSES))


def predict_states(loans: DataFrame, ingest: str = "id") -> DataFrame:
    """F3 + C18: id, status (0..3), first row per id in the order of the
    column ``ingest`` (the loan book has one row per id, so there any will do)."""
    st = loans.select("id", F.col(ingest).alias("__in"), M.status_to_state("loan_status").alias("status"))
    return M.clean_states(st, "__in").drop("__in")


def risk_report(loans: DataFrame, tpm=None) -> DataFrame:
    """K2 -> K3/K4: id, status_tag, cumulative_pd (rounded 4 dp)."""
    sim = M.next_state(predict_states(loans), tpm, "status")
    return M.cumulative_pd(sim, tpm)


def action_inputs(loans: DataFrame) -> DataFrame:
    """K5 + C19: the provisioning rows, one per id."""
    cols = ["id", "loan_status", "out_prncp", "funded_amnt", "recoveries", "total_pymnt"]
    return M.clean_action_data(loans.select(*cols))


def action_report(loans: DataFrame, tpm=None, ingest: str = "id") -> DataFrame:
    """Detailed action report, fused into one pass.

    C18 (first state per id) and C19 (highest exposure per id) are both
    keyed by id, so they are one grouped aggregate: ``min`` over
    struct(ingest, state) and ``max`` over struct(out_prncp, rest of the row),
    each ignoring the rows its rule drops. Keeping ids that have both is
    the inner join J7. One shuffle on id, then column expressions and a
    broadcast of the per-state PD table (one row per state)."""
    st = M.status_to_state("loan_status")
    d = loans.select("id", F.col(ingest).alias("__in"), "loan_status", st.alias("status"), "out_prncp", "funded_amnt",
                     "recoveries", "total_pymnt")
    first = F.when(F.col("status").isNotNull(), F.struct("__in", "status"))
    top = F.when(F.col("out_prncp").isNotNull(),
                 F.struct("out_prncp", "loan_status", "funded_amnt", "recoveries", "total_pymnt"))
    g = d.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(first).alias("s"), F.max(top).alias("p"))
    g = g.filter(F.col("s").isNotNull() & F.col("p").isNotNull()).select(
        "id", F.col("s.status").cast("int").alias("current_state"),
        F.greatest(M.round_half_even(F.coalesce("p.out_prncp", F.lit(0.0)), 2), F.lit(0.0)).alias("provision_needed"),
        F.col("p.recoveries").alias("recoveries"), F.col("p.funded_amnt").alias("funded_amnt"))
    pdt = M.state_pd_table(loans.sparkSession, tpm)
    r = g.join(F.broadcast(pdt), F.col("current_state") == F.col("state"), "left")
    r = r.select("id", M.risk_tag("current_state").alias("status_tag"),
                 M.round_half_even("horizon_pd", 4).alias("cumulative_pd"),
                 "provision_needed", "recoveries", "funded_amnt")
    return M.action_report_rows(r)


def run(loans: DataFrame, tpm=None) -> dict[str, DataFrame]:
    """Whole monitoring flow as named lazy DataFrames (nothing is collected)."""
    risk = risk_report(loans, tpm)
    report = M.action_report(risk, action_inputs(loans))
    summary = M.provisioning_summary(report)
    return {"risk": risk, "report": report, "late": M.late_actions(report),
            "summary": summary, "summary_json": M.provisioning_json(summary),
            "counts": M.monitored_counts(report)}
