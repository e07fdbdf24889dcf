"""Credit-state migration: next state, horizon PD, tags, ECL and actions.

The migration matrix is a parameter of constant size (states x states). Its
power is taken on the driver with numpy (a 5x5 product, independent of the
data) and enters the plan as a small broadcast table keyed by state. Every
per-loan step is a column expression; aggregates are partial (map-side)
aggregates, so a hot state or tag never lands in one task whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.numeric import clip, money_sum, round_half_even


# ---------------------------------------------------------------- K1 matrix
def matrix_table(spark: SparkSession, tpm=None) -> DataFrame:
    """K1: the migration matrix as a long table (from_state, to_state, p)."""
    tpm = np.asarray(tpm if tpm is not None else K.DEFAULT_TPM, dtype=float)
    rows = [(int(i), int(j), float(tpm[i, j]))
            for i in range(tpm.shape[0]) for j in range(tpm.shape[1])]
    return spark.createDataFrame(rows, "from_state INT, to_state INT, p DOUBLE")


def horizon_default_pd(tpm=None, steps: int = K.PD_HORIZON_STEPS,
                       default_state: int = K.DEFAULT_STATE) -> list[float]:
    """(P^steps)[s, default] for every state s (driver math on a constant 5x5)."""
    tpm = np.asarray(tpm if tpm is not None else K.DEFAULT_TPM, dtype=float)
    p = np.linalg.matrix_power(tpm, steps)
    return [float(x) for x in p[:, default_state]]


def state_pd_table(spark: SparkSession, tpm=None, steps: int = K.PD_HORIZON_STEPS) -> DataFrame:
    pds = horizon_default_pd(tpm, steps)
    return spark.createDataFrame([(i, v) for i, v in enumerate(pds)],
                                 "state INT, horizon_pd DOUBLE")


# ---------------------------------------------------------------- F3 states
def status_to_state(col: str | Column = "loan_status") -> Column:
    """ongoing status string to state code 0..3, else null."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for status, code in reversed(list(K.ONGOING_STATUS_STATE.items())):
        out = F.when(c == status, F.lit(code)).otherwise(out)
    return out


def with_state(df: DataFrame, status_col: str = "loan_status",
               out: str = "status") -> DataFrame:
    return df.withColumn(out, status_to_state(status_col))


# ---------------------------------------------------------------- C18 / C19
def clean_states(df: DataFrame, order_col: str, state_col: str = "status") -> DataFrame:
    """Drop null states, keep the first row per id.

    ``order_col`` gives the order in which rows came in; it must be named,
    because a table has no order of its own. Ties go to the lower state.

    Written as a grouped ``min`` over a struct: a partial aggregate, so a
    repeated id never gathers into one task.
    """
    kept = df.filter(F.col(state_col).isNotNull())
    other = [c for c in kept.columns if c not in ("id", state_col)]
    agg = kept.groupBy("id").agg(
        F.min(F.struct(F.col(order_col).alias("__k"), F.col(state_col), *[F.col(c) for c in other])).alias("__r"))
    return agg.select("id", *[F.col(f"__r.{c}").alias(c) for c in kept.columns if c != "id"]) \
              .withColumn(state_col, F.col(state_col).cast("int"))


def highest_per_key(df: DataFrame, keys: list[str], exposure: str,
                    tiebreak: list[str] | None = None) -> DataFrame:
    """Keep the row with the highest ``exposure`` per key.

    ``max`` over struct(exposure, tiebreak..., rest of the row) is exact and
    total (ties fall to the remaining columns in order, nulls lowest) and is
    partially aggregated map-side, so a key holding a third of all rows is
    reduced inside every map task before the shuffle.
    """
    other = [c for c in df.columns if c not in keys]
    order = [exposure] + [c for c in (tiebreak or []) if c != exposure]
    rest = [c for c in other if c not in order]
    key = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                   *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max(key).alias("__r"))
    sel = [F.col(k) for k in keys]
    for c in other:
        src = f"__r.__o{order.index(c)}" if c in order else f"__r.{c}"
        sel.append(F.col(src).alias(c))
    return agg.select(*sel)


def highest_exposure_per_id(df: DataFrame, exposure: str = "out_prncp",
                            tiebreak: list[str] | None = None) -> DataFrame:
    return highest_per_key(df, ["id"], exposure, tiebreak)


def clean_action_data(df: DataFrame) -> DataFrame:
    """Provisioning clean: drop null id/out_prncp, provision floored at 0,
    keep the highest ``out_prncp`` row per id."""
    d = df.filter(F.col("id").isNotNull() & F.col("out_prncp").isNotNull())
    d = d.withColumn("provision_needed",
                     F.greatest(round_half_even(F.coalesce("out_prncp", F.lit(0.0)), 2), F.lit(0.0)))
    return highest_exposure_per_id(d, "out_prncp")


# ---------------------------------------------------------------- K2 .. K4
def next_state_table(spark: SparkSession, tpm=None) -> DataFrame:
    """Per state: most likely next state (first index on ties) and its p."""
    m = matrix_table(spark, tpm)
    return m.groupBy("from_state").agg(
        F.max_by("to_state", F.struct("p", (-F.col("to_state")).alias("neg"))).alias("predicted_next_state"),
        F.max("p").alias("probability"))


def next_state(df: DataFrame, tpm=None, state_col: str = "status") -> DataFrame:
    """K2: id, current_state, predicted_next_state, probability.

    The per-state table has one row per matrix state (a constant bound), so
    it is broadcast.
    """
    nxt = next_state_table(df.sparkSession, tpm)
    return (df.select("id", F.col(state_col).cast("int").alias("current_state"))
              .join(F.broadcast(nxt), F.col("current_state") == F.col("from_state"), "left")
              .select("id", "current_state", "predicted_next_state", "probability"))


def risk_tag(state: str | Column = "current_state") -> Column:
    """K4: stable, late, attention, warning, default by state."""
    s = F.col(state) if isinstance(state, str) else state
    return (F.when(s == 0, "stable").when(s == 1, "late").when(s == 2, "attention")
             .when(s == 3, "warning").otherwise("default"))


def cumulative_pd(df: DataFrame, tpm=None, steps: int = K.PD_HORIZON_STEPS,
                  state_col: str = "current_state", digits: int | None = 4) -> DataFrame:
    """K3 + K4: id, status_tag, cumulative_pd = (P^steps)[state, default]."""
    pdt = state_pd_table(df.sparkSession, tpm, steps)
    out = (df.join(F.broadcast(pdt), F.col(state_col) == F.col("state"), "left")
             .select("id", risk_tag(F.col(state_col)).alias("status_tag"),
                     (round_half_even("horizon_pd", digits) if digits is not None
                      else F.col("horizon_pd")).alias("cumulative_pd")))
    return out


# ---------------------------------------------------------------- K5 .. K10
def base_lgd(recoveries: str = "recoveries", funded: str = "funded_amnt",
             missing: float = K.MISSING_LGD, lo: float = 0.0, hi: float = 1.0) -> Column:
    """clip(1 - recoveries/funded, lo, hi); missing (null or 0/0) gives
    ``missing``; x/0 with x > 0 is -inf in float math and clips to ``lo``."""
    r, f = F.col(recoveries), F.col(funded)
    raw = F.when(r.isNull() | f.isNull(), F.lit(missing)) \
           .when(f == 0, F.when(r == 0, F.lit(missing))
                 .when(r > 0, F.lit(lo)).otherwise(F.lit(hi))) \
           .otherwise(1 - r / f)
    return clip(raw, lo, hi)


def action_rule(tag: str | Column = "status_tag", pd: str | Column = "cumulative_pd") -> Column:
    """K8: action string from risk tag and PD."""
    t = F.col(tag) if isinstance(tag, str) else tag
    p = F.col(pd) if isinstance(pd, str) else pd
    out = F.lit(K.DEFAULT_ACTION)
    for name, thr, above, below in reversed(K.ACTION_RULES):
        out = F.when(t == name, F.when(p > thr, above).otherwise(below)).otherwise(out)
    return out


def action_report(risk: DataFrame, provisions: DataFrame) -> DataFrame:
    """K6-K8, K10 (+ ecl_lower for A5): the detailed action report.

    ``risk``: id, status_tag, cumulative_pd (K3). ``provisions``: the cleaned
    monitoring rows with provision_needed, recoveries, funded_amnt (C19).
    J7 is the inner join on id."""
    prov = provisions.select("id", "provision_needed", "recoveries", "funded_amnt")
    return action_report_rows(risk.join(prov, "id", "inner"))


def action_report_rows(m: DataFrame) -> DataFrame:
    """K6-K8 on rows that carry status_tag, cumulative_pd, provision_needed,
    recoveries and funded_amnt."""
    m = m.withColumn("base_lgd", base_lgd())
    m = m.withColumn("lgd_lower", clip(F.col("base_lgd") * K.LGD_LOWER_FACTOR, 0.0, 1.0)) \
         .withColumn("lgd_upper", clip(F.col("base_lgd") * K.LGD_UPPER_FACTOR, 0.0, 1.0))
    ecl = lambda lgd: round_half_even(F.col("provision_needed") * F.col("cumulative_pd") * F.col(lgd), 2)
    return m.select("id", "status_tag", "cumulative_pd", "provision_needed", "base_lgd",
                    "lgd_lower", "lgd_upper",
                    action_rule().alias("action"),
                    ecl("base_lgd").alias("ecl_base"),
                    ecl("lgd_lower").alias("ecl_lower"),
                    ecl("lgd_upper").alias("ecl_upper"))


def late_actions(report: DataFrame) -> DataFrame:
    """K9: (id, action) for late borrowers."""
    return report.filter(F.col("status_tag") == "late").select("id", "action")


def provisioning_summary(report: DataFrame) -> DataFrame:
    """A5: per-tag sums of rounded ECL for warning and attention.

    A partial aggregate over the report, then a left join onto the two fixed
    tags so that an absent tag reports zeros.
    """
    spark = report.sparkSession
    tags = spark.createDataFrame([(t,) for t in K.PROVISION_TAGS], "status_tag STRING")
    sums = (report.filter(F.col("status_tag").isin(K.PROVISION_TAGS))
                  .groupBy("status_tag")
                  .agg(money_sum("ecl_lower").alias("lower"),
                       money_sum("ecl_base").alias("base"),
                       money_sum("ecl_upper").alias("upper")))
    return (tags.join(sums, "status_tag", "left")
                .select("status_tag",
                        *[round_half_even(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c)
                          for c in ("lower", "base", "upper")]))


def provisioning_json(summary: DataFrame) -> DataFrame:
    """The nested provisioning report as one JSON row (for a JSON sink)."""
    lvl = lambda t: F.first(F.when(F.col("status_tag") == t,
                                   F.struct(F.col("lower").alias("optimistic_lower_bound"),
                                            F.col("base").alias("primary_requirement_base" if t == "warning"
                                                                else "estimated_need_base"),
                                            F.col("upper").alias("stressed_upper_bound"))),
                            ignorenulls=True)
    return summary.agg(F.struct(lvl("warning").alias("warning_level"),
                                lvl("attention").alias("attention_level")).alias("provisioning_report")) \
                  .select(F.to_json("provisioning_report").alias("provisioning_report"))


def monitored_counts(risk: DataFrame) -> DataFrame:
    """Loans monitored and loans not stable."""
    return risk.agg(F.count(F.lit(1)).alias("monitored"),
                    F.count_if(F.col("status_tag") != "stable").alias("non_stable"))


# ---------------------------------------------------------------- D1 .. D3
# --- fixed values: event type to panel state (FIXTURES.md, other tables) ---
EVENT_STATE = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}


def event_states(events: DataFrame) -> DataFrame:
    s = F.lit(None).cast("int")
    for name, code in reversed(list(EVENT_STATE.items())):
        s = F.when(F.col("event_type") == name, F.lit(code)).otherwise(s)
    return events.select(F.col("user_id").alias("id"), "ts", "event_id", s.alias("state")) \
                 .filter(F.col("state").isNotNull())


def transitions(panel: DataFrame, bucket: str = "day") -> DataFrame:
    """Consecutive (from_state, to_state, ts) pairs per id, ordered by (ts, event_id).

    Skew-safe: rows are ordered inside (id, time bucket) partitions, and the
    pair that crosses a bucket boundary is recovered from a per-bucket
    summary (first/last state), whose window runs over buckets, not rows.
    One hot id is therefore split across as many tasks as it has buckets.
    """
    p = panel.withColumn("bucket", F.date_trunc(bucket, "ts"))
    w_in = Window.partitionBy("id", "bucket").orderBy("ts", "event_id")
    inner = (p.withColumn("to_state", F.lead("state").over(w_in))
              .filter(F.col("to_state").isNotNull())
              .select("id", F.col("state").alias("from_state"), "to_state", "ts"))
    key = F.struct("ts", "event_id")
    b = p.groupBy("id", "bucket").agg(
        F.min_by("state", key).alias("first_state"),
        F.max_by("state", key).alias("last_state"),
        F.max("ts").alias("last_ts"))
    w_b = Window.partitionBy("id").orderBy("bucket")
    cross = (b.withColumn("to_state", F.lead("first_state").over(w_b))
              .filter(F.col("to_state").isNotNull())
              .select("id", F.col("last_state").alias("from_state"), "to_state",
                      F.col("last_ts").alias("ts")))
    return inner.unionByName(cross)


def estimate_matrix(panel: DataFrame, bucket: str = "day") -> DataFrame:
    """Transition counts normalised by row: (from_state, to_state, n, p)."""
    counts = transitions(panel, bucket).groupBy("from_state", "to_state") \
                                       .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("from_state")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(w))


def early_warning(panel: DataFrame, from_state: int = 0, to_state: int = 2,
                  period: str = "month", bucket: str = "day") -> DataFrame:
    """Per period, the from->to transition rate and its change over the
    previous period. The window runs over the (few) period rows only."""
    t = transitions(panel, bucket).filter(F.col("from_state") == from_state)
    per = t.groupBy(F.date_trunc(period, "ts").alias("period")).agg(
        F.count(F.lit(1)).alias("n_from"),
        F.count_if(F.col("to_state") == to_state).alias("n_to"))
    per = per.withColumn("rate", F.col("n_to") / F.col("n_from"))
    w = Window.orderBy("period")
    return per.withColumn("rate_change", F.col("rate") - F.lag("rate").over(w))


def mean_steps_to_default(matrix: np.ndarray | list, default_state: int = K.DEFAULT_STATE) -> list[float]:
    """D3: expected steps to absorption, (I - Q)^-1 1 over transient states.

    Q is the constant-size transient block of the matrix (driver math on the
    states x states table produced by D1 or given)."""
    m = np.asarray(matrix, dtype=float)
    keep = [i for i in range(m.shape[0]) if i != default_state]
    q = m[np.ix_(keep, keep)]
    n = np.linalg.solve(np.eye(len(keep)) - q, np.ones(len(keep)))
    return [float(x) for x in n]
