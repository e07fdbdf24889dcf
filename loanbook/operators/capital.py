"""Capital: risk inputs, standardized, IRB and scenario-based RWA.

Scale notes
* Per-loan quantities are column expressions; totals are one global
  partial aggregate.
* The scenario loss is computed over *risk cells*: loans grouped by
  (PD, R) with the exposure-weighted LGD summed. The conditional default
  rate of a loan depends on nothing else, so this is exact, and the cell
  table has one row per distinct PD (a handful for the migration model).
* The cells are dealt to blocks of bounded size. A block runs through all
  scenarios in one row's expression, and a ``groupBy(scenario)`` sums the
  blocks' partial losses, whatever the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.normal import norm_cdf_sql, norm_ppf_sql
from loanbook.functions.numeric import clip, round_half_even
from loanbook.functions.numeric import dbl as _dbl
from loanbook.operators import migration as M
from loanbook.session import cut_lineage

#: cells that one row of a scenario pass holds
BLOCK_CELLS = 1024


# ------------------------------------------------------------ C20 / C21
def gather(loans: DataFrame) -> DataFrame:
    """C20: ongoing loans with state; null/negative amounts repaired."""
    d = loans.select("id", "loan_status", "out_prncp", "funded_amnt", "recoveries",
                     "int_rate", "installment", "purpose")
    d = d.withColumn("current_state", M.status_to_state("loan_status")) \
         .filter(F.col("current_state").isNotNull())
    return d.select(
        "id", "loan_status",
        F.greatest(F.coalesce("out_prncp", F.lit(0.0)), F.lit(0.0)).alias("out_prncp"),
        F.greatest(F.coalesce("funded_amnt", F.lit(0.0)), F.lit(1.0)).alias("funded_amnt"),
        F.greatest(F.coalesce("recoveries", F.lit(0.0)), F.lit(0.0)).alias("recoveries"),
        "int_rate", "installment",
        F.coalesce("purpose", F.lit("other")).alias("purpose"),
        "current_state")


def clean(df: DataFrame) -> DataFrame:
    """Drop null id/state, funded > 0, recoveries capped at funded,
    highest exposure per id."""
    d = df.filter(F.col("id").isNotNull() & F.col("current_state").isNotNull())
    d = d.withColumn("out_prncp", F.greatest(F.coalesce("out_prncp", F.lit(0.0)), F.lit(0.0)))
    d = d.filter(F.col("funded_amnt") > 0)
    rec = F.greatest(F.coalesce("recoveries", F.lit(0.0)), F.lit(0.0))
    d = d.withColumn("recoveries", F.when(rec > F.col("funded_amnt"), F.col("funded_amnt")).otherwise(rec))
    return M.highest_exposure_per_id(d, "out_prncp")


# ------------------------------------------------------------ R1 / R3
def basel_correlation(pd_col: str | Column = "pd") -> Column:
    """R = 0.03 a + 0.16 (1 - a), a = (1 - e^{-35 PD}) / (1 - e^{-35})."""
    p = F.col(pd_col) if isinstance(pd_col, str) else pd_col
    num = 1 - F.exp(-K.CORR_DECAY * p)
    den = 1 - F.exp(F.lit(-K.CORR_DECAY))
    return K.CORR_LOW * num / den + K.CORR_HIGH * (1 - num / den)


def risk_inputs(df: DataFrame, tpm=None, steps: int = K.PD_HORIZON_STEPS) -> DataFrame:
    """R1 (+R3): pd, lgd, ead, expected_loss, R per loan (PD not rounded)."""
    pdt = M.state_pd_table(df.sparkSession, tpm, steps)
    d = df.join(F.broadcast(pdt), F.col("current_state") == F.col("state"), "left").drop("state")
    d = d.withColumn("pd", clip("horizon_pd", K.CAPITAL_PD_FLOOR, K.CAPITAL_PD_CAP)).drop("horizon_pd")
    d = d.withColumn("lgd", M.base_lgd(lo=K.CAPITAL_LGD_FLOOR, hi=1.0))
    d = d.withColumn("ead", F.col("out_prncp"))
    d = d.withColumn("expected_loss", F.col("pd") * F.col("lgd") * F.col("ead"))
    return d.withColumn("R", basel_correlation("pd"))


# ------------------------------------------------------------ R2 / R4
def standard_weight(use_tags: bool = False) -> Column:
    """R2 risk weight. The original never sees the tag column, so 0.75
    applies to every loan unless ``use_tags`` asks for the distressed weight."""
    if not use_tags:
        return F.lit(K.STANDARD_WEIGHT)
    tag = M.risk_tag("current_state")
    return F.when(tag.isin(K.DISTRESSED_TAGS), F.lit(K.STANDARD_WEIGHT_DISTRESSED)) \
            .otherwise(F.lit(K.STANDARD_WEIGHT))


def with_irb(risk: DataFrame) -> DataFrame:
    """R4 per-loan capital requirement K.

    Staged as separate projections (G(PD), then Z, then N(Z)) so the normal
    CDF's argument stays a column reference and the expression stays small.
    """
    g999 = norm_ppf_sql(_dbl(K.IRB_CONFIDENCE))
    r = risk.withColumn("g_pd", F.expr(norm_ppf_sql("pd")))
    r = r.withColumn("z_irb", F.expr(f"(g_pd + sqrt(R) * {g999}) / sqrt(1 - R)"))
    r = r.withColumn("n_z", F.expr(norm_cdf_sql("z_irb")))
    return r.withColumn("K", (F.col("lgd") * F.col("n_z") - F.col("lgd") * F.col("pd"))
                        * K.IRB_MATURITY_SCALE).drop("g_pd", "z_irb", "n_z")


# ------------------------------------------------------------ risk cells
def risk_cells(risk: DataFrame, use_tags: bool = False) -> DataFrame:
    """One pass over the loans: partial aggregate by (pd, R[, weight]).

    Every capital figure is linear in exposure within a cell, so the loans
    are read once and everything after works on this small table (one row
    per distinct PD), which is checkpointed: several scalar subqueries read it.
    """
    wt = standard_weight(use_tags)
    cells = risk.groupBy("pd", "R", wt.alias("weight")).agg(
        F.sum(F.col("ead") * F.col("lgd")).alias("w"),
        F.sum("ead").alias("ead"),
        F.sum("expected_loss").alias("el"),
        F.count(F.lit(1)).alias("n"))
    g999 = norm_ppf_sql(_dbl(K.IRB_CONFIDENCE))
    c = cells.withColumn("g", F.expr(norm_ppf_sql("pd"))) \
             .withColumn("sr", F.sqrt("R")).withColumn("s1r", F.sqrt(1 - F.col("R")))
    c = c.withColumn("z_irb", F.expr(f"(g + sr * {g999}) / s1r"))
    c = c.withColumn("n_z", F.expr(norm_cdf_sql("z_irb")))
    c = c.withColumn("irb_k_unit", (F.col("n_z") - F.col("pd")) * K.IRB_MATURITY_SCALE)
    return cut_lineage(c)


def capital_totals(risk: DataFrame, use_tags: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """R2 + R4 + A10 from the cells: standardized RWA, IRB RWA, EL, EAD."""
    c = cells if cells is not None else risk_cells(risk, use_tags)
    return c.agg(
        F.sum(F.col("ead") * F.col("weight")).alias("rwa_standardized"),
        (F.sum(F.col("irb_k_unit") * K.RWA_MULTIPLIER * F.col("w")) * K.IRB_SCALING).alias("rwa_irb"),
        F.sum("el").alias("expected_loss"),
        F.sum("ead").alias("total_ead"),
        F.sum("n").alias("n_loans"))


# ------------------------------------------------------------ R5 scenarios
def scenario_table(spark: SparkSession, n: int = K.N_SCENARIOS) -> DataFrame:
    """Systematic factor per scenario: stratified normal quantiles
    z_i = G((i + 0.5) / n), reproducible under any partitioning."""
    return spark.range(n).select(
        F.col("id").alias("scenario"),
        F.expr(norm_ppf_sql(f"(CAST(id AS DOUBLE) + 0.5) / {int(n)}")).alias("z"))


_COND_LOSS = ("aggregate(cells, CAST(0 AS DOUBLE), (acc, c) -> acc + c.w * "
              + norm_cdf_sql("((c.g - c.sr * z) / c.s1r)") + ")")


def scenario_losses(risk: DataFrame, n: int = K.N_SCENARIOS, cells: DataFrame | None = None,
                    block: int = BLOCK_CELLS) -> DataFrame:
    """Portfolio loss per scenario, capped by total exposure.

    The cells are dealt to blocks of about ``block``. Each block becomes one
    row, runs through all scenarios and gives one partial loss for each; a
    grouped sum adds the blocks up. There is one path for any number of cells,
    and no row for a pair of cell and scenario."""
    c = cells if cells is not None else risk_cells(risk)
    blocks = max(1, -(-c.count() // block))
    dealt = (c.groupBy(F.pmod(F.xxhash64("pd", "R", "weight"), F.lit(blocks)).alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("w", "g", "sr", "s1r"))).alias("cells")))
    z = F.expr(norm_ppf_sql(f"(CAST(scenario AS DOUBLE) + 0.5) / {int(n)}")).alias("z")
    each = dealt.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))).select("scenario", "cells", z)
    part = each.select("scenario", "z", F.expr(_COND_LOSS).alias("loss"))
    raw = part.groupBy("scenario").agg(F.first("z").alias("z"), F.sum("loss").alias("loss"))
    cap = c.agg(F.sum("ead")).scalar()
    return raw.select("scenario", "z", F.least(F.col("loss"), cap).alias("loss"))


def var_and_shortfall(losses: DataFrame, q: float = K.IRB_CONFIDENCE) -> DataFrame:
    """VaR (linear-interpolated quantile) and expected shortfall beyond it."""
    var = losses.agg(F.percentile("loss", q).alias("var")).scalar()
    return losses.agg(
        F.percentile("loss", q).alias("var"),
        F.avg(F.when(F.col("loss") >= var, F.col("loss"))).alias("expected_shortfall"),
        F.count(F.lit(1)).alias("n_scenarios"))


def capital_report(risk: DataFrame, n: int = K.N_SCENARIOS, use_tags: bool = False) -> DataFrame:
    """One-row comparison of the three RWAs (2 dp), EL, unit, scenarios.

    The loans are aggregated once into cells; the tail figures enter the
    one-row totals as scalar subqueries over the scenario table."""
    cells = risk_cells(risk, use_tags)
    tot = capital_totals(risk, use_tags, cells)
    tail = cut_lineage(var_and_shortfall(cut_lineage(scenario_losses(risk, n, cells=cells))))  # n rows, then one
    var = tail.select("var").scalar()
    n_s = tail.select("n_scenarios").scalar()
    el = F.col("expected_loss")
    ul = F.greatest(var - el, F.lit(0.0))
    return tot.select(
        round_half_even("rwa_standardized", 2).alias("standardized_approach"),
        round_half_even("rwa_irb", 2).alias("irb_formula_approach"),
        round_half_even(ul * K.RWA_MULTIPLIER, 2).alias("monte_carlo_stochastic_approach"),
        round_half_even(el, 2).alias("portfolio_expected_loss"),
        F.lit("USD").alias("unit"),
        n_s.alias("simulations_performed"))


def capital_adequacy(risk: DataFrame, capital: float | None = None,
                     n: int = K.N_SCENARIOS, q: float = K.IRB_CONFIDENCE) -> DataFrame:
    """Tail loss against available capital. ``capital`` defaults to 8 %
    of standardized RWA (the Basel minimum ratio) when no figure is given."""
    cells = risk_cells(risk)
    tot = capital_totals(risk, cells=cells)
    tail = cut_lineage(var_and_shortfall(cut_lineage(scenario_losses(risk, n, cells=cells)), q))  # n rows, then one
    var = tail.select("var").scalar()
    es = tail.select("expected_shortfall").scalar()
    cap = F.lit(float(capital)) if capital is not None else F.col("rwa_standardized") * 0.08
    return tot.select(
        round_half_even(var, 2).alias("var"),
        round_half_even(es, 2).alias("expected_shortfall"),
        round_half_even(cap, 2).alias("capital"),
        round_half_even(F.greatest(var - F.col("expected_loss"), F.lit(0.0)), 2).alias("unexpected_loss"),
        (F.greatest(var - F.col("expected_loss"), F.lit(0.0)) > cap).alias("breach"))
