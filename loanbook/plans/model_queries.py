"""Registered binning, metric and model queries.

Given-edge WoE and the metrics have SQL twins; fitted models are checked
by row counts and the property tests in ``tests/``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.features import engineer
from loanbook.functions.numeric import round_half_even
from loanbook.operators import aggregates as AG
from loanbook.operators import binning as BN
from loanbook.operators import encoding as EN
from loanbook.operators import filters as FL
from loanbook.operators import isotonic as ISO
from loanbook.operators import models as MD
from loanbook.operators import pricing as P
from loanbook.operators import review as RV
from loanbook.operators import sampling as S
from loanbook.operators import tuning as TU
from loanbook.operators.woe import WoEBinner
from loanbook.plans import risk as RK
from loanbook.plans import woe_queries as WQ
from loanbook.plans.catalog import register
from loanbook.plans.review_queries import SCORE_SQL, sweep_score
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, dbl, q, rint
from loanbook.session import cut_lineage, reuse, spread
from loanbook.sources import io as IO
from loanbook.sources.tables import loan_book, with_loanbook

# Bin edges given as parameters for the SQL-checked WoE queries.
WOE_EDGES = {
    "dti": [5.0, 10.0, 15.0, 20.0, 25.0, 30.0],
    "annual_inc": [40000.0, 60000.0, 80000.0, 100000.0, 120000.0],
    "fico_range_high": [650.0, 700.0, 750.0, 800.0],
}
WOE_FEATURES = list(WOE_EDGES)


def _train(spark, d):
    """Finished loans, label 0/1 in ``label``."""
    lb = loan_book(spark, d)
    return FL.finished(lb, binary=False).withColumnRenamed("loan_status", "label")


def _bin_sql(f: str) -> str:
    parts = " + ".join(f"CAST({f} >= {dbl(e)} AS INTEGER)" for e in WOE_EDGES[f])
    return f"CASE WHEN {f} IS NULL THEN NULL ELSE {parts} END"


def _woe_ctes() -> str:
    stack = " UNION ALL ".join(f"SELECT {q(f)} AS feature, {_bin_sql(f)} AS bin, y FROM tr" for f in WOE_FEATURES)
    bounds = []
    for f, e in WOE_EDGES.items():
        lo = ["NULL"] + [dbl(x) for x in e]
        hi = [dbl(x) for x in e] + ["NULL"]
        bounds += [f"({q(f)}, {i}, CAST({lo[i]} AS DOUBLE), CAST({hi[i]} AS DOUBLE))" for i in range(len(e) + 1)]
    sg = f"((coalesce(c.n_good, 0) + {dbl(0.5)}) / t.G)"
    sb = f"((coalesce(c.n_bad, 0) + {dbl(0.5)}) / t.B)"
    return (f"tr AS (SELECT {LABEL_CASE} AS y, {', '.join(WOE_FEATURES)} FROM loanbook WHERE {FINISHED_IN}),\n"
            f"st AS ({stack}),\n"
            f"cnt AS (SELECT feature, bin, count(*) FILTER (WHERE y = 0) AS n_good, "
            f"count(*) FILTER (WHERE y = 1) AS n_bad FROM st WHERE bin IS NOT NULL GROUP BY feature, bin),\n"
            f"bd AS (SELECT * FROM (VALUES {', '.join(bounds)}) AS v(feature, bin, lower, upper)),\n"
            f"tt AS (SELECT count(*) FILTER (WHERE y = 0) AS G, count(*) FILTER (WHERE y = 1) AS B FROM tr),\n"
            f"wt AS (SELECT b.feature, b.bin, b.lower, b.upper, coalesce(c.n_good, 0) AS n_good, "
            f"coalesce(c.n_bad, 0) AS n_bad, ln({sg} / {sb}) AS woe, ({sg} - {sb}) * ln({sg} / {sb}) AS iv "
            f"FROM bd b LEFT JOIN cnt c ON b.feature = c.feature AND b.bin = c.bin, tt t)")


@register("m3_bins", with_loanbook(
    f"SELECT feature, bin, lower, upper, n_good, n_bad, {rint('woe', 10)} AS woe, {rint('iv', 10)} AS iv FROM wt",
    _woe_ctes()))
def m3_bins(spark, d):
    t = BN.woe_table(_train(spark, d), "label", WOE_EDGES)
    return t.select("feature", "bin", "lower", "upper", "n_good", "n_bad",
                    round_half_even("woe", 10).alias("woe"), round_half_even("iv", 10).alias("iv"))


_M4_SEL = ", ".join(
    f"{rint(f'coalesce((SELECT w.woe FROM wt w WHERE w.feature = {q(f)} AND w.bin = ({_bin_sql(f)})), 0)', 10)}"
    f" AS {f}_woe" for f in WOE_FEATURES)


@register("m4_woe", with_loanbook(f"SELECT id, {_M4_SEL} FROM loanbook", _woe_ctes()))
def m4_woe(spark, d):
    tbl = BN.woe_table(_train(spark, d), "label", WOE_EDGES)
    model = BN.model_from_table(tbl, WOE_EDGES)
    out = model.transform(loan_book(spark, d).select("id", *WOE_FEATURES))
    return out.select("id", *[round_half_even(f"{f}_woe", 10).alias(f"{f}_woe") for f in WOE_FEATURES])


# ------------------------------------------------------------ A9 metrics
_A9_CTES = (f"sc AS (SELECT {LABEL_CASE} AS y, {SCORE_SQL} AS s FROM loanbook WHERE {FINISHED_IN}),\n"
            "g AS (SELECT s, sum(y) AS tp, count(*) AS n FROM sc GROUP BY s),\n"
            "cg AS (SELECT s, tp, n, sum(tp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            "AS ctp, sum(n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM g)")
_A9_SQL = with_loanbook(
    f"SELECT {rint('(SELECT sum(tp * (ctp / cn)) / sum(tp) FROM cg)', 10)} AS average_precision, "
    f"{rint(f'(SELECT -avg(y * ln(least(greatest(s, {dbl(1e-15)}), {dbl(1 - 1e-15)})) + (1 - y) * ln(1 - least(greatest(s, {dbl(1e-15)}), {dbl(1 - 1e-15)}))) FROM sc)', 10)} AS log_loss, "
    f"{rint('(SELECT avg(pow(s - y, 2)) FROM sc)', 10)} AS mse", _A9_CTES)


@register("a9_metrics", _A9_SQL)
def a9_metrics(spark, d):
    sc = _train(spark, d).select(F.col("label").alias("y"), sweep_score().alias("s"))
    ap = AG.average_precision(sc, "s", "y").select("average_precision").scalar()
    ll = AG.log_loss(sc, "s", "y").select("log_loss").scalar()
    ms = sc.agg(F.avg(F.pow(F.col("s") - F.col("y"), 2))).scalar()
    return spark.range(1).select(round_half_even(ap, 10).alias("average_precision"),
                                 round_half_even(ll, 10).alias("log_loss"),
                                 round_half_even(ms, 10).alias("mse"))


# ------------------------------------------------------------ M8 on a given score
_M8_CTES = (f"sc AS (SELECT {rint(SCORE_SQL, 3)} AS s, {LABEL_CASE} AS y FROM loanbook WHERE {FINISHED_IN}),\n"
            "gs AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS cn, sum(t) OVER (ORDER BY s) AS ct, n, t "
            "FROM (SELECT s, count(*) AS n, sum(y) AS t FROM sc GROUP BY s)),\n"
            "mean AS (SELECT a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cn - a.cn + a.n) AS m FROM gs a JOIN gs b ON b.i >= a.i),\n"
            "low AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM mean),\n"
            "fit AS (SELECT gs.s, gs.n, gs.t, max(low.m) AS v FROM gs JOIN low ON low.i = gs.i GROUP BY ALL),\n"
            "blk AS (SELECT min(s) AS lo, max(s) AS hi, sum(n) AS weight, sum(t) AS total, v FROM fit GROUP BY v),\n"
            "nxt AS (SELECT *, lead(lo) OVER (ORDER BY lo) AS lo2, lead(v) OVER (ORDER BY lo) AS v2 FROM blk)")


def _rounded_score(df):
    return df.withColumn("score", round_half_even(sweep_score(), 3))


@register("m8_blocks", with_loanbook(
    f"SELECT lo, hi, CAST(weight AS DOUBLE) AS weight, CAST(total AS DOUBLE) AS total, {rint('v', 10)} AS value FROM blk", _M8_CTES))
def m8_blocks(spark, d):
    """M8: blocks of the isotonic fit of the label on the sweep score."""
    b = ISO.isotonic_blocks(_rounded_score(_train(spark, d)), "score", "label")
    return b.select("lo", "hi", "weight", "total", round_half_even(F.col("total") / F.col("weight"), 10).alias("value"))


@register("m8_calibrated", with_loanbook(
    f"SELECT id, {rint('CASE WHEN s <= (SELECT min(lo) FROM blk) THEN (SELECT min(v) FROM blk) WHEN s <= hi OR lo2 IS NULL THEN v ELSE v + (v2 - v) * (s - hi) / (lo2 - hi) END', 10)} AS calibrated_pd "
    f"FROM (SELECT id, greatest({rint(SCORE_SQL, 4)} - {dbl(0.0005)}, (SELECT min(lo) FROM blk)) AS s, {rint(SCORE_SQL, 4)} - {dbl(0.0005)} AS raw FROM loanbook) l "
    f"ASOF JOIN nxt ON l.s >= nxt.lo", _M8_CTES))
def m8_calibrated(spark, d):
    """M8: every loan's score, moved off the fitted grid, calibrated by interpolation."""
    model = ISO.PooledIsotonic(scoreCol="score", labelCol="label").fit(_rounded_score(_train(spark, d)))
    book = loan_book(spark, d).withColumn("score", round_half_even(sweep_score(), 4) - 0.0005)
    return model.transform(book).select("id", round_half_even("calibrated_pd", 10).alias("calibrated_pd"))


# ------------------------------------------------------------ pricing chain: WoE, balanced logit, isotonic
CHAIN_LEVELS = ["home_ownership", "purpose"]
LOGIT_C = 1.0


def _chain_features(spark, d):
    """Finished loans with the columns of the pricing chain, kept for its passes."""
    return spread(cut_lineage(WQ.features(spark, d).where("label IS NOT NULL").select("id", "label", *WQ.NUMERIC, *CHAIN_LEVELS)))


def _chain_train(spark, d):
    return MD.balanced_weights(_chain_features(spark, d), "label")


def pricing_chain(train, label: str = "label", C: float = LOGIT_C):
    """Fitted WoE, assembler and balanced logit as one PipelineModel."""
    n_w = train.agg(F.sum("weight")).first()[0]
    binner = WoEBinner(numericCols=WQ.NUMERIC, categoricalCols=CHAIN_LEVELS, labelCol=label)
    names = [f"{f}_woe" for f in [*WQ.NUMERIC, *CHAIN_LEVELS]]
    return Pipeline(stages=[binner, *MD.logit(names, label, C=C, n_weight=n_w, max_iter=500, tol=1e-12).getStages()]).fit(train)


@register("m5_logit")
def m5_logit(spark, d):
    """M5: balanced logit on the WoE features; P(default) per finished loan
    (the fit is checked by m5_equations)."""
    tr = _chain_train(spark, d)
    return pricing_chain(tr).transform(tr).select("id", MD.p_default().alias("pd"), "label")


_EQ_FEATURES = [*WQ.NUMERIC, *CHAIN_LEVELS]
_EQ_SQL = " UNION ALL ".join(
    f"SELECT {q(f)} AS feature, {rint(f'sum(w * y * {f}_woe)', 2)} AS moment FROM wx" for f in _EQ_FEATURES)


@register("m5_equations", WQ._recursive(with_loanbook(
    f"{_EQ_SQL} UNION ALL SELECT 'intercept', {rint('sum(w * y)', 2)} FROM wx",
    WQ.woe_ctes(WQ.NUMERIC, CHAIN_LEVELS, WQ.MONOTONE) + ",\nwx AS (SELECT y, "
    "(gg + bb) / (2 * CASE WHEN y = 1 THEN bb ELSE gg END) AS w, "
    + ", ".join(WQ.plain_value(f, CHAIN_LEVELS) for f in _EQ_FEATURES) + " FROM feat, tot WHERE y IS NOT NULL)")))
def m5_equations(spark, d):
    """M5: score equations of the fitted logit. At the optimum, the weighted sum
    of pd x WoE plus the penalty's coefficient / C equals that of label x WoE,
    which the SQL takes from its own bins."""
    tr = _chain_train(spark, d)
    model = pricing_chain(tr)
    lr = model.stages[-1]
    out = model.transform(tr).withColumn("p", MD.p_default())
    sums = out.agg(*[F.sum(F.col("weight") * F.col("p") * F.col(f"{f}_woe")).alias(f) for f in _EQ_FEATURES],
                   F.sum(F.col("weight") * F.col("p")).alias("intercept"))
    added = {f: float(b) / LOGIT_C for f, b in zip(_EQ_FEATURES, lr.coefficients.toArray(), strict=True)}
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) + added.get(f, 0.0)).alias("moment")) for f in [*_EQ_FEATURES, "intercept"]]))
    return sums.select(stack.alias("x")).select("x.feature", round_half_even("x.moment", 2).alias("moment"))


@register("m11_scorecard")
def m11_scorecard(spark, d):
    """M11 from the fitted logit's coefficients on WoE features."""
    tr = _chain_train(spark, d)
    m = pricing_chain(tr)
    return m.transform(tr).select("id", MD.scorecard(m, [f"{f}_woe" for f in _EQ_FEATURES]).alias("credit_score"))


def _raw(df):
    return df.withColumn("raw_pd", MD.p_default())


def _calibrated_chain(spark, d):
    """The chain fitted on four fifths of the finished loans of each class,
    calibrated on the others. Returns (chain, calibrator, calibration rows)."""
    tr = _chain_features(spark, d)
    split = S.stratified_split(tr.select("id", "label"), "label", 0.8, ["id"], K.TRAIN_SEED)
    tr = cut_lineage(tr.join(split.select("id", "split"), "id"))
    chain = pricing_chain(MD.balanced_weights(tr.where("split = 'train'"), "label"))
    held = reuse(_raw(chain.transform(tr.where("split = 'test'"))))
    return chain, ISO.PooledIsotonic(scoreCol="raw_pd", labelCol="label").fit(held), held


@register("m13_pd")
def m13_pd(spark, d):
    """PD profile (id, EAD, calibrated PD, base rate) for every loan."""
    chain, cal, _ = _calibrated_chain(spark, d)
    book = engineer(RK.priced_book(loan_book(spark, d)).drop("term_num"), drop_sources=False)
    out = cal.transform(_raw(chain.transform(book)))
    return out.select("id", F.col("EAD").alias("ead"), F.col("calibrated_pd").alias("pd"), "base_interest_rate_pct")


@register("m13_calibration", with_loanbook(
    "SELECT count(*) AS n_loans, CAST(sum(loan_status) AS DOUBLE) AS expected_defaults FROM "
    f"(SELECT f.*, row_number() OVER (PARTITION BY f.loan_status ORDER BY {S.draw_hash_sql(['id'], K.TRAIN_SEED)}, id) AS rn, ks.k "
    "FROM fin f JOIN ks ON f.loan_status = ks.loan_status) WHERE rn > k",
    f"fin AS (SELECT id, {LABEL_CASE} AS loan_status FROM loanbook WHERE {FINISHED_IN}),\n"
    f"ks AS (SELECT loan_status, {rint(f'count(*) * {dbl(0.8)}', 0)} AS k FROM fin GROUP BY loan_status)"))
def m13_calibration(spark, d):
    """Calibrated PDs of the calibration loans add up to their defaults."""
    _, cal, held = _calibrated_chain(spark, d)
    return cal.transform(held).agg(F.count(F.lit(1)).alias("n_loans"), round_half_even(F.sum("calibrated_pd"), 4).alias("expected_defaults"))


@register("s8_model_store", with_loanbook("SELECT count(*) AS n_loans, count(*) AS n_equal FROM loanbook"))
def s8_model_store(spark, d):
    """WoE, logit and isotonic stages saved, read back and both applied to every loan."""
    chain, cal, _ = _calibrated_chain(spark, d)
    path, path2 = IO.scratch_path(spark, "chain"), IO.scratch_path(spark, "calibrator")
    IO.save_model(chain, path)
    IO.save_model(PipelineModel(stages=[cal]), path2)
    book = cut_lineage(WQ.features(spark, d).select("id", *WQ.NUMERIC, *CHAIN_LEVELS))

    def scored(a, b):
        return b.transform(_raw(a.transform(book))).select("id", "raw_pd", "calibrated_pd")

    one = scored(chain, cal)
    two = scored(IO.load_model(path), IO.load_model(path2)).withColumnsRenamed({"raw_pd": "raw2", "calibrated_pd": "cal2"})
    same = F.col("raw_pd").eqNullSafe(F.col("raw2")) & F.col("calibrated_pd").eqNullSafe(F.col("cal2"))
    return one.join(two, "id").agg(F.count(F.lit(1)).alias("n_loans"), F.count_if(same & F.col("calibrated_pd").isNotNull()).alias("n_equal"))


# ------------------------------------------------------------ review chain: ordinal codes, boosted trees, isotonic, decision
#: boosting rounds (the least of the range that the search covers)
REVIEW_ROUNDS = 100
FOREST_TREES = 100


def review_features(lb, dictionary):
    """The nine review features as numbers: ordinal codes, the issue day, nulls -1."""
    out = EN.apply_ordinal(lb, dictionary, K.REVIEW_CATEGORICAL)
    out = out.withColumn("issue_d", F.datediff("issue_d", F.lit("1970-01-01").cast("date")))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in K.REVIEW_FEATURES})


def _review(spark, d):
    """(fitted trees, dictionary, finished loans encoded and weighted)."""
    fin = cut_lineage(_train(spark, d).select("id", "label", *K.REVIEW_FEATURES))
    dic = cut_lineage(EN.fit_ordinal(fin, K.REVIEW_CATEGORICAL))
    tr = spread(cut_lineage(MD.balanced_weights(review_features(fin, dic), "label")))
    return MD.gbt(K.REVIEW_FEATURES, "label", max_iter=REVIEW_ROUNDS).fit(tr), dic, tr


@register("m6_gbt")
def m6_gbt(spark, d):
    """M6: weighted boosted trees on the nine review features."""
    m, _, tr = _review(spark, d)
    return m.transform(tr).select("id", MD.p_default().alias("pd"), "label")


@register("m10_review")
def m10_review(spark, d):
    """M1, M6, M8, M10 over the nine features: every loan's calibrated
    probability and decision."""
    m, dic, tr = _review(spark, d)
    cal = ISO.PooledIsotonic(scoreCol="raw_pd", labelCol="label", outputCol="probability").fit(_raw(m.transform(tr)).drop("probability"))
    apps = review_features(loan_book(spark, d).select(F.col("id").alias("application_id"), *K.REVIEW_FEATURES), dic)
    out = cal.transform(_raw(m.transform(apps)).drop("probability"))
    return RV.decide(out.select("application_id", "probability"), "probability", 0.5)


@register("m8_isotonic")
def m8_isotonic(spark, d):
    """M8: isotonic calibration of boosted trees fitted on another split of the loans."""
    fin = cut_lineage(_train(spark, d).select("id", "label", *K.REVIEW_FEATURES))
    dic = cut_lineage(EN.fit_ordinal(fin, K.REVIEW_CATEGORICAL))
    sp = S.stratified_split(fin.select("id", "label"), "label", 0.8, ["id"]).select("id", "split")
    tr = spread(cut_lineage(MD.balanced_weights(review_features(fin, dic), "label").join(sp, "id")))
    m = MD.gbt(K.REVIEW_FEATURES, "label", max_iter=REVIEW_ROUNDS).fit(tr.where("split = 'train'"))
    scored = reuse(_raw(m.transform(tr)))
    cal = ISO.PooledIsotonic(scoreCol="raw_pd", labelCol="label").fit(scored.where("split = 'test'"))
    return cal.transform(scored).select("id", "label", "calibrated_pd")


def _lgd_train(spark, d):
    lb = loan_book(spark, d)
    dd = P.realized_lgd(FL.defaulted(lb)).filter(F.col("realized_lgd").isNotNull())
    return dd.select("id", *K.LGD_CATEGORICAL, F.col("realized_lgd").alias("lgd"))


@register("m7_forest")
def m7_forest(spark, d):
    """M7: LGD forest on defaulted loans; in-sample predictions and labels."""
    tr = _lgd_train(spark, d)
    m = MD.lgd_forest(K.LGD_CATEGORICAL, "lgd", num_trees=FOREST_TREES).fit(tr)
    return m.transform(tr).select("id", "lgd", "prediction")


@register("m14_lgd")
def m14_lgd(spark, d):
    """LGD profile (id, predicted LGD in [0, 1]) of the ongoing loans."""
    m = MD.lgd_forest(K.LGD_CATEGORICAL, "lgd", num_trees=FOREST_TREES).fit(_lgd_train(spark, d))
    ong = FL.ongoing(loan_book(spark, d)).select("id", *K.LGD_CATEGORICAL)
    return MD.lgd_profile(m, ong)


# ------------------------------------------------------------ M9
def _search_sets(spark, d):
    """(fit rows, held-out rows, columns): WoE of the finished loans, bins fitted on the fit rows."""
    tr = _chain_features(spark, d)
    split = S.stratified_split(tr.select("id", "label"), "label", 0.8, ["id"], K.TRAIN_SEED)
    tr = cut_lineage(tr.join(split.select("id", "split"), "id"))
    fit = MD.balanced_weights(tr.where("split = 'train'"), "label")
    binner = WoEBinner(numericCols=WQ.NUMERIC, categoricalCols=CHAIN_LEVELS).fit(fit)
    cols = binner.woe_columns()
    return (spread(cut_lineage(binner.transform(fit).select("label", "weight", *cols))),
            cut_lineage(binner.transform(tr.where("split = 'test'")).select("label", *cols)), cols)


def _logit_search(spark, d, name, evaluator, maximise):
    fit, held, cols = _search_sets(spark, d)
    n_w = fit.agg(F.sum("weight")).first()[0]
    logits = MD.LogitSearch(fit, cols, "label", n_w)
    return TU.search(name, lambda p: logits.fit(p["C"], float(p.get("penalty") == "l1")),
                     lambda at: evaluator.evaluate(logits.scored(held, at)), maximise).table(spark)


@register("m9_search")
def m9_search(spark, d):
    """M9: 50 trials of the pricing logit, least held-out log loss."""
    return _logit_search(spark, d, "pricing_logit", MD.LogLossEvaluator("label", "pd"), False)


@register("m9_pd_logit")
def m9_pd_logit(spark, d):
    """M9: 15 trials of the PD logit (strength and kind of penalty), greatest held-out average precision."""
    return _logit_search(spark, d, "pd_logit", MD.AveragePrecisionEvaluator("pd", "label"), True)


@register("m9_lgd_forest")
def m9_lgd_forest(spark, d):
    """M9: 15 trials of the LGD forest, least held-out squared error."""
    tr = cut_lineage(_lgd_train(spark, d))
    fit = cut_lineage(S.sample_n(tr, round(0.8 * tr.count()), ["id"], K.TRAIN_SEED))
    held = cut_lineage(tr.join(fit.select("id"), "id", "left_anti"))
    cells = MD.CellForest.make(tr, K.LGD_CATEGORICAL, "lgd")
    if cells is None:
        return TU.search("lgd_forest", lambda p: MD.lgd_forest(K.LGD_CATEGORICAL, "lgd", p["n_estimators"], p["max_depth"], min_split=p["min_samples_split"]).fit(fit),
                         lambda m: MD.mse(m.transform(held), "lgd"), False).table(spark)
    rows = spread(cut_lineage(cells.with_cells(fit, range(len(cells.cells)), "__cell", "int").select("__cell", "lgd")))
    return TU.search("lgd_forest", lambda p: cells.fit(rows, p["n_estimators"], p["max_depth"], p["min_samples_split"]),
                     lambda means: MD.mse(cells.with_cells(held, means, "prediction", "double"), "lgd"), False).table(spark)


@register("c15_model_impute")
def c15_model_impute(spark, d):
    """Forest imputation of the null numeric PD features, five rounds of ten trees."""
    lb = loan_book(spark, d)
    types = dict(lb.dtypes)
    cols = [c for c in K.PD_FEATURES if types.get(c) == "double"]
    return MD.iterative_impute(lb.select("id", *cols), cols)
