"""The search, and the fitted numbers of the tree models, on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanbook.operators import models as MD
from loanbook.operators import tuning as TU
from loanbook.operators.sampling import stratified_split


def _bowl(p):
    return (math.log10(p["C"]) + 1) ** 2 + (p["k"] - 7) ** 2 / 20 + (p["kind"] != "b")


SPACE = {"C": TU.LogUniform(1e-4, 10.0), "k": TU.Whole(3, 20), "kind": TU.Choice(("a", "b", "c"))}


def test_tuner_learns_and_repeats():
    guided, blind = [], []
    for seed in range(12):
        t = TU.Tuner(SPACE, maximise=False, seed=seed)
        t.run(_bowl, 60)
        guided.append(t.best()[1])
        r = TU.Tuner(SPACE, maximise=False, seed=seed, startup=60)
        r.run(_bowl, 60)
        blind.append(r.best()[1])
        again = TU.Tuner(SPACE, maximise=False, seed=seed)
        again.run(_bowl, 60)
        assert again.history == t.history
        for p, _ in t.history:
            assert 1e-4 <= p["C"] <= 10 and 3 <= p["k"] <= 20 and isinstance(p["k"], int) and p["kind"] in "abc"
    assert sum(guided) < 0.5 * sum(blind)


def test_tuner_maximises_and_reports(spark):
    t = TU.Tuner({"x": TU.Uniform(-1.0, 3.0)}, maximise=True, seed=1)
    best = t.run(lambda p: -(p["x"] - 2) ** 2, 40)
    assert abs(best["x"] - 2) < 0.2
    rows = t.table(spark).orderBy("trial").collect()
    assert len(rows) == 40 and [r.best for r in rows].count(True) == 1
    assert max(rows, key=lambda r: r.metric).best


@pytest.mark.parametrize("r", [TU.Uniform(0.6, 1.0), TU.LogUniform(0.01, 0.2), TU.Whole(2, 20)])
def test_ranges_invert(r):
    rng = random.Random(3)
    for _ in range(200):
        v = r.of_unit(rng.random())
        assert r.lo <= v <= r.hi and 0 <= r.to_unit(v) <= 1 and math.isclose(r.of_unit(r.to_unit(v)), v, rel_tol=1e-9)


def test_forest_predicts_the_means_of_its_cells(spark):
    rows = [(i, "abc"[i % 3], "xy"[i % 2], (i % 3) * 0.3 + (i % 2) * 0.05 + (i % 7) * 0.01) for i in range(420)]
    df = spark.createDataFrame(rows, "id int, purpose string, term string, lgd double")
    m = MD.lgd_forest(["purpose", "term"], "lgd", num_trees=100, max_depth=6).fit(df)
    means = {(r.purpose, r.term): r.m for r in df.groupBy("purpose", "term").agg(F.avg("lgd").alias("m")).collect()}
    for r in m.transform(df).collect():
        assert abs(r.prediction - means[r.purpose, r.term]) < 0.06  # trees see resampled rows and a third of the features
    odd = spark.createDataFrame([(1, "new", None)], "id int, purpose string, term string")
    assert 0.0 <= MD.lgd_profile(m, odd).first().lgd <= 1.0


def test_boosted_trees_rank_and_weigh(spark):
    rng = random.Random(5)
    rows = [(i, x := rng.random(), int(x > 0.7), None if i % 9 == 0 else rng.random()) for i in range(600)]
    df = MD.balanced_weights(spark.createDataFrame(rows, "id int, x double, label int, noise double"), "label")
    w = {r.label: r.w for r in df.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert math.isclose(w[0], 300) and math.isclose(w[1], 300)
    df = MD.with_sentinel(df, ["noise"])
    out = MD.gbt(["x", "noise"], "label", max_iter=5).fit(df).transform(df).withColumn("p", MD.p_default())
    ap = MD.AveragePrecisionEvaluator("p", "label").evaluate(out)
    assert ap > 0.999
    assert out.where("label = 1").agg(F.min("p")).first()[0] > out.where("label = 0").agg(F.max("p")).first()[0] - 0.05


def test_logit_score_equations(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(800)]
    rows = [(a, b, int(rng.random() < 1 / (1 + math.exp(-(a - 0.5 * b - 1))))) for a, b in rows]
    df = MD.balanced_weights(spark.createDataFrame(rows, "a double, b double, label int"), "label")
    n_w = df.agg(F.sum("weight")).first()[0]
    m = MD.logit(["a", "b"], "label", C=0.3, n_weight=n_w, max_iter=500, tol=1e-12).fit(df)
    out = m.transform(df).withColumn("r", F.col("weight") * (F.col("label") - MD.p_default()))
    s = out.agg(F.sum("r").alias("i"), F.sum(F.col("r") * F.col("a")).alias("a"), F.sum(F.col("r") * F.col("b")).alias("b")).first()
    coef = m.stages[-1].coefficients
    assert abs(s.i) < 1e-3 and abs(s.a - coef[0] / 0.3) < 1e-3 and abs(s.b - coef[1] / 0.3) < 1e-3


def test_impute_recovers_a_relation_and_keeps_the_rest(spark):
    rng = random.Random(7)
    rows = [(i, x := rng.random() * 10, None if i % 5 == 0 else 2 * x, rng.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    got = {r.id: r for r in MD.iterative_impute(df, ["x", "y", "z"], rounds=2, num_trees=10).collect()}
    assert len(got) == 1000
    for i, x, y, z in rows:
        assert (got[i].x, got[i].z) == (x, z)
        if y is None:
            assert abs(got[i].y - 2 * x) < 3.0
        else:
            assert got[i].y == y


def test_split_is_stratified(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    n = {(r.label, r.split): r["count"] for r in stratified_split(df, "label", 0.8, ["id"]).groupBy("label", "split").count().collect()}
    assert n == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}


def test_boosted_search_on_a_small_table(spark):
    rng = random.Random(8)
    rows = [(x := rng.random(), rng.random(), int(x + rng.gauss(0, 0.2) > 0.6)) for _ in range(300)]
    df = MD.balanced_weights(spark.createDataFrame(rows, "a double, b double, label int"), "label")
    space = {**TU.SEARCHES["pd_boosted"][0], "n_estimators": TU.Whole(2, 4)}
    ap = MD.AveragePrecisionEvaluator("probability", "label")
    t = TU.search("pd_boosted", lambda p: MD.boosted(["a", "b"], "label", p).fit(df), lambda m: ap.evaluate(m.transform(df)), True, trials=2, space=space)
    assert len(t.history) == 2 and all(0.5 < m <= 1 for _, m in t.history) and t.best()[1] == max(m for _, m in t.history)
    assert {n: s[1] for n, s in TU.SEARCHES.items()} == {"pricing_logit": 50, "pd_logit": 15, "pd_boosted": 15, "review_boosted": 15, "lgd_forest": 15}


@pytest.mark.parametrize("l1_ratio", [0.0, 1.0])
def test_logit_of_a_search_equals_the_logit_in_few_passes(spark, monkeypatch, l1_ratio):
    rng = random.Random(9)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 1)) for _ in range(900)]
    rows = [(a, b, c, int(rng.random() < 1 / (1 + math.exp(-(a - 0.5 * b - 1))))) for a, b, c in rows]
    df = MD.balanced_weights(spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(3), "label")
    search = MD.LogitSearch(df, ["a", "b", "c"], "label", 900.0)
    passes, step = [], MD.LogitSearch._pass
    monkeypatch.setattr(MD.LogitSearch, "_pass", lambda self, at: (passes.append(1), step(self, at))[1])
    for C in (0.01, 5.0):
        at = search.fit(C, l1_ratio)
        want = MD.logit(["a", "b", "c"], "label", C=C, l1_ratio=l1_ratio, n_weight=900.0, max_iter=500, tol=1e-12).fit(df)
        lr = want.stages[-1]
        assert max(abs(x - y) for x, y in zip(at, [*lr.coefficients, lr.intercept], strict=True)) < 1e-5
        one, two = (e.evaluate(x) for e, x in ((MD.LogLossEvaluator("label", "pd"), search.scored(df, at)), (MD.LogLossEvaluator("label"), want.transform(df))))
        assert abs(one - two) < 1e-8
    assert len(passes) <= 24


def test_imputer_fits_a_forest_once_where_its_rows_stay_the_same(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, x := rng.random(), *((None, None) if i % 4 == 0 else (2 * x, 3 * x))) for i in range(200)]
    fits, fit = [], MD.Pipeline.fit
    monkeypatch.setattr(MD.Pipeline, "fit", lambda self, df: (fits.append(1), fit(self, df))[1])
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    once = {r.id: r for r in MD.iterative_impute(df, ["x", "y", "z"], rounds=3, num_trees=3).collect()}
    assert len(fits) == 2 and len(once) == 200 and all(r.y is not None and r.z is not None for r in once.values())
    mixed = df.withColumn("z", F.when(F.col("id") % 4 == 1, None).otherwise(F.col("z")))  # y known where z is not
    fits.clear()
    MD.iterative_impute(mixed, ["x", "y", "z"], rounds=3, num_trees=3)
    assert len(fits) == 4  # y in every round, z once


def test_class_weights_count_the_classes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(40).selectExpr("id", "CAST(id % 4 = 0 AS INT) AS label").mapInArrow(tick, "id long, label int")
    out = MD.balanced_weights(df, "label")
    assert seen.value == 40
    assert {(r.label, r.weight) for r in out.collect()} == {(0, 40 / 60), (1, 2.0)}
    assert seen.value == 80


def test_forest_by_cells_agrees_with_the_forest_in_one_pass_a_fit(spark):
    rng = random.Random(11)
    rows = [(p := rng.choice("abcd"), t := rng.choice(["x", "y", None]), "abcd".index(p) * 0.2 + (t == "y") * 0.1 + rng.gauss(0, 0.05)) for _ in range(1200)]
    df = spark.createDataFrame(rows, "purpose string, term string, lgd double").repartition(3).cache()
    names = ["purpose", "term"]
    cells = MD.CellForest.make(df, names, "lgd")
    assert len(cells.cells) == 12
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    own = cells.with_cells(df, range(12), "__cell", "int").select("__cell", "lgd").mapInArrow(tick, "__cell int, lgd double")
    one = cells.fit(own, 150, 6, 8)
    assert seen.value == 1200
    assert one == cells.fit(own, 150, 6, 8) and one != cells.fit(own, 150, 6, 8, seed=1)
    told = {(r.purpose, r.term): r for r in cells.with_cells(MD.lgd_forest(names, "lgd", 150, 6, min_split=8).fit(df).transform(df), one, "own", "double").collect()}
    assert len(told) == 12 and all(abs(r.own - r.prediction) < 0.03 for r in told.values())
    flat = cells.fit(own, 20, 6, 4000)  # too few rows for any split: the bootstrapped means
    assert len(set(flat)) == 1 and abs(flat[0] - sum(r[2] for r in rows) / 1200) < 0.02
    assert MD.CellForest.make(df.limit(0), names, "lgd").cells == []


def test_more_cells_than_a_task_holds_go_to_the_forest(spark, monkeypatch):
    monkeypatch.setattr(MD, "MOST_CELLS", 2)
    df = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "purpose string, lgd double")
    assert MD.CellForest.make(df, ["purpose"], "lgd") is None
    assert MD.CellForest.make(df.where("purpose < 'c'"), ["purpose"], "lgd") is not None


def test_spread_fills_every_core(spark):
    from loanbook.session import cut_lineage, spread
    cores = spark.sparkContext.defaultParallelism
    d = cut_lineage(spark.range(1000).repartition(cores + 1))
    out = spread(d)
    assert out.rdd.getNumPartitions() == 2 * cores and out.count() == 1000 and out.distinct().count() == 1000
    sizes = [len(x) for x in out.rdd.glom().collect()]
    assert max(sizes) - min(sizes) <= cores
    one = spark.range(5).coalesce(1)
    assert spread(one) is one
