"""Optimal binning and pooled isotonic calibration against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanbook.operators import isotonic as ISO
from loanbook.operators.woe import SHAPES, WoEBinner, best_bins, woe_iv
from loanbook.sources.io import scratch_path


def _fits(bins, trend, least, max_bins):
    if len(bins) > max_bins or any(g + b < least or g + b == 0 for g, b in bins):
        return False
    steps = [(b2 * (g1 + b1) > b1 * (g2 + b2)) - (b2 * (g1 + b1) < b1 * (g2 + b2)) for (g1, b1), (g2, b2) in itertools.pairwise(bins)]
    for shape in SHAPES[trend]:
        if not shape:
            return True
        for turn in range(len(steps) + 1):
            want = [shape[0]] * turn + [shape[-1]] * (len(steps) - turn)
            if all(s in (0, w) for s, w in zip(steps, want, strict=True)):
                return True
    return False


@pytest.mark.parametrize("trend", list(SHAPES))
def test_best_bins_equal_all_groupings(trend):
    rng = random.Random(len(trend))
    for case in range(40):
        n = rng.randint(1, 8)
        counts = [(rng.choice([0, 1, 5, rng.randint(0, 40)]), rng.choice([0, 1, 3, rng.randint(0, 40)])) for _ in range(n)]
        share, most = rng.choice([0.0, 0.05, 0.2, 0.9]), rng.choice([1, 2, 3, 8])
        all_g, all_b = 1 + sum(g for g, _ in counts), 1 + sum(b for _, b in counts)
        least, values = share * sum(g + b for g, b in counts), []
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
            ends = [*cuts, n]
            bins = [(sum(g for g, _ in counts[a:b]), sum(x for _, x in counts[a:b])) for a, b in zip([0, *cuts], ends, strict=True)]
            if _fits(bins, trend, least, most):
                values.append((sum(woe_iv(g, b, all_g, all_b)[1] for g, b in bins), ends))
        got = best_bins(counts, all_g, all_b, trend, share, most)
        if not values:
            assert got == [n]
            continue
        bins = [(sum(g for g, _ in counts[a:b]), sum(x for _, x in counts[a:b])) for a, b in zip([0, *got], got, strict=False)]
        assert _fits(bins, trend, least, most), (case, counts, got)
        assert math.isclose(sum(woe_iv(g, b, all_g, all_b)[1] for g, b in bins), max(values)[0], abs_tol=1e-9)


@pytest.fixture(scope="module")
def loans(spark):
    rng = random.Random(1)
    rows = []
    for k in range(3000):
        x = rng.gauss(0, 1)
        level = rng.choice(["a", "b", "c", "d", None]) if rng.random() < 0.9 else f"rare{rng.randrange(200)}"
        y = int(rng.random() < 1 / (1 + math.exp(1 - x - (level == "c"))))
        rows.append((k, x if rng.random() < 0.95 else rng.choice([None, float("nan")]), level, y if k % 50 else None))
    return spark.createDataFrame(rows, "id long, x double, level string, label int").cache()


def test_binner_bins_levels_and_unseen(spark, loans):
    m = WoEBinner(numericCols=["x"], categoricalCols=["level"], rareShare=0.02).fit(loans)
    bins = m.bins.orderBy("feature", "bin").collect()
    rates = [r.n_bad / (r.n_good + r.n_bad) for r in bins if r.feature == "x"]
    assert len(rates) > 3 and rates == sorted(rates)
    known = loans.where("label IS NOT NULL")
    assert sum(r.n_good + r.n_bad for r in bins if r.feature == "x") == known.where("x IS NOT NULL AND NOT isnan(x)").count()
    levels = {r.level: r for r in m.levels.collect()}
    assert len({levels[k].bin for k in levels if k.startswith("rare")}) == 1 and len(levels) > 100
    odd = spark.createDataFrame([(1, None, "never seen"), (2, float("nan"), None), (3, 99.0, "rare1"), (4, -99.0, "c")], "id long, x double, level string")
    out = {r.id: r for r in m.transform(odd).collect()}
    assert (out[1].x_woe, out[1].level_woe, out[2].x_woe, out[2].level_woe) == (0.0, 0.0, 0.0, 0.0)
    assert out[3].level_woe == levels["rare1"].woe and out[4].level_woe == levels["c"].woe and out[3].x_woe < out[4].x_woe
    assert m.transform(loans).count() == loans.count()


def test_binner_edge_cases(spark, loans):
    with pytest.raises(ValueError):
        WoEBinner(numericCols=["x"]).fit(loans.where("label = 1"))
    flat = loans.withColumn("one", F.lit(3.0)).withColumn("none", F.lit(None).cast("double")).withColumn("no", F.lit(None).cast("string"))
    m = WoEBinner(numericCols=["one", "none"], categoricalCols=["no"]).fit(flat)
    out = m.transform(flat).select("none_woe", "no_woe").distinct().collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0)]


def test_chain_saved_and_read_back_scores_equally(spark, loans):
    known = loans.where("label IS NOT NULL")
    binner = WoEBinner(numericCols=["x"], categoricalCols=["level"])
    chain = Pipeline(stages=[binner, VectorAssembler(inputCols=["x_woe", "level_woe"], outputCol="f"),
                             LogisticRegression(featuresCol="f", labelCol="label")]).fit(known)

    def scored(model, df):
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    iso = ISO.PooledIsotonic(scoreCol="raw", labelCol="label").fit(scored(chain, known))
    path, path2 = scratch_path(spark, "chain"), scratch_path(spark, "iso")
    chain.write().overwrite().save(path)
    PipelineModel(stages=[iso]).write().overwrite().save(path2)
    a = iso.transform(scored(chain, loans)).select("id", "raw", "calibrated_pd")
    b = PipelineModel.load(path2).transform(scored(PipelineModel.load(path), loans)).select("id", "raw", "calibrated_pd")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert WoEBinner.load((binner.write().overwrite().save(path + "-e"), path + "-e")[1]).get("categoricalCols") == ["level"]


def _brute_isotonic(points):
    """Fitted value of each distinct score by the max-min formula."""
    xs = sorted({x for x, _, _ in points})
    w = [sum(q for x, _, q in points if x == v) for v in xs]
    s = [sum(y * q for x, y, q in points if x == v) for v in xs]
    return {v: max(min(sum(s[a:b + 1]) / sum(w[a:b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i, v in enumerate(xs)}


@pytest.mark.parametrize("weighted", [False, True])
def test_isotonic_equals_max_min(spark, monkeypatch, weighted):
    monkeypatch.setattr(ISO, "TASK_BLOCKS", 15)  # several rounds of ranges
    rng = random.Random(9)
    points = [(round(rng.random(), 2), int(rng.random() < 0.5), float(rng.choice([1, 2, 5])) if weighted else 1.0) for _ in range(400)]
    points += [(0.5, 1, 1.0), (0.5, 0, 1.0), (-3.0, 1, 1.0), (9.0, 0, 1.0)]
    df = spark.createDataFrame([*points, (None, 1, 1.0), (float("nan"), 0, 1.0), (0.3, None, 1.0)], "score double, label int, w double").repartition(3)
    m = ISO.PooledIsotonic(weightCol="w" if weighted else "").fit(df)
    want = _brute_isotonic(points)
    got = {r.score: r.calibrated_pd for r in m.transform(df.where("score IS NOT NULL AND NOT isnan(score)")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in want)
    # between blocks linear, beyond the ends constant, null for null
    xs = sorted(want)
    probe = [(xs[0] - 5,), (xs[-1] + 5,), (None,), (float("nan"),), *[((a + b) / 2,) for a, b in itertools.pairwise(xs)]]
    out = m.transform(spark.createDataFrame(probe, "score double")).collect()
    assert len(out) == len(probe)
    for r in out:
        if r.score is None or math.isnan(r.score):
            assert r.calibrated_pd is None
        else:
            assert math.isclose(r.calibrated_pd, np.interp(r.score, xs, [want[x] for x in xs]), abs_tol=1e-12)


def test_isotonic_empty(spark):
    df = spark.createDataFrame([], "score double, label int")
    m = ISO.PooledIsotonic().fit(df)
    assert m.transform(spark.createDataFrame([(0.5,)], "score double")).first().calibrated_pd is None


def test_fit_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("id * 7 % 300 / 3.0D AS x", "concat('l', id % 5) AS s", "CAST(id % 3 = 0 AS INT) AS label")
    model = WoEBinner(numericCols=["x"], categoricalCols=["s"]).fit(df.mapInArrow(tick, "x double, s string, label int"))
    assert model.bins.count() > 1 and seen.value == 300
