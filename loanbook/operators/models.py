"""Model fitting and scoring on pyspark.ml.

Every estimator is a distributed pyspark.ml stage; the driver only sees
fitted parameters (coefficients, tree ensembles, isotonic knots).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.functions.quantiles import exact_quantiles
from loanbook.operators import aggregates as AG
from loanbook.operators.pricing import score_from_logodds
from loanbook.session import cut_lineage, reuse


# ------------------------------------------------------------ helpers
def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Class weights n / (2 n_class) (the 'balanced' rule). The classes are
    counted once, here; later passes over the result only look them up."""
    c = cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    n = c.agg(F.sum("__n")).scalar()
    w = c.select(label, (n / (2 * F.col("__n"))).alias(out))
    return df.join(F.broadcast(w), label, "left")  # two rows: one per class


def p_default(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


class AveragePrecisionEvaluator(Evaluator):
    """A9 average precision (step-wise, not the interpolated PR area)."""

    def __init__(self, scoreCol: str = "score", labelCol: str = "label"):
        super().__init__()
        self.scoreCol, self.labelCol = scoreCol, labelCol

    def _evaluate(self, dataset: DataFrame) -> float:
        d = dataset
        if dict(d.dtypes).get(self.scoreCol, "").startswith("vector") or self.scoreCol == "probability":
            d = d.withColumn("__s", p_default(self.scoreCol))
        else:
            d = d.withColumn("__s", F.col(self.scoreCol))
        return float(AG.average_precision(d, "__s", self.labelCol).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


class LogLossEvaluator(Evaluator):
    def __init__(self, labelCol: str = "label", scoreCol: str = "probability"):
        super().__init__()
        self.labelCol, self.scoreCol = labelCol, scoreCol

    def _evaluate(self, dataset: DataFrame) -> float:
        d = dataset.withColumn("__p", p_default(self.scoreCol) if self.scoreCol == "probability" else F.col(self.scoreCol))
        return float(AG.log_loss(d, "__p", self.labelCol).first()[0])

    def isLargerBetter(self) -> bool:
        return False


# ------------------------------------------------------------ M5 / M6
def logit(features: list[str], label: str = "label", C: float = 1.0, l1_ratio: float = 0.0,
          n_weight: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> Pipeline:
    """M5: weighted logistic regression; regParam = 1 / (C x sum of weights)."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                            regParam=1.0 / (C * max(n_weight, 1.0)), elasticNetParam=l1_ratio,
                            standardization=False, maxIter=max_iter, tol=tol)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features",
                                            handleInvalid="keep"), lr])


#: rows of a block of ``LogitSearch``
BLOCK_ROWS = 4096


def _blocks(batches):
    """One block a batch: its columns as doubles, row by row."""
    for b in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
        for a in range(0, len(x), BLOCK_ROWS):
            yield pa.record_batch([pa.array([x[a:a + BLOCK_ROWS].tobytes()], pa.binary())], names=["x"])


def _moments(at: np.ndarray):
    """Task of a pass: (loss, gradient, Hessian) of its blocks at ``at``, in one row."""
    k = len(at)

    def run(batches):
        total = np.zeros(1 + k + k * k)
        for b in batches:
            for x in b.column(0):
                z = np.frombuffer(x.as_py()).reshape(-1, k + 1)  # features, label, weight
                f = np.column_stack([z[:, :k - 1], np.ones(len(z))])
                y, w, m = z[:, k - 1], z[:, k], f @ at
                p = 0.5 * (1 + np.tanh(0.5 * m))
                total[0] += w @ (np.logaddexp(0, m) - y * m)
                total[1:1 + k] += f.T @ (w * (p - y))
                total[1 + k:] += (f.T @ (f * (w * p * (1 - p))[:, None])).ravel()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    return run


def _newton_step(at, g, h, l1: float, l2: float) -> np.ndarray:
    """Minimum of the quadratic model at ``at`` with both penalties (none on the intercept)."""
    k = len(at)
    pen = np.r_[np.ones(k - 1), 0.0]
    h = h + np.diag(l2 * pen + 1e-12)
    g = g + l2 * pen * at
    if not l1:
        return at - np.linalg.solve(h, g)
    new, slope = at.copy(), g.copy()  # slope: gradient of the model at new
    for _ in range(10_000):
        moved = 0.0
        for j in range(k):
            v = new[j] - slope[j] / h[j, j]
            v = np.sign(v) * max(abs(v) - l1 * pen[j] / h[j, j], 0.0)
            if v != new[j]:
                slope += h[:, j] * (v - new[j])
                moved, new[j] = max(moved, abs(v - new[j])), v
        if moved < 1e-12:
            break
    return new


class LogitSearch:
    """M5 for many penalties on the same rows (M9). The rows are packed once
    into blocks that stay in Spark; a fit minimises what ``logit`` minimises,
    weighted log loss / ``n_weight`` + penalty, by Newton steps from the fit
    before it. A step is one pass of partial sums (features^2 numbers a task);
    a fit takes a few, where a gradient method takes up to a hundred."""

    def __init__(self, df: DataFrame, features: list[str], label: str = "label", n_weight: float = 1.0):
        rows = df.select(*[F.col(c).cast("double") for c in [*features, label, "weight"]])
        self.features, self.n_weight = features, n_weight
        self.rows = reuse(rows.mapInArrow(_blocks, "x binary"))
        self.at = np.zeros(len(features) + 1)

    def _pass(self, at):
        parts = self.rows.mapInArrow(_moments(at), "m array<double>").collect()  # one row a task
        t, k = np.sum([r.m for r in parts], axis=0) / self.n_weight, len(at)
        return t[0], t[1:1 + k], t[1 + k:].reshape(k, k)

    def fit(self, C: float, l1_ratio: float = 0.0, max_iter: int = 100, tol: float = 1e-9) -> np.ndarray:
        """Coefficients in the features' order, then the intercept."""
        reg = 1.0 / (C * max(self.n_weight, 1.0))
        l1, l2 = reg * l1_ratio, reg * (1.0 - l1_ratio)

        def penalty(at):
            return l1 * np.abs(at[:-1]).sum() + 0.5 * l2 * (at[:-1] ** 2).sum()

        at = self.at
        loss, g, h = self._pass(at)
        for _ in range(max_iter):
            new = _newton_step(at, g, h, l1, l2)
            if np.abs(new - at).max() <= tol * max(1.0, np.abs(at).max()):
                break
            found = self._pass(new)
            while not found[0] + penalty(new) <= loss + penalty(at) + 1e-13 and np.abs(new - at).max() > tol:
                new = (new + at) / 2
                found = self._pass(new)
            at, (loss, g, h) = new, found
        self.at = at
        return at

    def scored(self, df: DataFrame, at: np.ndarray, out: str = "pd") -> DataFrame:
        margin = F.lit(float(at[-1]))
        for c, w in zip(self.features, at[:-1].tolist(), strict=True):
            margin = margin + F.lit(w) * F.col(c)
        return df.withColumn(out, 1 / (1 + F.exp(-margin)))


def gbt(features: list[str], label: str = "label", max_depth: int = 4, max_iter: int = 30,
        step: float = 0.1, seed: int = 42) -> Pipeline:
    """M6: gradient-boosted trees with class weights (nulls -> sentinel -1)."""
    g = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=max_depth,
                      maxIter=max_iter, stepSize=step, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features",
                                            handleInvalid="keep"), g])


def boosted(features: list[str], label: str, p: dict, seed: int = 42) -> Pipeline:
    """M9: boosted trees of one trial. Row and column shares, depth, step and
    rounds are the trial's; the two leaf penalties of the original library
    (``lambda``, ``alpha``) have no counterpart here and are left out."""
    g = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=p["max_depth"],
                      maxIter=p.get("n_estimators", 1000), stepSize=p["learning_rate"], subsamplingRate=p["subsample"],
                      featureSubsetStrategy=str(float(p["colsample_bytree"])), seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), g])


def with_sentinel(df: DataFrame, cols: list[str], value: float = -1.0) -> DataFrame:
    return df.fillna(value, subset=cols)


# ------------------------------------------------------------ M7 / M14
def lgd_forest(categorical: list[str], label: str = "lgd", num_trees: int = 50,
               max_depth: int = 6, seed: int = 42, min_split: int = 2) -> Pipeline:
    """M7: random-forest LGD regression on one-hot categorical features."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}__i" for c in categorical],
                        outputCols=[f"{c}__v" for c in categorical], dropLast=True, handleInvalid="keep")
    va = VectorAssembler(inputCols=[f"{c}__v" for c in categorical], outputCol="features")
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                               maxDepth=max_depth, minInstancesPerNode=max(1, min_split // 2), seed=seed)
    return Pipeline(stages=[*idx, ohe, va, rf])


#: most combinations of categories that ``CellForest`` holds in a task
MOST_CELLS = 4000
#: rows bootstrapped at a time
BOOT_ROWS = 2048


def _bootstrap(trees: int, cells: int, seed: int):
    """Task of a fit: for every tree, the number and label sum of the rows of
    each cell, every row taken Poisson(1) times."""
    def run(batches):
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        n, s = np.zeros((cells, trees)), np.zeros((cells, trees))
        for b in batches:
            at, label = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for a in range(0, len(at), BOOT_ROWS):
                order = np.argsort(at[a:a + BOOT_ROWS], kind="stable")
                cell, y = at[a:a + BOOT_ROWS][order], label[a:a + BOOT_ROWS][order]
                w = rng.poisson(1.0, (len(cell), trees)).astype(np.float64)
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                n[cell[first]] += np.add.reduceat(w, first)
                s[cell[first]] += np.add.reduceat(w * y[:, None], first)
        for t in range(trees):
            yield pa.record_batch([pa.array([t], pa.int32()), pa.array([np.r_[n[:, t], s[:, t]].tobytes()], pa.binary())], names=["tree", "sums"])

    return run


def _grown(has: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, least: int, rng) -> np.ndarray:
    """Prediction of one regression tree for every cell: splits on a random
    third of the levels, greatest fall of the variance, ``least`` rows a side."""
    pred, wide = np.zeros(len(n)), has.shape[1]
    open_ = [(np.arange(len(n)), 0)]
    while open_:
        at, d = open_.pop()
        rows, total = n[at].sum(), s[at].sum()
        pred[at] = total / rows if rows else 0.0
        if d == depth or rows < 2 * least or not wide:
            continue
        tried = rng.choice(wide, -(-wide // 3), replace=False)
        side = has[np.ix_(at, tried)]
        n1, s1 = n[at] @ side, s[at] @ side
        fit = np.flatnonzero((n1 >= least) & (rows - n1 >= least))
        if not len(fit):
            continue
        gain = s1[fit] ** 2 / n1[fit] + (total - s1[fit]) ** 2 / (rows - n1[fit]) - total ** 2 / rows
        k = gain.argmax()
        if gain[k] > 1e-12 * rows:
            yes = side[:, fit[k]] > 0
            open_ += [(at[yes], d + 1), (at[~yes], d + 1)]
    return pred


class CellForest:
    """M7 for many settings on the same rows (M9). With categories alone, all
    rows of a combination of levels (a cell) go the same way in every tree, so
    a tree needs only its bootstrapped row count and label sum of each cell.
    One pass over the rows bootstraps them for all trees; then each tree grows
    in a task of its own, from its cells. A fit reads the rows once, whatever
    its depth. For up to ``MOST_CELLS`` cells; see ``make``."""

    def __init__(self, cells: DataFrame, categorical: list[str], label: str):
        self.categorical, self.label = categorical, label
        found = [tuple(r) for r in cells.collect()]  # at most MOST_CELLS
        found.sort(key=lambda r: tuple((v is not None, str(v)) for v in r))
        levels = sorted({(i, str(v)) for r in found for i, v in enumerate(r) if v is not None})
        self.has = np.array([[float(r[i] is not None and str(r[i]) == v) for i, v in levels] for r in found]).reshape(len(found), len(levels))
        self.cells = found
        self.types = ", ".join(f"`__c{i}` {cells.schema[c].dataType.simpleString()}" for i, c in enumerate(categorical))

    @staticmethod
    def make(df: DataFrame, categorical: list[str], label: str) -> CellForest | None:
        """None where the rows have more than ``MOST_CELLS`` cells: take ``lgd_forest``."""
        cells = cut_lineage(df.select(*categorical).distinct())
        return CellForest(cells, categorical, label) if cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS else None

    def with_cells(self, df: DataFrame, values, name: str, kind: str) -> DataFrame:
        """``df`` with one value of its cell; rows of other cells keep a null."""
        told = df.sparkSession.createDataFrame([(*c, v) for c, v in zip(self.cells, values, strict=True)], f"{self.types}, `{name}` {kind}")
        same = [df[c].eqNullSafe(told[f"__c{i}"]) for i, c in enumerate(self.categorical)]
        return df.join(F.broadcast(told), same, "left").drop(*[f"__c{i}" for i in range(len(same))])

    def fit(self, rows: DataFrame, num_trees: int, max_depth: int, min_split: int, seed: int = 42) -> list[float]:
        """Prediction of each cell. ``rows``: (__cell, label), by ``with_cells``."""
        has, least = self.has, max(1, min_split // 2)

        def grow(batches):
            total, trees = np.zeros(len(has)), {}
            for b in batches:
                for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    trees[t] = trees.get(t, 0.0) + np.frombuffer(x)
            for t, x in sorted(trees.items()):
                total += _grown(has, x[:len(has)], x[len(has):], max_depth, least, np.random.default_rng([seed, 1, t]))
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["p"])

        boot = rows.select("__cell", F.col(self.label).cast("double")).where(f"`{self.label}` IS NOT NULL").mapInArrow(
            _bootstrap(num_trees, len(has), seed), "tree int, sums binary")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        parts = boot.repartition(min(num_trees, 4 * cores), "tree").mapInArrow(grow, "p binary").collect()  # cells numbers a task
        return (np.sum([np.frombuffer(r.p) for r in parts], axis=0) / num_trees).tolist()


def lgd_profile(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Id, predicted LGD clipped to [0, 1]."""
    out = model.transform(df)
    return out.select("id", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("lgd"))


# ------------------------------------------------------------ M11
def scorecard(lr_model: PipelineModel, features: list[str]) -> Column:
    """M11 from a fitted logit on WoE features: round(offset - factor x
    (intercept + sum coef x woe)); a missing feature counts 0."""
    lr = lr_model.stages[-1]
    coefs = lr.coefficients.toArray().tolist()
    margin = F.lit(float(lr.intercept))
    for f, w in zip(features, coefs):
        margin = margin + F.lit(float(w)) * F.coalesce(F.col(f), F.lit(0.0))
    return score_from_logodds(margin)


# ------------------------------------------------------------ C15
def iterative_impute(df: DataFrame, cols: list[str], rounds: int = 5, num_trees: int = 10,
                     seed: int = 42) -> DataFrame:
    """Start from medians, then per null column regress it on the other
    numeric columns (random forest) and refill its originally-null cells;
    ``rounds`` passes, lineage cut between passes. A forest trained only on
    rows without refilled cells would come out the same in every round and is
    fitted once."""
    d = reuse(df.select("*", *[F.col(c).isNull().alias(f"__null_{c}") for c in cols]))
    med = exact_quantiles(d, {c: (F.col(c), 0.5) for c in cols})
    n_holes = F.aggregate(F.array(*[F.col(f"__null_{c}").cast("int") for c in cols]), F.lit(0), lambda a, x: a + x)
    seen = d.agg(*[F.count_if(f"__null_{c}").alias(f"null {c}") for c in cols],
                 *[F.count_if(~F.col(f"__null_{c}") & (n_holes > 0)).alias(f"mixed {c}") for c in cols]).first()
    targets = [c for c in cols if seen[f"null {c}"]]
    d = d.fillna({c: float(v) for c, v in med.items() if v is not None})
    fitted: dict[str, PipelineModel] = {}
    for _ in range(rounds):
        for c in targets:
            m = fitted.get(c)
            if m is None:
                va = VectorAssembler(inputCols=[x for x in cols if x != c], outputCol="__f", handleInvalid="keep")
                rf = RandomForestRegressor(featuresCol="__f", labelCol=c, predictionCol="__pred",
                                           numTrees=num_trees, seed=seed)
                m = Pipeline(stages=[va, rf]).fit(d.filter(~F.col(f"__null_{c}")))
                if not seen[f"mixed {c}"]:  # no refilled cell among its training rows: the next rounds fit the same
                    fitted[c] = m
            d = m.transform(d).withColumn(c, F.when(F.col(f"__null_{c}"), F.col("__pred")).otherwise(F.col(c))) \
                 .drop("__f", "__pred")
        d = cut_lineage(d)
    return d.drop(*[f"__null_{c}" for c in cols])


def mse(model_out: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse").evaluate(model_out)
