"""Hyper-parameter search that learns from its earlier trials (M9).

The search space names one range per parameter: ``Uniform``, ``LogUniform``,
``Whole`` (whole numbers) or ``Choice``. The first ``startup`` trials are
random. After that the trials so far are split into the better few and the
rest; a Parzen estimate (a mixture of one kernel per trial and a flat prior)
of each part gives the densities l and g, candidates are drawn from l, and the
one of greatest l / g is tried next. Parameters are treated one by one. The
same seed proposes the same trials.

A trial fits and scores on Spark; the driver holds the history, one row a trial.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Uniform:
    lo: float
    hi: float

    def to_unit(self, v):
        return (v - self.lo) / (self.hi - self.lo)

    def of_unit(self, u):
        return self.lo + u * (self.hi - self.lo)


@dataclass(frozen=True)
class LogUniform:
    lo: float
    hi: float

    def to_unit(self, v):
        return math.log(v / self.lo) / math.log(self.hi / self.lo)

    def of_unit(self, u):
        return min(self.hi, max(self.lo, self.lo * (self.hi / self.lo) ** u))


@dataclass(frozen=True)
class Whole:
    lo: int
    hi: int

    def to_unit(self, v):
        return (v - self.lo + 0.5) / (self.hi - self.lo + 1)

    def of_unit(self, u):
        return min(self.hi, self.lo + int(u * (self.hi - self.lo + 1)))


@dataclass(frozen=True)
class Choice:
    options: tuple


def _bump(x: float, m: float, s: float) -> float:
    """Density at x of a normal kernel cut to [0, 1]."""
    inside = 0.5 * (math.erf((1 - m) / (s * math.sqrt(2))) - math.erf((0 - m) / (s * math.sqrt(2))))
    return math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * max(inside, 1e-12))


def _widths(points: list[float]) -> list[float]:
    """Kernel widths: the larger gap to a neighbour, within bounds."""
    order = sorted(points)
    out = []
    for p in points:
        k = order.index(p)
        gaps = [p - order[k - 1] if k else p, (order[k + 1] if k + 1 < len(order) else 1.0) - p]
        out.append(min(1.0, max(max(gaps), 1.0 / min(100.0, 1.0 + len(points)))))
    return out


@dataclass
class Tuner:
    space: dict
    maximise: bool
    seed: int = 42
    startup: int = 10
    candidates: int = 24
    history: list = field(default_factory=list)  # (parameters, metric)

    def __post_init__(self):
        self._rng = random.Random(self.seed)

    def _random(self, r):
        return self._rng.choice(r.options) if isinstance(r, Choice) else r.of_unit(self._rng.random())

    def _split(self):
        ranked = sorted(self.history, key=lambda t: -t[1] if self.maximise else t[1])
        few = max(1, min(25, math.ceil(0.1 * len(ranked))))
        return [p for p, _ in ranked[:few]], [p for p, _ in ranked[few:]]

    def propose(self) -> dict:
        """The next trial's parameters."""
        if len(self.history) < self.startup:
            return {n: self._random(r) for n, r in self.space.items()}
        good, rest = self._split()
        return {n: self._guided(r, [p[n] for p in good], [p[n] for p in rest]) for n, r in self.space.items()}

    def _guided(self, r, good, rest):
        if isinstance(r, Choice):
            def weight(values):
                return [(1.0 + sum(v == o for v in values)) / (len(r.options) + len(values)) for o in r.options]
            lw, gw = weight(good), weight(rest)
            drawn = self._rng.choices(range(len(r.options)), lw, k=self.candidates)
            return r.options[max(drawn, key=lambda i: lw[i] / gw[i])]
        a, b = [r.to_unit(v) for v in good], [r.to_unit(v) for v in rest]
        wa, wb = _widths(a), _widths(b)

        def density(x, points, widths):
            return (1.0 + sum(_bump(x, m, s) for m, s in zip(points, widths, strict=True))) / (1 + len(points))

        xs = []
        for _ in range(self.candidates):
            k = self._rng.randrange(len(a) + 1)  # one of the kernels, or the flat prior
            x = self._rng.random() if k == len(a) else self._rng.gauss(a[k], wa[k])
            while not 0.0 <= x < 1.0:
                x = self._rng.gauss(a[k], wa[k])
            xs.append(x)
        return r.of_unit(max(xs, key=lambda x: density(x, a, wa) / density(x, b, wb)))

    def tell(self, params: dict, metric: float) -> None:
        self.history.append((params, metric))

    def run(self, trial: Callable[[dict], float], trials: int) -> dict:
        """Best parameters after so many trials."""
        for _ in range(trials):
            params = self.propose()
            self.tell(params, float(trial(params)))
        return self.best()[0]

    def best(self) -> tuple[dict, float]:
        return (max if self.maximise else min)(self.history, key=lambda t: t[1])

    def table(self, spark: SparkSession) -> DataFrame:
        """(trial, parameters as JSON, metric, best: no earlier or later trial is better)."""
        top = self.best()[1]
        first = next(i for i, (_, m) in enumerate(self.history) if m == top)
        return spark.createDataFrame([(i, json.dumps(p, sort_keys=True), m, i == first) for i, (p, m) in enumerate(self.history)],
                                     "trial INT, parameters STRING, metric DOUBLE, best BOOLEAN")


# --- fixed values: the searched ranges and trial counts ---------------------
SEARCHES = {
    "pricing_logit": ({"C": LogUniform(1e-4, 10.0)}, 50),
    "pd_logit": ({"C": LogUniform(1e-4, 10.0), "penalty": Choice(("l1", "l2"))}, 15),
    "pd_boosted": ({"n_estimators": Whole(100, 1000), "max_depth": Whole(3, 8), "learning_rate": LogUniform(0.01, 0.2),
                    "subsample": Uniform(0.6, 1.0), "colsample_bytree": Uniform(0.6, 1.0)}, 15),
    "review_boosted": ({"lambda": LogUniform(1e-3, 10.0), "alpha": LogUniform(1e-3, 10.0), "colsample_bytree": Choice((0.5, 0.7, 1.0)),
                        "subsample": Choice((0.6, 0.8, 1.0)), "learning_rate": LogUniform(0.01, 0.1), "max_depth": Whole(3, 9)}, 15),
    "lgd_forest": ({"n_estimators": Whole(100, 500), "max_depth": Whole(3, 10), "min_samples_split": Whole(2, 20)}, 15),
}


def search(name: str, fit, evaluate, maximise: bool, trials: int | None = None, space: dict | None = None, seed: int = 42) -> Tuner:
    """M9: one of ``SEARCHES`` (or its ``space`` and ``trials`` changed):
    ``fit`` turns a trial's parameters into a fitted model, ``evaluate`` gives
    the model's held-out metric. Returns the tuner with its history."""
    ranges, number = SEARCHES[name]
    tuner = Tuner(space or ranges, maximise, seed)
    tuner.run(lambda p: evaluate(fit(p)), number if trials is None else trials)
    return tuner
