"""Isotonic calibration at scale as an ML estimator (M8).

A block is (lo, hi, weight, label sum): a range of scores with one fitted
value. Pooling adjacent violators may be done in any order, so blocks are
merged where they stand: equal scores by a grouped sum, then within range
partitions of the score, then within coarser ranges of the blocks that are
left, until one range holds them all. What that last task holds is the model
itself, not the data: with 0/1 labels the blocks grow much slower than the rows.

The model is a table of segments. A score inside a block gets its value,
between two blocks it is interpolated, beyond the ends it gets the end's
value. Scores meet segments by an equi-join on a cell of the score range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanbook.session import cut_lineage

#: blocks pooled by one task
TASK_BLOCKS = 200_000
#: cells of the score range in the join of scores and segments
CELLS = 4096
BLOCK = "lo double, hi double, weight double, total double"


def pooled(lo, hi, weight, total):
    """Blocks in order of score after pooling: values strictly ascend."""
    out: list[list[float]] = []
    for a, b, w, s in zip(lo, hi, weight, total, strict=True):
        now = [a, b, w, s]
        while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:  # mean before >= mean now
            p = out.pop()
            now = [p[0], now[1], p[2] + now[2], p[3] + now[3]]
        out.append(now)
    return out


def _pool(batches):
    columns = [np.concatenate(c) for c in zip(*[[b.column(i).to_numpy() for i in range(4)] for b in batches], strict=True)]
    if columns and len(columns[0]):
        out = pooled(*[c.tolist() for c in columns])
        yield pa.record_batch([pa.array([r[i] for r in out], pa.float64()) for i in range(4)], names=["lo", "hi", "weight", "total"])


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, weight, total) of the weighted isotonic regression of ``label``
    on ``score``, ascending. Rows with a null (or NaN) score, label or weight,
    or a weight that isn't positive, take no part."""
    w = F.lit(1) if weight is None else F.col(weight)
    d = df.select(F.nullif(F.col(score).cast("double"), F.lit(float("nan"))).alias("x"), F.col(label).alias("y"), w.alias("w"))
    d = d.where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    blocks = d.groupBy("x").agg(F.sum("w").cast("double").alias("weight"), F.sum(F.col("w") * F.col("y")).cast("double").alias("total"))
    blocks = cut_lineage(blocks.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "weight", "total"))
    tasks = None
    while True:
        wanted = max(1, -(-blocks.count() // TASK_BLOCKS))
        tasks = wanted if tasks is None else min(wanted, tasks // 2)
        dealt = blocks.coalesce(1) if tasks <= 1 else blocks.repartitionByRange(tasks, "lo")
        blocks = cut_lineage(dealt.sortWithinPartitions("lo").mapInArrow(_pool, BLOCK))
        if tasks <= 1:
            return blocks


def _segments(batches):
    rows = [np.concatenate(c) for c in zip(*[[b.column(i).to_numpy() for i in range(4)] for b in batches], strict=True)]
    if not rows or not len(rows[0]):
        return
    lo, hi, v = rows[0], rows[1], rows[3] / rows[2]
    inf = np.array([np.inf])
    x0 = np.concatenate([-inf, lo, hi[:-1], hi[-1:]])
    x1 = np.concatenate([lo[:1], hi, lo[1:], inf])
    y0 = np.concatenate([v[:1], v, v[:-1], v[-1:]])
    y1 = np.concatenate([v[:1], v, v[1:], v[-1:]])
    closed = np.zeros(len(x0), bool)
    closed[1:len(lo) + 1] = True
    yield pa.record_batch([pa.array(c) for c in (x0, x1, y0, y1, closed)], names=["x0", "x1", "y0", "y1", "closed"])


class _IsotonicParams(Params):
    scoreCol = Param(Params._dummy(), "scoreCol", "score", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight; empty: 1", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "calibrated value", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(scoreCol="score", labelCol="label", weightCol="", outputCol="calibrated_pd")

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class PooledIsotonic(Estimator, _IsotonicParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``PooledIsotonicModel``; see the module's text."""

    @keyword_only
    def __init__(self, *, scoreCol=None, labelCol=None, weightCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PooledIsotonicModel:
        blocks = isotonic_blocks(df, self.get("scoreCol"), self.get("labelCol"), self.get("weightCol") or None)
        segments = blocks.coalesce(1).sortWithinPartitions("lo").mapInArrow(_segments, "x0 double, x1 double, y0 double, y1 double, closed boolean")
        return self._copyValues(PooledIsotonicModel(blocks, cut_lineage(segments)))


class PooledIsotonicModel(Model, _IsotonicParams, MLReadable, MLWritable):
    """Adds ``outputCol``. A null or NaN score, or a model without blocks, gives null."""

    def __init__(self, blocks: DataFrame | None = None, segments: DataFrame | None = None):
        super().__init__()
        self.blocks, self.segments = blocks, segments

    def _transform(self, df: DataFrame) -> DataFrame:
        ends = self.blocks.agg(F.min("lo"), F.max("hi")).first()
        lo, width = ends[0] or 0.0, ((ends[1] or 0.0) - (ends[0] or 0.0)) or 1.0
        out = self.get("outputCol")

        def cell(x):
            return F.greatest(F.least(F.floor((x - lo) / width * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")

        names = {c: f"{out} {c}" for c in ("cell", "x0", "x1", "y0", "y1", "closed")}
        own = self.segments.withColumn("cell", F.explode(F.sequence(cell(F.greatest("x0", F.lit(lo))), cell(F.least("x1", F.lit(lo + width))))))
        own = own.withColumnsRenamed(names)
        s = {c: F.col(f"`{n}`") for c, n in names.items()}
        x = F.nullif(F.col(self.get("scoreCol")).cast("double"), F.lit(float("nan")))
        inside = F.when(s["closed"], (x >= s["x0"]) & (x <= s["x1"])).otherwise((x > s["x0"]) & (x < s["x1"]))
        flat = s["y0"] == s["y1"]
        value = F.when(flat, s["y0"]).otherwise(s["y0"] + (s["y1"] - s["y0"]) * (x - s["x0"]) / (s["x1"] - s["x0"]))
        return df.join(own, (cell(x) == s["cell"]) & inside, "left").withColumn(out, value).drop(*names.values())

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.blocks.write.parquet(f"{path}/blocks")
        self.instance.segments.write.parquet(f"{path}/segments")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/segments"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
