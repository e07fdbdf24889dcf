"""Reading inputs and keeping intermediate results."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loanbook
from loanbook.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``kept`` results that nothing reads any more."""
    for df in frames:
        if (at := getattr(df, "_kept_at", None)) is not None:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with an
    operator's own names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def ship(spark: SparkSession) -> None:
    """Make this package importable in the tasks (as ``--py-files`` would):
    sent once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_loanbook_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(loanbook.__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="loanbook-"), "loanbook.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "loanbook")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    sc._loanbook_shipped = True


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what
    one operator's task has freed would else be held beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _task(batches, worker, fixed):
    try:
        yield from worker(batches, **fixed)
    finally:
        _give_back()


def map_arrow(df: DataFrame, worker, schema, **fixed) -> DataFrame:
    """``mapInArrow`` of a task function with its parameters bound."""
    ship(df.sparkSession)
    return df.mapInArrow(functools.partial(_task, worker=worker, fixed=fixed), schema)
