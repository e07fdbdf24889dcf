"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "loanbook",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster ``master`` is left to ``spark-submit``; in tests pass
    ``local[*]``. The Spark UI stays off: no port beyond what the session
    needs itself.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("LOANBOOK_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The setting ``spark.checkpoint.dir`` wins. Only when it is unset (local
    tests) a scratch folder is created, so a cluster job never writes to a
    machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="loanbook-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:  # mirror it in the session conf where the session allows that
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some sessions reject core confs at runtime
            pass
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint). Used between passes
    of iterative operators.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep an input that an operator reads more than once (statistics pass,
    then the result). MEMORY_AND_DISK; a block lost with an executor is
    recomputed from lineage, so results stay correct."""
    from pyspark import StorageLevel
    if df.storageLevel == StorageLevel.NONE:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def spread(df: DataFrame) -> DataFrame:
    """A checkpointed table in equal parts, a whole number for every core, so
    that the many passes of an iterative fit keep all cores busy. Never fewer
    parts than before; a table of fewer parts than cores (small) stays as it is."""
    now, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-now // cores) * cores
    return df if now < cores or now == wanted else cut_lineage(df.repartition(wanted))
