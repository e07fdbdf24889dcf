"""Training-data pipeline over ``documents``: reject toxic texts, drop repeated
lines, keep one document of each near-duplicate group, mix the sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanbook.llm import line_dedup, mixing, ngram_join, packing, toxicity  # noqa: E402
from loanbook.llm.encoding import vocabulary_path  # noqa: E402
from loanbook.llm.tables import scratch_path, table, unused  # noqa: E402


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nnPU classifier doesn't reject (operator 2). Each row
    is scored by its own text: rows that repeat an id or a text are decided
    alike, null and empty texts have no feature and stay, further columns pass
    through, and an empty table, or one without toxic labels, loses nothing."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one (operator 6). A document
    all of whose lines are repeats goes; ``n_chars`` follows the text. Null,
    empty and blank texts stay as they are, rows that repeat an id and a text
    are one document, further columns pass through whatever their names, and
    an empty table stays empty."""
    lines, dropped = unused(docs, "__lines", "__dropped")
    out = line_dedup.dedup_lines(docs, lines, dropped).where((F.col(lines) == 0) | (F.col(dropped) < F.col(lines)))
    return (out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component (operator 1). Rows that
    repeat an id stay or go together; rows without an id or without words
    stay; further columns pass through; an empty table stays empty."""
    return ngram_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 10). Rows that
    repeat an id, source and size are taken equally often; a null source is a
    source of its own; texts without words add nothing to a total; further
    columns pass through whatever their names; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (operator 8). Every row is packed, repeated
    ones too; a null or empty text is one piece of one id; further columns
    don't matter; an empty table gives no piece."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, size=2048, with_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the learned first stage and the drawn mix have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
