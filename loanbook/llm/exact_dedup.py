"""Exact dedup: groups by a 128-bit content hash, checked byte by byte. Native.

Main path: DataFrame functions only. The hashes that occur more than once, and
of these the ones with different texts, are written first: so their size is
known when the rows meet them. While they are few, the rows meet them without
a shuffle, and texts cross one only inside groups, as the smallest and largest
of each map task; else the rows are shuffled by their hash. Rows meet by (hash,
text where the hash collides), so two different texts of one hash never share a
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.tables import kept, only, unused


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: its id, the id that stays in its group of equal
    texts (smallest with ``keep='min'``, largest with ``keep='max'``), the
    group's rows, whether this row stays, and the SHA-256 of the text.

    Null texts count as empty, so nulls and empty texts form one group. Rows
    that repeat an id and a text are all in the group, and all of them that
    carry the staying id are marked ``kept`` (an exact repeat of a row is the
    same document). Null ids never win over other ids. An empty table gives
    an empty result; further columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = only(docs, id_col, text_col).toDF("doc_id", "__text").select(
        "doc_id", text.alias("__text"), hash128(text).alias("__h"))
    # hashes that occur more than once, from the hash column alone
    repeated = kept(rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h"), "repeated")
    # byte comparison inside groups: the smallest and the largest text of a
    # hash are equal only if all are; one text per map task and hash travels
    collided = kept(rows.join(repeated, "__h", "left_semi").groupBy("__h")
                    .agg(F.min("__text").alias("__lo"), F.max("__text").alias("__hi"))
                    .where("__lo <> __hi").select("__h", F.lit(True).alias("__c")), "collided")
    keyed = (rows.join(collided, "__h", "left")
             .select("doc_id", "__h", F.when(F.col("__c"), F.col("__text")).alias("__variant"),
                     F.unhex(F.sha2("__text", 256)).alias("__sha")))
    groups = (keyed.groupBy("__h", "__variant")
              .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .withColumnsRenamed({"__h": "__gh", "__variant": "__gv"}))
    return (keyed.join(groups, (F.col("__h") == F.col("__gh")) & F.col("__variant").eqNullSafe(F.col("__gv")))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("__sha")).alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    name, = unused(docs, "__keep")
    stay = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, docs[f"`{id_col}`"].eqNullSafe(F.col(name)), "left_semi")
