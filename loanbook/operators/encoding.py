"""Categorical encoders (M1 ordinal, M2 one-hot with a dropped baseline).

The category dictionary is built on Spark: distinct values, numbered in
lexicographic order by :func:`loanbook.operators.sampling.dense_index`
(no driver-side list), then applied with a left join on the value. The
join side is one row per category; Spark broadcasts it when its statistics
prove it small and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook.operators.sampling import dense_index

NULL_CATEGORY = "nan"


def as_category(col: str):
    """String form used for fitting: null is the category 'nan'."""
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_CATEGORY))


def _categories(train: DataFrame, values: dict) -> DataFrame:
    """Distinct (feature, category) of all columns in one grouped pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("category")) for f, v in values.items()]))
    return train.select(pairs.alias("x")).select("x.*").where("category IS NOT NULL").distinct()


def fit_ordinal(train: DataFrame, cols: list[str]) -> DataFrame:
    """M1 fit: (feature, category, code) with codes 0.. in lexicographic order."""
    numbered = dense_index(_categories(train, {c: as_category(c) for c in cols}), ["feature", "category"], "code")
    first = numbered.groupBy("feature").agg(F.min("code").alias("__first"))  # one row a column
    return numbered.join(first, "feature").select("feature", "category", (F.col("code") - F.col("__first")).alias("code"))


def apply_ordinal(df: DataFrame, dictionary: DataFrame, cols: list[str], unknown: int = -1) -> DataFrame:
    """M1 transform: replace each column by its code; unseen values get -1."""
    out = df
    for c in cols:
        d = dictionary.filter(F.col("feature") == c).select(F.col("category").alias(f"__cat_{c}"),
                                                             F.col("code").alias(f"__code_{c}"))
        out = out.withColumn(f"__cat_{c}", as_category(c)).join(d, f"__cat_{c}", "left")
        out = out.withColumn(c, F.coalesce(F.col(f"__code_{c}"), F.lit(unknown)).cast("long")) \
                 .drop(f"__cat_{c}", f"__code_{c}")
    return out


def fit_onehot(train: DataFrame, cols: list[str]) -> DataFrame:
    """M2 fit: (feature, category, index) of the fitted categories but each
    feature's first (lexicographically smallest), the dropped baseline. The
    index counts from 0 in the order of (feature, category)."""
    every = _categories(train, {c: F.col(c).cast("string") for c in cols})
    base = every.groupBy("feature").agg(F.min("category").alias("__base"))  # one row a column
    kept = every.join(base, "feature").where(F.col("category") != F.col("__base")).select("feature", "category")
    return dense_index(kept, ["feature", "category"], "index")


SPARSE = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: Column, indices: Column) -> Column:
    """ML vector of ones at the ascending ``indices``, built on the JVM."""
    ones = F.transform(indices, lambda _: F.lit(1.0))
    parts = F.struct(F.lit(0).cast("byte").alias("type"), size.cast("int").alias("size"), indices.cast("array<int>").alias("indices"), ones.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), SPARSE)["v"]


def apply_onehot(df: DataFrame, levels: DataFrame, cols: list[str], out: str = "onehot") -> DataFrame:
    """M2 transform: one sparse vector a row, by a join of each column's value
    to its index. The baseline, nulls and unseen values add no entry."""
    size = levels.count()
    d = df
    for c in cols:
        own = levels.where(F.col("feature") == c).select(F.col("category").alias(f"{out} {c}"), F.col("index").alias(f"{out} i {c}"))
        d = d.join(own, d[c].cast("string") == own[f"{out} {c}"], "left").drop(f"{out} {c}")
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"`{out} i {c}`") for c in cols])))
    return d.withColumn(out, sparse_vector(F.lit(size), found)).drop(*[f"{out} i {c}" for c in cols])


def apply_onehot_wide(df: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """M2 transform in wide form for a fitted level list (feature, category):
    one 0/1 column ``feature_category`` per level; unseen values are all 0."""
    cols = [(F.col(f).cast("string") == F.lit(v)).cast("int").alias(f"{f}_{v.strip()}")
            for f, v in levels]
    return df.select("*", *[F.coalesce(c, F.lit(0)) for c in cols])
