"""Key-based joins and set operations.

Positional alignment in the original becomes joins on ``id``. Semi and
anti joins carry only the key from the right side; Spark shuffles both
sides on ``id`` (or broadcasts a side its statistics prove small, under
``spark.sql.autoBroadcastJoinThreshold``), and AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profiles(pd_profile: DataFrame, lgd_profile: DataFrame) -> DataFrame:
    """Inner equi-join of PD and LGD profiles on id."""
    return pd_profile.join(lgd_profile, "id", "inner")


def compile_left(prices: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Prices left-joined to features; on a name clash the left column
    is kept; the key comes first. Duplicate right keys fan out."""
    clash = set(prices.columns) - {key}
    right = features.select(*[c for c in features.columns if c == key or c not in clash])
    out = prices.join(right, key, "left")
    return out.select(key, *[c for c in out.columns if c != key])


def sync_by_id(a: DataFrame, b: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Keep the ids present in both tables (two semi joins)."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return a.join(kb, key, "left_semi"), b.join(ka, key, "left_semi")


def sync_training(pd_train: DataFrame, lgd_train: DataFrame, lgd_pred: DataFrame,
                  key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids as strings; PD and LGD-train restricted to their common ids;
    the ongoing set passes unchanged."""
    cast = lambda df: df.withColumn(key, F.col(key).cast("string"))
    a, b = sync_by_id(cast(pd_train), cast(lgd_train), key)
    return a, b, cast(lgd_pred)


def sync_scoring(pd_score: DataFrame, exog: DataFrame, key: str = "id") -> DataFrame:
    """Exogenous rows restricted to the ids surviving the PD cleaning."""
    return exog.join(pd_score.select(key).distinct(), key, "left_semi")


def financials(scores: DataFrame, exog: DataFrame, fin: DataFrame, key: str = "id") -> DataFrame:
    """Scores x int_rate x financial columns, chained inner joins on id."""
    return scores.join(exog.select(key, "int_rate"), key, "inner").join(fin, key, "inner")


def intersect_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids present in both."""
    return a.select(key).intersect(b.select(key))


def except_rows(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b`` (anti join)."""
    return a.join(b.select(key), key, "left_anti")


def stack(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
