"""Sources and sinks (S1-S8) and schema routing helpers.

Every reader declares its schema (no inference pass over the data);
column projection and filters stay lazy so Catalyst prunes the scan.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook.constants import ACCEPTED_TYPES

_TYPES = {
    "id": "string", "loan_amnt": "double", "funded_amnt": "double", "annual_inc": "double",
    "dti": "double", "term": "string", "int_rate": "double", "installment": "double",
    "grade": "string", "emp_title": "string", "emp_length": "string", "home_ownership": "string",
    "verification_status": "string", "purpose": "string", "title": "string", "zip_code": "string",
    "addr_state": "string", "disbursement_method": "string", "debt_settlement_flag": "string",
    "issue_d": "string", "earliest_cr_line": "string", "fico_range_high": "double",
    "policy_code": "double", "inq_last_6mths": "double", "total_rev_hi_lim": "double",
    "acc_open_past_24mths": "double", "avg_cur_bal": "double", "bc_open_to_buy": "double",
    "bc_util": "double", "mo_sin_old_rev_tl_op": "double", "mo_sin_rcnt_rev_tl_op": "double",
    "mo_sin_rcnt_tl": "double", "mort_acc": "double", "mths_since_recent_bc": "double",
    "mths_since_recent_inq": "double", "num_actv_rev_tl": "double", "num_tl_op_past_12m": "double",
    "total_rec_prncp": "double", "recoveries": "double", "collection_recovery_fee": "double",
    "total_pymnt": "double", "last_pymnt_amnt": "double", "out_prncp": "double",
    "loan_status": "string",
}

_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "long": T.LongType(),
          "int": T.IntegerType(), "date": T.DateType()}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    import uuid
    from loanbook.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV file (reads only the first line)."""
    return spark.read.option("header", True).csv(path).columns


def declared_schema(columns: list[str], types: dict[str, str] | None = None) -> T.StructType:
    types = types or ACCEPTED_TYPES
    return T.StructType([T.StructField(c, _TYPES[types.get(c, "string")], True) for c in columns])


#: the text of a row that doesn't fit the declared schema
CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str, types: dict[str, str] | None, names: list[str] | None, corrupt: bool) -> DataFrame:
    schema = declared_schema(names or header_columns(spark, path), types)
    reader = (spark.read.option("header", names is None).option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None,
             columns: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """S1 (+S3): CSV with a declared schema; malformed fields become null
    (PERMISSIVE). ``columns`` projects the scan; ``names`` are the columns of
    a file without a header."""
    df = _csv(spark, path, types, names, False)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_csv_quarantined(spark: SparkSession, path: str, types: dict[str, str] | None = None,
                         names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the declared schema, (``_corrupt_record``) the text
    of the others: too few or too many fields, or a field not of its type).
    Every row of the file is in one of the two."""
    df = _csv(spark, path, types, names, True)
    # a field is only checked where its column is read: the always true condition on all of them
    # makes a row's fitness the same whatever is selected
    df = df.where(F.hash(*[c for c in df.columns if c != CORRUPT]) >= F.lit(-(1 << 31)))
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_any(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Parquet by suffix, CSV otherwise."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, types)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Tabular sink, overwrite."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("ignoreLeadingWhiteSpace", False) \
         .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """A one-row report (struct columns nest) as JSON; lists of loans
    stay tables (use :func:`write_table`)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def matrix_json(tpm) -> str:
    """The ``{"tpm": [[...]]}`` document for a migration matrix."""
    return json.dumps({"tpm": np.asarray(tpm, dtype=float).tolist()})


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A JSON matrix document to the long table (from_state, to_state, p)."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("tpm").alias("from_state", "row"))
    return rows.select(F.col("from_state").cast("int"),
                       F.posexplode("row").alias("to_state", "p")) \
               .select("from_state", F.col("to_state").cast("int"), F.col("p").cast("double"))


def matrix_from_table(long: DataFrame) -> np.ndarray:
    """The states x states matrix from its long table (constant size)."""
    rows = long.select("from_state", "to_state", "p").collect()  # states^2 rows
    n = 1 + max(max(r.from_state, r.to_state) for r in rows)
    m = np.zeros((n, n))
    for r in rows:
        m[r.from_state, r.to_state] = r.p
    return m


def save_model(model, path: str) -> None:
    """Fitted pipeline persisted with ML persistence."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_bins(spark: SparkSession, woe_model, path: str) -> None:
    """WoE bins as a Parquet table (feature, bin, lower, upper, woe)."""
    rows = []
    for f, e in woe_model.edges.items():
        lo = [None] + list(e)
        hi = list(e) + [None]
        rows += [(f, i, lo[i], hi[i], float(w)) for i, w in enumerate(woe_model.woe[f])]
    spark.createDataFrame(rows, "feature STRING, bin INT, lower DOUBLE, upper DOUBLE, woe DOUBLE") \
         .write.mode("overwrite").parquet(path)


def load_bins(spark: SparkSession, path: str):
    from loanbook.operators.binning import WoEModel
    rows = spark.read.parquet(path).orderBy("feature", "bin").collect()  # bins x features
    edges, woe = {}, {}
    for r in rows:
        edges.setdefault(r.feature, [])
        woe.setdefault(r.feature, [])
        if r.lower is not None:
            edges[r.feature].append(r.lower)
        woe[r.feature].append(r.woe)
    return WoEModel(edges, woe)
