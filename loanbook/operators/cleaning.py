"""Cleaning rules C1-C17 as DataFrame -> DataFrame functions.

All rules are column expressions or partial aggregates. Statistics a rule
needs (null shares, medians, percentiles) come from one aggregate job each
whose result has one value per column, never per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook import constants as K
from loanbook.functions.numeric import inf_to_null, nan_to_null
from loanbook.functions.quantiles import exact_quantile, exact_quantiles
from loanbook.session import reuse

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def normalise_nan(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN in floating columns becomes null (Spark keeps NaN
    distinct from null; the original treats both as missing)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[nan_to_null(c).alias(c) if c in fl else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ C1 - C4
def drop_duplicate_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Exact duplicate rows removed. With ``key`` (an added application
    key) the key is left out of the comparison and the smallest is kept."""
    if key is None:
        return df.dropDuplicates()
    other = [c for c in df.columns if c != key]
    return df.groupBy(*other).agg(F.min(key).alias(key)).select(*df.columns)


def drop_sparse_rows(df: DataFrame, share: float = K.ROW_NULL_THRESHOLD) -> DataFrame:
    """Keep rows with at least int(share * ncols) non-null values."""
    return df.dropna(thresh=int(len(df.columns) * share))


def null_shares(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per-column null share, one aggregate over all columns."""
    cols = cols or df.columns
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def drop_sparse_columns(df: DataFrame, limit: float = K.COLUMN_NULL_LIMIT,
                        keep: list[str] | None = None) -> DataFrame:
    """Drop columns whose null share exceeds ``limit``, except crucial ones.

    One aggregate job returns one share per column (bounded by the schema);
    the column list is then chosen on the driver."""
    keep = set(keep if keep is not None else K.CRUCIAL_COLUMNS + K.ALWAYS_KEEP)
    test = [c for c in df.columns if c not in keep]
    if not test:
        return df
    shares = null_shares(df, test).first().asDict()
    return df.select(*[c for c in df.columns if c in keep or (shares[c] or 0.0) <= limit])


def require_data(df: DataFrame) -> DataFrame:
    """C4: raise on an empty table or one whose every value is null.

    One aggregate (row count, rows with any value); on a persisted input it
    also fills the cache for the passes that follow."""
    any_value = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in df.columns])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_value).alias("k")).first()
    if not r.n:
        raise ValueError("empty table: no rows received")
    if not r.k:
        raise ValueError("table contains only null values")
    return df


def initial_clean(df: DataFrame) -> DataFrame:
    """C1 + C2 + C3 after the C4 guard (the input is read by the guard,
    the share statistics and the result, so it is kept once)."""
    df = reuse(df)
    require_data(df)
    return drop_sparse_columns(reuse(drop_sparse_rows(drop_duplicate_rows(df))))


# ------------------------------------------------------------------ C5
def coerce_types(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """C5 (optional, off for parity): numeric columns lose ``% $ ,`` and
    unparsable text becomes null; other mapped columns become strings."""
    out = []
    for c in df.columns:
        t = type_map.get(c)
        if t in ("double", "float64", "float"):
            out.append(F.regexp_replace(F.col(c).cast("string"), "[%$,]", "")
                       .try_cast("double").alias(c))
        elif t in ("string", "object"):
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------------ C6 - C10
def sanitize_string(c: Column) -> Column:
    """C6 for one column: trim whitespace, strip edge commas, placeholders
    to null (no second trim after the commas)."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^,+|,+$", "")
    return F.when(s.isin(K.STRING_PLACEHOLDERS), F.lit(None).cast("string")).otherwise(s)


def sanitize_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = set(cols if cols is not None else string_columns(df))
    return df.select(*[sanitize_string(F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def sanitize_number(c: Column, exempt: bool) -> Column:
    """C7 for one column: -1 is null; other negatives null unless exempt."""
    bad = (c == -1) if exempt else ((c == -1) | (c < 0))
    return F.when(bad, F.lit(None)).otherwise(c)


def sanitize_numbers(df: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    exempt = set(exempt if exempt is not None else K.NEGATIVE_EXEMPT)
    nums = set(numeric_columns(df))
    return df.select(*[sanitize_number(F.col(c), c in exempt).alias(c) if c in nums else F.col(c)
                       for c in df.columns])


def clean_id(df: DataFrame, on_bad_id: str = "zero") -> DataFrame:
    """Id as LONG; unparsable or null ids become 0 (``zero``), are
    dropped (``drop``) or raise (``raise``)."""
    if "id" not in df.columns:
        return df
    raw = F.col("id").cast("string").try_cast("double").try_cast("long")
    if on_bad_id == "drop":
        return df.withColumn("id", raw).filter(F.col("id").isNotNull())
    if on_bad_id == "raise":
        if df.filter(raw.isNull()).limit(1).count():
            raise ValueError("unparsable or null id")
        return df.withColumn("id", raw)
    return df.withColumn("id", F.coalesce(raw, F.lit(0).cast("long")))


def parse_date(c: Column) -> Column:
    """C9: 'Dec-2015' or ISO text to DATE; anything else null."""
    s = c.cast("string")
    return F.coalesce(F.try_to_timestamp(s, F.lit("MMM-yyyy")),
                      F.try_to_timestamp(s)).cast("date")


def parse_dates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or K.DATE_COLUMNS) if c in df.columns]
    types = dict(df.dtypes)
    return df.select(*[parse_date(F.col(c)).alias(c) if c in cols and types[c] == "string"
                       else F.col(c).cast("date").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def normalise_term(df: DataFrame) -> DataFrame:
    """Collapse whitespace runs in ``term`` and trim."""
    if "term" not in df.columns:
        return df
    return df.withColumn("term", F.trim(F.regexp_replace(F.col("term").cast("string"), r"\s+", " ")))


def sanitize(df: DataFrame) -> DataFrame:
    """C6 + C7 + C8 + C9 + C10 in the original order."""
    d = sanitize_numbers(sanitize_strings(df))
    return normalise_term(parse_dates(clean_id(d)))


def clean_accepted(df: DataFrame) -> DataFrame:
    """C11: the accepted-loan cleaner."""
    return sanitize(initial_clean(normalise_nan(df)))


# ------------------------------------------------------------------ C12
def clean_rejected(df: DataFrame) -> DataFrame:
    """Rejected applications mapped to master names and cleaned."""
    d = df.withColumnsRenamed({k: v for k, v in K.REJECTED_RENAME.items() if k in df.columns})
    d = drop_duplicate_rows(d)
    strs = set(string_columns(d))
    cols = []
    for c in d.columns:
        x = sanitize_string(F.col(c)) if c in strs else F.col(c)
        if c in ("loan_amnt", "fico_range_high"):
            x = x.cast("string").try_cast("double")
            x = F.when(x < 0, F.lit(None)).otherwise(x)
        elif c == "policy_code":
            x = x.cast("string").try_cast("double")
        elif c == "dti":
            x = F.regexp_replace(x.cast("string"), "%", "").try_cast("double")
        elif c == "issue_d":
            x = parse_date(x)
        else:
            x = x.cast("string")
        cols.append(x.alias(c))
    return d.select(*cols).dropna(how="all")


# ------------------------------------------------------------------ C13, C17
def blanks_to_null(df: DataFrame) -> DataFrame:
    """Empty or whitespace-only strings become null."""
    strs = set(string_columns(df))
    return df.select(*[F.when(F.col(c).rlike(r"^\s*$"), F.lit(None).cast("string"))
                       .otherwise(F.col(c)).alias(c) if c in strs else F.col(c)
                       for c in df.columns])


def infinities_to_null(df: DataFrame) -> DataFrame:
    """C17: +/- infinity become null in floating columns."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[inf_to_null(c).alias(c) if c in fl else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ C14
def _null_policy_plan(df: DataFrame, nums: list[str], crucial: set[str],
                      drop_share: float) -> list[tuple[str, str, list[str]]]:
    """Replay the order-dependent policy: [(column, 'drop'|'fill', dropped-before)].

    One aggregate gives the null counts of all columns still to come over the
    rows alive. They hold until a column drops rows, so there is one pass more
    for every column that does, and each returns a single row."""
    plan, dropped, rest = [], [], list(nums)
    while rest:
        alive = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in dropped], F.lit(True))
        r = df.filter(alive).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"k{j}") for j, c in enumerate(rest)]).first()
        if not r.n:
            break
        for j, c in enumerate(rest):
            share = r[f"k{j}"] / r.n
            if share and (c in crucial or share >= drop_share):
                plan.append((c, "drop", list(dropped)))
                dropped.append(c)
                rest = rest[j + 1:]
                break
            if share:
                plan.append((c, "fill", list(dropped)))
        else:
            break
    return plan


def handle_missing(df: DataFrame, crucial: list[str] | None = None,
                   drop_share: float = K.MISSING_DROP_SHARE,
                   exempt: tuple[str, ...] = ("id",)) -> DataFrame:
    """C14: the median form of the missing-value policy.

    Rows with a null in any string column (except ``exempt``) are dropped;
    then each numeric column, in column order on the shrinking table, is
    skipped (no nulls), drops its null rows (crucial, or share >= 5 %) or is
    filled with its median at that point. Medians are exact, computed in one
    aggregate with a per-column filter for the rows alive at that step.
    """
    crucial = set(crucial if crucial is not None else K.MISSING_CRUCIAL)
    d = blanks_to_null(df)
    strs = [c for c in string_columns(d) if c not in exempt]
    if strs:
        d = d.dropna(subset=strs)
    d = reuse(d)  # read by the pattern count, the medians and the result
    nums = numeric_columns(d)  # a numeric id is tested like any other column
    plan = _null_policy_plan(d, nums, crucial, drop_share)
    drops = [c for c, a, _ in plan if a == "drop"]
    fills = [(c, before) for c, a, before in plan if a == "fill"]
    wanted = {}
    for c, before in fills:  # exact medians over the rows alive at that step
        alive = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in before], F.lit(True))
        wanted[c] = (F.when(alive, F.col(c)), 0.5)
    medians = exact_quantiles(d, wanted)
    if drops:
        d = d.dropna(subset=drops)
    if medians:
        d = d.select(*[F.coalesce(F.col(c), F.lit(medians[c]).cast(t)).alias(c) if c in medians
                       else F.col(c) for c, t in d.dtypes])
    return d


# ------------------------------------------------------------------ C16
def review_clean(df: DataFrame, stats: dict | None = None) -> tuple[DataFrame, dict]:
    """Initial-review cleaning. ``issue_d`` becomes its year (nulls take
    the median year); ``dti`` is capped at its 99th percentile, nulls take
    the median of the capped values; null ``fico_range_high`` becomes -1.

    ``stats`` fitted on one batch can be reused on another (fit/transform);
    without it they come from ``df`` itself, as in the original.
    """
    d = reuse(drop_duplicate_rows(df))
    if "issue_d" in d.columns:
        d = d.withColumn("issue_d", F.year(parse_date(F.col("issue_d")) if dict(d.dtypes)["issue_d"] == "string"
                                           else F.col("issue_d")).cast("double"))
    if stats is None:
        stats = {}
        if "issue_d" in d.columns:
            stats["year_median"] = exact_quantile(d, "issue_d", 0.5)
        if "dti" in d.columns:
            cap = exact_quantile(d, "dti", 0.99)
            stats["dti_cap"] = cap
            # least() skips nulls: guard so a missing dti stays missing
            capped = F.when(F.col("dti").isNull(), F.lit(None)).otherwise(
                F.least(F.col("dti"), F.lit(cap))) if cap is not None else F.col("dti")
            stats["dti_median"] = exact_quantile(d.select(capped.alias("dti")), "dti", 0.5)
    if "issue_d" in d.columns:
        d = d.withColumn("issue_d", F.coalesce("issue_d", F.lit(stats.get("year_median")).cast("double")))
    if "dti" in d.columns:
        cap = stats.get("dti_cap")
        capped = F.when(F.col("dti").isNull(), F.lit(None)).otherwise(
            F.least(F.col("dti"), F.lit(cap))) if cap is not None else F.col("dti")
        d = d.withColumn("dti", F.coalesce(capped, F.lit(stats.get("dti_median")).cast("double")))
    if "fico_range_high" in d.columns:
        d = d.withColumn("fico_range_high", F.coalesce("fico_range_high", F.lit(-1.0)))
    return d, stats
