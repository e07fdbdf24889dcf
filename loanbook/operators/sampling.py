"""Reproducible sampling and splitting.

Draw order: ``md5('<key>:<seed>')`` ascending, ties broken by the key and
then by every other column, so the same rows are drawn under any
partitioning (and DuckDB computes the same text).

Exact top-k without a global sort: the leading hex digits of the hash give
a bucket; one partial aggregate counts rows per (group, bucket); a running
sum over those counts finds, per group, the bucket holding the k-th row.
Rows in earlier buckets are in; only rows of that one boundary bucket are
ranked with a window. A group of any size is never gathered into one task:
the boundary bucket holds about count / 16^digits of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanbook.session import cut_lineage

BUCKET_HEX_DIGITS = 5  # 1,048,576 buckets per group


def draw_hash(key_cols: list[str], seed: int) -> Column:
    parts = [F.col(c).cast("string") for c in key_cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def draw_hash_sql(key_cols: list[str], seed: int) -> str:
    parts = [f"CAST({c} AS VARCHAR)" for c in key_cols]
    key = parts[0] if len(parts) == 1 else " || '|' || ".join(parts)
    return f"md5({key} || ':{seed}')"


def hash_long(h: Column) -> Column:
    """First 15 hex digits of the draw hash as a non-negative LONG."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _bounds(counts: DataFrame, k, group_cols: list[str]) -> DataFrame:
    """(group_cols..., __bb: the bucket that holds the k-th row, __need: how
    many of its rows are among the first k) from (group_cols..., __b, __n);
    both null where the group has no more than k rows."""
    if isinstance(k, DataFrame) and group_cols:
        counts = counts.join(k.toDF(*group_cols, "__k"), group_cols, "inner")
    elif isinstance(k, DataFrame):
        counts = counts.withColumn("__k", k.select("k").scalar())
    else:
        counts = counts.withColumn("__k", F.lit(int(k)).cast("long"))
    w = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__cum", F.sum("__n").over(w))
    at = F.when(F.col("__cum") >= F.col("__k"), F.struct("__b", (F.col("__k") - F.col("__cum") + F.col("__n")).alias("__need")))
    return (counts.groupBy(*group_cols).agg(F.min(at).alias("__s"))
            .select(*group_cols, F.col("__s.__b").alias("__bb"), F.col("__s.__need").alias("__need")))


def _bucket(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def _with_bounds(df: DataFrame, k, group_cols: list[str], key_cols: list[str], seed: int, digits: int) -> DataFrame:
    d = df.withColumn("__h", draw_hash(key_cols, seed)).withColumn("__b", _bucket(F.col("__h"), digits))
    bound = _bounds(d.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__n")), k, group_cols)
    if group_cols:
        return d.join(bound, group_cols, "inner")  # adaptive execution places it by its size
    return d.withColumn("__bb", bound.select("__bb").scalar()).withColumn("__need", bound.select("__need").scalar())


def top_k_per_group(df: DataFrame, k, group_cols: list[str] | None = None,
                    key_cols: list[str] | None = None, seed: int = 42,
                    digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Exact first-k rows per group in draw order.

    ``k`` is an int (same for every group) or a DataFrame (group_cols..., k)
    giving a per-group quota. Returns the selected rows (input columns). Two
    reads: the bucket counts, then the rows up to the boundary bucket. Only
    these (k a group and the rest of one bucket) are shuffled; the boundary
    bucket's rows are ranked together, the others each in its own bucket.
    """
    group_cols = list(group_cols or [])
    key_cols = list(key_cols or df.columns)
    order_rest = [c for c in df.columns if c not in key_cols]
    d = _with_bounds(df, k, group_cols, key_cols, seed, digits)
    d = d.filter(F.col("__bb").isNull() | (F.col("__b") <= F.col("__bb")))
    w = Window.partitionBy(*group_cols, "__b").orderBy("__h", *key_cols, *order_rest)
    d = d.withColumn("__r", F.row_number().over(w))
    return d.filter(F.col("__bb").isNull() | (F.col("__b") < F.col("__bb")) | (F.col("__r") <= F.col("__need"))).select(*df.columns)


def drawn(df: DataFrame, k, group_cols: list[str] | None = None, key_cols: list[str] | None = None,
          seed: int = 42, digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """All rows with a boolean ``drawn``: among the first k of their group in
    draw order. Decided row by row, so of two equal rows one may be in and one
    out. Only the boundary buckets are shuffled."""
    group_cols = list(group_cols or [])
    key_cols = list(key_cols or df.columns)
    order_rest = [c for c in df.columns if c not in key_cols]
    d = _with_bounds(df, k, group_cols, key_cols, seed, digits)
    clear = d.filter(F.col("__bb").isNull() | (F.col("__b") != F.col("__bb")))
    edge = d.filter(F.col("__b") == F.col("__bb"))
    w = Window.partitionBy(*group_cols, "__b").orderBy("__h", *key_cols, *order_rest)
    edge = edge.withColumn("drawn", F.row_number().over(w) <= F.col("__need"))
    clear = clear.withColumn("drawn", F.col("__bb").isNull() | (F.col("__b") < F.col("__bb")))
    return clear.select(*df.columns, "drawn").unionByName(edge.select(*df.columns, "drawn"))


def sample_n(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exact-n sample without replacement (n capped by the row count)."""
    return top_k_per_group(df, n, None, key_cols, seed)


def stratified_cap(df: DataFrame, stratum: str, cap: int, key_cols: list[str] | None = None,
                   seed: int = 42) -> DataFrame:
    """Up to ``cap`` rows per stratum; empty strata simply absent."""
    return top_k_per_group(df, cap, [stratum], key_cols, seed)


def stratified_fraction(df: DataFrame, stratum: str, n: int, key_cols: list[str] | None = None,
                        seed: int = 42) -> DataFrame:
    """Per stratum rint(n/total x count) rows, strata in sorted order,
    then the first n overall (a per-stratum quota from prefix sums over the
    few strata)."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c"))
    total = df.agg(F.count(F.lit(1))).scalar()
    frac = F.least(F.lit(n).cast("double"), total) / total
    sizes = sizes.withColumn("m", F.rint(frac * F.col("c")).cast("long"))
    w = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)  # over the strata only
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    quota = sizes.select(stratum, F.greatest(F.least(F.col("m"), F.lit(n) - F.col("before")), F.lit(0))
                         .cast("long").alias("k"))
    return top_k_per_group(df, quota, [stratum], key_cols, seed)


def stratified_split(df: DataFrame, label: str, train_share: float = 0.8,
                     key_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Per class the first rint(share x class count) rows in draw order
    are 'train', the rest 'test' (adds a ``split`` column)."""
    sizes = df.groupBy(label).agg(F.rint(F.count(F.lit(1)) * train_share).cast("long").alias("k"))
    out = drawn(df, sizes, [label], key_cols, seed)
    return out.select(*df.columns, F.when(F.col("drawn"), "train").otherwise("test").alias("split"))


def holdout(df: DataFrame, train: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows whose key isn't among those of ``train`` (anti join)."""
    return df.join(train.select(*key_cols), key_cols, "left_anti")


def sample_holdout(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """The rows outside the exact-n sample of ``sample_n``, by row."""
    return drawn(df, n, None, key_cols, seed).filter(~F.col("drawn")).drop("drawn")


def disjoint_samples(df: DataFrame, n_train: int, n_score: int, key_cols: list[str],
                     score_cols: list[str] | None = None, seed_train: int = 42,
                     seed_score: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training sample and a disjoint scoring sample with restricted columns.

    Two reads of ``df`` for both: one histogram pass over both draw hashes,
    then one scan for the rows that can be in either sample. The scoring
    sample lies among the first n_train + n_score rows of its own order, as at
    most n_train of them are in the training sample. These few rows are
    checkpointed, and both samples come from them. Rows are told apart as
    rows: twins of a key in the training sample may still be scored."""
    d = df.withColumn("__h1", draw_hash(key_cols, seed_train)).withColumn("__h2", draw_hash(key_cols, seed_score))
    d = d.withColumn("__b1", _bucket(F.col("__h1"), BUCKET_HEX_DIGITS)).withColumn("__b2", _bucket(F.col("__h2"), BUCKET_HEX_DIGITS))
    both = F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("__b1").alias("b")), F.struct(F.lit(2).alias("o"), F.col("__b2").alias("b"))))
    counts = d.select(both.alias("x")).groupBy(F.col("x.o").alias("o"), F.col("x.b").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    quota = df.sparkSession.createDataFrame([(1, n_train), (2, n_train + n_score)], "o INT, k LONG")
    bound = {r.o: (r["__bb"], r["__need"]) for r in _bounds(counts, quota, ["o"]).collect()}  # two rows
    last = 16 ** BUCKET_HEX_DIGITS
    b1, need = bound.get(1, (None, None))
    b2 = bound.get(2, (None, None))[0]
    near = cut_lineage(d.filter((F.col("__b1") <= (last if b1 is None else b1)) | (F.col("__b2") <= (last if b2 is None else b2))))
    rest = [c for c in df.columns if c not in key_cols]
    w = Window.partitionBy("__b1").orderBy("__h1", *key_cols, *rest)
    at = F.row_number().over(w)
    inside = F.lit(True) if b1 is None else (F.col("__b1") < b1) | ((F.col("__b1") == b1) & (F.col("__r") <= need))
    near = cut_lineage(near.withColumn("__r", at).withColumn("__in", inside))
    train = near.filter("__in").select(*df.columns)
    out = near.filter(~F.col("__in") & (F.col("__b2") <= (last if b2 is None else b2))).select(*df.columns)
    score = sample_n(out, n_score, key_cols, seed_score)
    if score_cols:
        score = score.select(*[c for c in score_cols if c in score.columns])
    return train, score


# ------------------------------------------------------------ P2 / J9
def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx") -> DataFrame:
    """0-based position in ``order_cols`` order without a single-partition
    sort: range partitioning, a sort inside partitions, per-partition counts
    (one row per partition, broadcast) turned into offsets. The numbered
    table is checkpointed so a recomputation cannot move rows."""
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols) \
                .withColumn("__pid", F.spark_partition_id()) \
                .withColumn("__mid", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    out = ordered.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return out.withColumn(name, F.col("__off") + pos).drop("__pid", "__mid", "__off")


def sample_with_replacement(targets: DataFrame, pool: DataFrame, target_key: str,
                            pool_key: list[str], seed: int = 42) -> DataFrame:
    """Each target row draws one pool row with replacement:
    pool index = hash(target key, seed) mod pool size. Returns targets with
    ``__pick`` joined to the pool row (pool columns prefixed ``donor_``)."""
    n = pool.count()
    if n == 0:
        raise ValueError("empty donor pool")
    numbered = dense_index(pool.withColumn("__h", draw_hash(pool_key, seed)), ["__h", *pool_key], "__idx")
    t = targets.withColumn("__idx", F.pmod(hash_long(draw_hash([target_key], seed)), F.lit(n)))
    return t.join(numbered.drop("__h"), "__idx", "inner")


def donor_attach(applicants: DataFrame, donors: DataFrame, app_key: str = "application_id",
                 donor_key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Each applicant gets the extra columns of one donor drawn with
    replacement; columns the applicant has keep the applicant's value; the
    applicant key stays the row key."""
    donor_key = donor_key or ["id"]
    extra = [c for c in donors.columns if c not in applicants.columns]
    pool = donors.select(*dict.fromkeys(donor_key + extra))
    joined = sample_with_replacement(applicants, pool, app_key, donor_key, seed)
    keep = applicants.columns + [c for c in extra if c not in applicants.columns]
    return joined.select(*keep)


def running_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                 prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` (nulls count 0) in
    ``order_cols`` order over the whole table, without a single-partition
    window: range partitioning, a window inside each partition, and partition
    totals turned into offsets (one row per partition, broadcast). The
    laid-out table is checkpointed so both passes see the same partitions.
    Whole-number columns are summed as whole numbers."""
    ordered = cut_lineage(df.repartitionByRange(*order_cols).withColumn("__pid", F.spark_partition_id()))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__t{i}") for i, c in enumerate(value_cols)]
    tot = ordered.groupBy("__pid").agg(*sums)
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = tot.select("__pid", *[F.coalesce(F.sum(f"__t{i}").over(w), F.lit(0)).alias(f"__o{i}") for i in range(len(value_cols))])
    inner = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.select("*", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(inner).alias(f"__s{i}") for i, c in enumerate(value_cols)])
    out = out.join(F.broadcast(off), "__pid")
    return out.select(*df.columns, *[(F.col(f"__s{i}") + F.col(f"__o{i}")).alias(f"{prefix}{c}") for i, c in enumerate(value_cols)])
