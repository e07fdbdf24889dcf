"""Driver tables and the loan-book view derived from them.

The loan book has one row per order: ``orders`` joined to its customer,
nation and the order's line items aggregated per order. The mapping is
stated in FIXTURES.md section B and is computed identically by
:func:`loan_book` (Spark) and :data:`LOAN_BOOK_SQL` (DuckDB oracle).

Plan shape at scale: the line-item aggregate is a partial (map-side)
aggregate followed by one shuffle on the order key; the per-customer first
order date is a partial aggregate on the customer key; ``nation`` (25 rows
by definition of the schema) is the only explicit broadcast. The result is
hash-partitioned on the order key, which later id-keyed joins reuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

# --- fixed values: purpose by order priority digit (FIXTURES.md B) ---------
PRIORITY_PURPOSE = {"1": "small_business", "2": "credit_card",
                    "3": "debt_consolidation", "4": "unlisted", "5": "car"}
# --- fixed values: ongoing status by returned-line count modulo 4 ----------
OPEN_STATUS_BY_MOD = ["Current", "In Grace Period", "Late (16-30 days)",
                      "Late (31-120 days)"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str, scale: int = 100):
    """A 2-decimal amount as an exact LONG count of 1/scale units."""
    return F.round(F.col(c) * scale).cast("long")


def _line_aggregates(lineitem: DataFrame) -> DataFrame:
    """Per-order line aggregates. Amounts have two decimals, so the sums are
    taken exactly as LONG counts of cents (price x discount in 1/10000
    units) and turned into doubles once: the result equals the correctly
    rounded exact sum, whatever the partitioning or summation order (the
    SQL twin sums DECIMALs and gets the same doubles)."""
    price, disc = _cents("l_extendedprice"), _cents("l_discount")
    return (lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("n_ret"),
        (F.sum(price) / 100.0).alias("gross"),
        (F.sum(F.when(F.col("l_linestatus") == "O", price).otherwise(F.lit(0).cast("long"))) / 100.0)
        .alias("open_amt"),
        (F.sum(price * disc) / 10000.0).alias("disc_amt"),
        (F.sum(disc) / 100.0).alias("disc_sum"),
        (F.sum(_cents("l_quantity")) / 100.0).alias("qty"),
    ))


def loan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan per order, columns named as the application's accepted-loan file."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = _line_aggregates(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_quantity",
        "l_returnflag", "l_linestatus"))
    first = orders.groupBy(F.col("o_custkey").alias("f_custkey")).agg(
        F.min("o_orderdate").alias("first_order_dt"))
    cust = (customer
            .join(first, customer.c_custkey == first.f_custkey, "left")
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left"))
    df = (orders
          .join(cust, orders.o_custkey == cust.c_custkey, "left")
          .join(li, orders.o_orderkey == li.l_orderkey, "left"))

    n_ret0 = F.coalesce(F.col("n_ret"), F.lit(0))
    loan_amnt = F.col("o_totalprice") / 10
    annual_inc = 20000 + 10 * (F.col("c_acctbal") + 1000)
    prio = F.substring("o_orderpriority", 1, 1)
    purpose = F.lit(None).cast("string")
    for k, v in reversed(PRIORITY_PURPOSE.items()):
        purpose = F.when(prio == k, F.lit(v)).otherwise(purpose)
    status_open = F.element_at(F.array(*[F.lit(s) for s in OPEN_STATUS_BY_MOD]),
                               (n_ret0 % 4 + 1).cast("int"))
    loan_status = (F.when(F.col("o_orderstatus") == "F",
                          F.when(n_ret0 >= 2, "Charged Off").otherwise("Fully Paid"))
                   .when(F.col("o_orderstatus") == "P",
                         F.when(n_ret0 >= 2, "Default")
                         .otherwise("Does not meet the credit policy. Status:Fully Paid"))
                   .when(F.col("o_orderstatus") == "O", status_open))
    term_months = F.when(F.col("o_orderkey") % 3 == 0, 60.0).otherwise(36.0)
    emp_k = (F.col("o_custkey") % 11).cast("int")
    out_prncp = loan_amnt * F.col("open_amt") / F.col("gross")
    recoveries = F.col("disc_amt") / 10
    avg_disc = F.col("disc_sum") / F.col("n_lines")
    return df.select(
        F.col("o_orderkey").alias("id"),
        loan_amnt.alias("loan_amnt"),
        loan_amnt.alias("funded_amnt"),
        annual_inc.alias("annual_inc"),
        F.when(F.col("o_orderkey") % 3 == 0, " 60 months").otherwise(" 36 months").alias("term"),
        purpose.alias("purpose"),
        F.regexp_replace(purpose, "_", " ").alias("title"),
        F.col("n_name").alias("addr_state"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.when(emp_k == 0, "< 1 year").when(emp_k == 1, "1 year")
         .when(emp_k == 10, "10+ years")
         .otherwise(F.concat(emp_k.cast("string"), F.lit(" years"))).alias("emp_length"),
        F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"),
                 F.lit("xx")).alias("zip_code"),
        F.when(F.col("o_custkey") % 2 == 0, "Cash").otherwise("DirectPay").alias("disbursement_method"),
        loan_status.alias("loan_status"),
        F.to_date("o_orderdate").alias("issue_d"),
        F.to_date("first_order_dt").alias("earliest_cr_line"),
        (5 * F.col("gross") / annual_inc).alias("dti"),
        (600 + F.col("o_custkey") % 250).cast("double").alias("fico_range_high"),
        F.lit(1.0).alias("policy_code"),
        out_prncp.alias("out_prncp"),
        (loan_amnt - out_prncp).alias("total_rec_prncp"),
        recoveries.alias("recoveries"),
        (recoveries / 10).alias("collection_recovery_fee"),
        (loan_amnt - out_prncp + recoveries).alias("total_pymnt"),
        (6 + 100 * avg_disc).alias("int_rate"),
        (loan_amnt / term_months).alias("installment"),
        F.col("c_acctbal").alias("avg_cur_bal"),
        (100 * F.col("qty")).alias("total_rev_hi_lim"),
        (1000 * avg_disc).alias("bc_util"),
        (10 * F.col("qty")).alias("bc_open_to_buy"),
        F.col("n_ret").cast("double").alias("inq_last_6mths"),
        F.col("n_lines").cast("double").alias("num_tl_op_past_12m"),
    )


LOAN_BOOK_SQL = """
li AS (
  SELECT l_orderkey,
         count(*) AS n_lines,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2))
                       ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS open_amt,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc_amt,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc_sum,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
  FROM lineitem GROUP BY l_orderkey
),
first_ord AS (SELECT o_custkey AS f_custkey, min(o_orderdate) AS first_order_dt FROM orders GROUP BY o_custkey),
lb0 AS (
  SELECT o.*, c.c_acctbal, c.c_mktsegment, n.n_name, f.first_order_dt, li.*,
         o.o_totalprice / 10 AS la,
         20000 + 10 * (c.c_acctbal + 1000) AS ai,
         coalesce(li.n_ret, 0) AS nr0,
         substr(o.o_orderpriority, 1, 1) AS prio,
         CAST(o.o_custkey % 11 AS INTEGER) AS emp_k
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN first_ord f ON c.c_custkey = f.f_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
),
lb1 AS (
  SELECT *, CASE prio WHEN '1' THEN 'small_business' WHEN '2' THEN 'credit_card'
                 WHEN '3' THEN 'debt_consolidation' WHEN '4' THEN 'unlisted'
                 WHEN '5' THEN 'car' END AS purp,
         la * open_amt / gross AS op,
         disc_amt / 10 AS rec,
         disc_sum / n_lines AS adisc
  FROM lb0
),
loanbook AS (
  SELECT o_orderkey AS id,
         la AS loan_amnt,
         la AS funded_amnt,
         ai AS annual_inc,
         CASE WHEN o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
         purp AS purpose,
         replace(purp, '_', ' ') AS title,
         n_name AS addr_state,
         c_mktsegment AS home_ownership,
         CASE WHEN emp_k = 0 THEN '< 1 year' WHEN emp_k = 1 THEN '1 year'
              WHEN emp_k = 10 THEN '10+ years' ELSE CAST(emp_k AS VARCHAR) || ' years' END AS emp_length,
         lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'xx' AS zip_code,
         CASE WHEN o_custkey % 2 = 0 THEN 'Cash' ELSE 'DirectPay' END AS disbursement_method,
         CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN nr0 >= 2 THEN 'Charged Off' ELSE 'Fully Paid' END)
              WHEN o_orderstatus = 'P' THEN (CASE WHEN nr0 >= 2 THEN 'Default'
                   ELSE 'Does not meet the credit policy. Status:Fully Paid' END)
              WHEN o_orderstatus = 'O' THEN (CASE nr0 % 4 WHEN 0 THEN 'Current' WHEN 1 THEN 'In Grace Period'
                   WHEN 2 THEN 'Late (16-30 days)' ELSE 'Late (31-120 days)' END)
         END AS loan_status,
         CAST(o_orderdate AS DATE) AS issue_d,
         CAST(first_order_dt AS DATE) AS earliest_cr_line,
         5 * gross / ai AS dti,
         CAST(600 + o_custkey % 250 AS DOUBLE) AS fico_range_high,
         CAST(1.0 AS DOUBLE) AS policy_code,
         op AS out_prncp,
         la - op AS total_rec_prncp,
         rec AS recoveries,
         rec / 10 AS collection_recovery_fee,
         la - op + rec AS total_pymnt,
         6 + 100 * adisc AS int_rate,
         la / (CASE WHEN o_orderkey % 3 = 0 THEN CAST(60 AS DOUBLE) ELSE CAST(36 AS DOUBLE) END) AS installment,
         c_acctbal AS avg_cur_bal,
         100 * qty AS total_rev_hi_lim,
         1000 * adisc AS bc_util,
         10 * qty AS bc_open_to_buy,
         CAST(n_ret AS DOUBLE) AS inq_last_6mths,
         CAST(n_lines AS DOUBLE) AS num_tl_op_past_12m
  FROM lb1
)
"""


def with_loanbook(sql: str, ctes: str = "") -> str:
    """Prefix a query with the loan-book CTEs (and optional extra CTEs)."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {LOAN_BOOK_SQL.strip()}{extra}\n{sql}"


# Column order and types of the loan book (used to render SQL twins).
LOANBOOK_COLUMNS = [
    ("id", "BIGINT"), ("loan_amnt", "DOUBLE"), ("funded_amnt", "DOUBLE"),
    ("annual_inc", "DOUBLE"), ("term", "VARCHAR"), ("purpose", "VARCHAR"),
    ("title", "VARCHAR"), ("addr_state", "VARCHAR"), ("home_ownership", "VARCHAR"),
    ("emp_length", "VARCHAR"), ("zip_code", "VARCHAR"), ("disbursement_method", "VARCHAR"),
    ("loan_status", "VARCHAR"), ("issue_d", "DATE"), ("earliest_cr_line", "DATE"),
    ("dti", "DOUBLE"), ("fico_range_high", "DOUBLE"), ("policy_code", "DOUBLE"),
    ("out_prncp", "DOUBLE"), ("total_rec_prncp", "DOUBLE"), ("recoveries", "DOUBLE"),
    ("collection_recovery_fee", "DOUBLE"), ("total_pymnt", "DOUBLE"), ("int_rate", "DOUBLE"),
    ("installment", "DOUBLE"), ("avg_cur_bal", "DOUBLE"), ("total_rev_hi_lim", "DOUBLE"),
    ("bc_util", "DOUBLE"), ("bc_open_to_buy", "DOUBLE"), ("inq_last_6mths", "DOUBLE"),
    ("num_tl_op_past_12m", "DOUBLE"),
]
LOANBOOK_TYPES = dict(LOANBOOK_COLUMNS)
