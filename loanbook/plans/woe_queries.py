"""Registered queries of the optimal binning (M3, M4) and their SQL twins.

The SQL lists every admissible grouping of the pre-bins by recursion and takes
the best, where the library uses dynamic programming.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanbook import constants as K
from loanbook.functions.features import engineer
from loanbook.functions.numeric import round_half_even
from loanbook.operators import filters as FL
from loanbook.operators.woe import WoEBinner
from loanbook.plans.catalog import register
from loanbook.plans.sqlfrag import FINISHED_IN, LABEL_CASE, dbl, q, rint
from loanbook.sources.tables import loan_book, with_loanbook

#: the pricing features that the loan book has, after engineering
NUMERIC = ["annual_inc", "dti", "total_rev_hi_lim", "bc_open_to_buy", "bc_util", "lti_ratio", "credit_age_years",
           "total_utilization", "credit_hunger", "term_num", "monthly_installment_ratio", "bc_util_to_open_ratio"]
LEVELS = ["home_ownership", "purpose", "addr_state"]

FEATURE_CTE = f"""feat AS (
  SELECT id, CASE WHEN {FINISHED_IN} THEN {LABEL_CASE} END AS y, home_ownership, purpose, addr_state,
         annual_inc, dti, total_rev_hi_lim, bc_open_to_buy, bc_util, loan_amnt / (annual_inc + 1) AS lti_ratio,
         CAST(date_diff('day', coalesce(earliest_cr_line, DATE {q(K.CREDIT_AGE_FALLBACK)}), DATE {q(K.CREDIT_AGE_REFERENCE)}) AS DOUBLE)
           / {dbl(365.25)} AS credit_age_years,
         avg_cur_bal / (total_rev_hi_lim + 1) AS total_utilization, inq_last_6mths + num_tl_op_past_12m AS credit_hunger,
         CASE WHEN term = ' 60 months' THEN {dbl(60.0)} ELSE {dbl(36.0)} END AS term_num,
         (loan_amnt / (CASE WHEN term = ' 60 months' THEN {dbl(60.0)} ELSE {dbl(36.0)} END)) / (annual_inc / 12 + 1) AS monthly_installment_ratio,
         bc_util / (bc_open_to_buy + 1) AS bc_util_to_open_ratio
  FROM loanbook)"""


def features(spark, d):
    """The loan book with engineered features; ``label`` is null for loans that aren't finished."""
    lb = loan_book(spark, d)
    return engineer(lb, drop_sources=False).withColumn("label", FL.label_of())


def woe_ctes(numeric: list[str], levels: list[str], shapes: str, prebins: int = 20, min_share: float = 0.05,
             max_bins: int = 8, rare: float = 0.01) -> str:
    """CTEs up to ``bins`` (feature, kind, bin, lower, upper, n_good, n_bad, woe, iv)
    and ``lev`` (feature, level, bin, woe)."""
    num = " UNION ALL ".join(f"SELECT {q(f)} AS feature, CAST({f} AS DOUBLE) AS v, y FROM feat WHERE y IS NOT NULL AND {f} IS NOT NULL" for f in numeric)
    cat = " UNION ALL ".join(f"SELECT {q(f)} AS feature, {f} AS level, y FROM feat WHERE y IS NOT NULL AND {f} IS NOT NULL" for f in levels)
    none = "SELECT '' AS feature, {} AS {}, 0 AS y WHERE false"
    num, cat = num or none.format("0.0::DOUBLE", "v"), cat or none.format("''", "level")
    g, b = f"((g + {dbl(0.5)}) / t.gg)", f"((b + {dbl(0.5)}) / t.bb)"
    return f"""{FEATURE_CTE},
tot AS (SELECT count(*) FILTER (WHERE y = 0) AS gg, count(*) FILTER (WHERE y = 1) AS bb FROM feat),
num AS ({num}),
ranked AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM num),
edges AS (SELECT feature, list_sort(list_distinct(list(v))) AS e FROM ranked
          JOIN (SELECT unnest(range(1, {prebins})) AS i) ON r = (i * (n - 1)) // {prebins} GROUP BY feature),
numcnt AS (SELECT num.feature, len([x FOR x IN e IF x <= v]) AS pos, count(*) FILTER (WHERE y = 0) AS g, count(*) FILTER (WHERE y = 1) AS b
           FROM num JOIN edges USING (feature) GROUP BY ALL),
cat AS ({cat}),
lvl AS (SELECT feature, level, count(*) FILTER (WHERE y = 0) AS g, count(*) FILTER (WHERE y = 1) AS b FROM cat GROUP BY ALL),
common AS (SELECT *, (g + b) < {dbl(rare)} * sum(g + b) OVER (PARTITION BY feature) AS rare FROM lvl),
few AS (SELECT feature, rare, CASE WHEN NOT rare THEN level END AS level, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM common GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY CAST(b AS DOUBLE) / greatest(1, g + b), rare, level) - 1 AS pos FROM few),
item0 AS (SELECT e.feature, 'numeric' AS kind, p AS pos, coalesce(g, 0) AS g, coalesce(b, 0) AS b
          FROM (SELECT feature, unnest(range(0, len(e) + 1)) AS p FROM edges) e LEFT JOIN numcnt c ON c.feature = e.feature AND c.pos = e.p
          UNION ALL SELECT feature, 'level', pos, g, b FROM placed),
item AS (SELECT *, coalesce(sum(g) OVER w, 0)::BIGINT AS g0, coalesce(sum(b) OVER w, 0)::BIGINT AS b0, count(*) OVER (PARTITION BY feature) AS n,
                sum(g + b) OVER (PARTITION BY feature) AS whole
         FROM item0 WINDOW w AS (PARTITION BY feature ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
seg0 AS (SELECT x.feature, x.kind, x.pos AS i, z.pos + 1 AS j, z.g0 + z.g - x.g0 AS g, z.b0 + z.b - x.b0 AS b, x.n, x.whole
         FROM item x JOIN item z ON x.feature = z.feature AND z.pos >= x.pos),
seg AS (SELECT s.*, ln({g} / {b}) AS woe, ({g} - {b}) * ln({g} / {b}) AS iv FROM seg0 s, tot t
        WHERE s.g + s.b >= {dbl(min_share)} * s.whole AND s.g + s.b > 0),
shape AS (SELECT * FROM (VALUES {shapes}, ('level', [0])) AS v(kind, signs)),
path AS (
  SELECT seg.feature, seg.kind, signs, 1 AS phase, [j] AS ends, j, g, b, n, iv FROM seg JOIN shape ON seg.kind = shape.kind WHERE i = 0
  UNION
  SELECT p.feature, p.kind, p.signs, a.phase, list_append(p.ends, s.j), s.j, s.g, s.b, p.n, p.iv + s.iv
  FROM path p JOIN seg s ON s.feature = p.feature AND s.i = p.j
  JOIN (SELECT unnest([1, 2]) AS phase) a ON a.phase IN (p.phase, p.phase + 1) AND a.phase <= len(p.signs)
  WHERE len(p.ends) < {max_bins} AND (p.signs = [0] OR sign(s.b * (p.g + p.b) - p.b * (s.g + s.b)) IN (0, p.signs[a.phase]))),
best AS (SELECT feature, ends FROM path WHERE j = n QUALIFY row_number() OVER (PARTITION BY feature ORDER BY iv DESC, len(ends), ends) = 1),
whole AS (SELECT DISTINCT feature, kind, n FROM item),
ends AS (SELECT w.feature, w.kind, coalesce(best.ends, [w.n]) AS ends FROM whole w LEFT JOIN best USING (feature)),
cut AS (SELECT feature, kind, ends, unnest(range(0, len(ends))) AS bin FROM ends),
span AS (SELECT *, CASE WHEN bin = 0 THEN 0 ELSE ends[bin] END AS i, ends[bin + 1] AS j FROM cut),
bins AS (SELECT c.feature, c.kind, c.bin::INT AS bin, CASE WHEN c.kind = 'numeric' AND c.bin > 0 THEN e.e[c.i] END AS lower,
                CASE WHEN c.kind = 'numeric' AND c.bin + 1 < len(c.ends) THEN e.e[c.j] END AS upper, s.g AS n_good, s.b AS n_bad,
                ln(((s.g + {dbl(0.5)}) / t.gg) / ((s.b + {dbl(0.5)}) / t.bb)) AS woe,
                (((s.g + {dbl(0.5)}) / t.gg) - ((s.b + {dbl(0.5)}) / t.bb)) * ln(((s.g + {dbl(0.5)}) / t.gg) / ((s.b + {dbl(0.5)}) / t.bb)) AS iv
         FROM span c JOIN seg0 s ON s.feature = c.feature AND s.i = c.i AND s.j = c.j LEFT JOIN edges e ON e.feature = c.feature, tot t),
lev AS (SELECT c.feature, c.level, s.bin::INT AS bin, bins.woe FROM common c
        JOIN placed p ON p.feature = c.feature AND p.rare = c.rare AND (c.rare OR p.level = c.level)
        JOIN span s ON s.feature = c.feature AND p.pos >= s.i AND p.pos < s.j
        JOIN bins ON bins.feature = c.feature AND bins.bin = s.bin)"""


MONOTONE = "('numeric', [1]), ('numeric', [-1])"
AUTO = "('numeric', [1, -1]), ('numeric', [-1, 1])"
_BINS_SQL = (f"SELECT feature, kind, bin, lower, upper, n_good, n_bad, {rint('woe', 10)} AS woe, {rint('iv', 10)} AS iv FROM bins")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _rounded(bins):
    return bins.select("feature", "kind", "bin", "lower", "upper", "n_good", "n_bad",
                       round_half_even("woe", 10).alias("woe"), round_half_even("iv", 10).alias("iv"))


@register("m3_fit_bins", _recursive(with_loanbook(_BINS_SQL, woe_ctes(NUMERIC, LEVELS, MONOTONE))))
def m3_fit_bins(spark, d):
    """M3: fitted bins of all numeric and categorical features, monotone event rates."""
    return _rounded(WoEBinner(numericCols=NUMERIC, categoricalCols=LEVELS).fit(features(spark, d)).bins)


_SHAPED = ["dti", "bc_util", "credit_age_years", "annual_inc"]


@register("m3_shaped_bins", _recursive(with_loanbook(_BINS_SQL, woe_ctes(_SHAPED, [], AUTO, max_bins=5))))
def m3_shaped_bins(spark, d):
    """M3: event rates with one peak or one valley, at most five bins."""
    return _rounded(WoEBinner(numericCols=_SHAPED, trend="auto", maxBins=5).fit(features(spark, d)).bins)


@register("m3_levels", _recursive(with_loanbook(
    f"SELECT feature, level, bin, {rint('woe', 10)} AS woe FROM lev", woe_ctes([], [*LEVELS, "zip_code"], MONOTONE, max_bins=4, rare=0.0018)
    .replace("purpose, addr_state,\n", "purpose, addr_state, zip_code,\n", 1))))
def m3_levels(spark, d):
    """M3: the level map; zip codes below 0.18 % of the finished loans are pooled."""
    lev = WoEBinner(categoricalCols=[*LEVELS, "zip_code"], maxBins=4, rareShare=0.0018).fit(features(spark, d)).levels
    return lev.select("feature", "level", "bin", round_half_even("woe", 10).alias("woe"))


def plain_value(f: str, levels: list[str] = LEVELS) -> str:
    """The WoE of a feature by the SQL's own bins."""
    at = f"(SELECT woe FROM bins WHERE bins.feature = {q(f)} AND ({f} >= lower OR lower IS NULL) AND ({f} < upper OR upper IS NULL) AND {f} IS NOT NULL)"
    if f in levels:
        at = f"(SELECT woe FROM lev WHERE lev.feature = {q(f)} AND lev.level = {f})"
    return f"coalesce({at}, 0) AS {f}_woe"


def _value(f: str) -> str:
    value, name = plain_value(f).rsplit(" AS ", 1)
    return f"{rint(value, 10)} AS {name}"


@register("m4_fitted", _recursive(with_loanbook(
    "SELECT id, " + ", ".join(_value(f) for f in [*NUMERIC, *LEVELS]) + " FROM feat", woe_ctes(NUMERIC, LEVELS, MONOTONE))))
def m4_fitted(spark, d):
    """M4: WoE of every loan by bins fitted on the finished ones."""
    f = features(spark, d)
    model = WoEBinner(numericCols=NUMERIC, categoricalCols=LEVELS).fit(f)
    out = model.transform(f)
    return out.select("id", *[round_half_even(c, 10).alias(c) for c in model.woe_columns()])
