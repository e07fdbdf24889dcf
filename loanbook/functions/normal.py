"""Standard normal CDF and inverse CDF as SQL expressions.

Spark SQL has no normal distribution functions, so both are written as
plain arithmetic (exp, sqrt, ln, CASE) that stays inside whole-stage codegen
and that DuckDB evaluates with the same text.

* CDF: the double-precision rational approximation of Hart (1968) in the
  form published by G. West, "Better approximations to cumulative normal
  functions", Wilmott Magazine (2005). Absolute error about 1e-14.
* Inverse: algorithm AS 241 (PPND16), M. J. Wichura, Applied Statistics 37
  (1988). Relative error about 1e-16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: published coefficients (Hart 1968 / West 2005) ----------
_CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
            33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376]
_CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207,
            86.7807322029461, 296.564248779674, 637.333633378831,
            793.826512519948, 440.413735824752]
_CDF_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631

# --- fixed values: published coefficients (Wichura 1988, AS 241) -----------
_A = [3.387132872796366608, 133.14166789178437745, 1971.5909503065514427,
      13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
      33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.1870074920579083,
      5394.1960214247511077, 21213.794301586595867, 39307.89580009271061,
      28729.085735721942674, 5226.495278852545925]
_C = [1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055,
      3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177,
      0.0227238449892691845833, 7.7454501427834140764e-4]
_D = [1.0, 2.05319162663775882187, 1.6763848301838038494,
      0.68976733498510000455, 0.14810397642748007459, 0.0151986665636164571966,
      5.475938084995344946e-4, 1.05075007164441684324e-9]
_E = [6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358,
      0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386,
      2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 0.59983220655588793769, 0.13692988092273580531,
      0.0148753612908506148525, 7.868691311456132591e-4, 1.8463183175100546818e-5,
      1.4215117583164458887e-7, 2.04426310338993978564e-15]


def _lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _horner_desc(coefs: list[float], x: str) -> str:
    """Polynomial with coefficients from the highest power down."""
    out = _lit(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_lit(c)})"
    return out


def _horner_asc(coefs: list[float], x: str) -> str:
    """Polynomial with coefficients from the constant term up."""
    return _horner_desc(list(reversed(coefs)), x)


def norm_cdf_sql(x: str) -> str:
    """SQL text for the standard normal CDF of the expression ``x``."""
    ax = f"abs({x})"
    e = f"exp(-({ax}) * ({ax}) / 2)"
    near = f"({e} * {_horner_desc(_CDF_NUM, ax)} / {_horner_desc(_CDF_DEN, ax)})"
    cf = f"({ax} + {_lit(0.65)})"
    for k in (4, 3, 2, 1):
        cf = f"({ax} + {k} / {cf})"
    far = f"({e} / {cf} / {_lit(_SQRT_2PI)})"
    tail = (f"(CASE WHEN {ax} > 37 THEN CAST(0 AS DOUBLE) "
            f"WHEN {ax} < {_lit(_CDF_SPLIT)} THEN {near} ELSE {far} END)")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """SQL text for the standard normal inverse CDF of ``p`` in (0, 1)."""
    q = f"(({p}) - 0.5)"
    r1 = f"(CAST('0.180625' AS DOUBLE) - {q} * {q})"
    central = f"({q} * {_horner_asc(_A, r1)} / {_horner_asc(_B, r1)})"
    tailp = f"(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END)"
    r = f"sqrt(-ln({tailp}))"
    rm = f"({r} - 1.6)"
    rf = f"({r} - 5)"
    mid = f"({_horner_asc(_C, rm)} / {_horner_asc(_D, rm)})"
    far = f"({_horner_asc(_E, rf)} / {_horner_asc(_F, rf)})"
    tail = f"(CASE WHEN {r} <= 5 THEN {mid} ELSE {far} END)"
    signed = f"(CASE WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"
    return (f"(CASE WHEN ({p}) IS NULL THEN NULL WHEN abs({q}) <= 0.425 "
            f"THEN {central} ELSE {signed} END)")


def norm_cdf(col: str) -> Column:
    return F.expr(norm_cdf_sql(col))


def norm_ppf(col: str) -> Column:
    return F.expr(norm_ppf_sql(col))


# ------------------------------------------------------------ numpy twins
# Same formulas for work inside tasks (e.g. per-partition scenario losses).
def _np_poly(coefs, x):
    import numpy as np
    out = np.full_like(x, coefs[0], dtype=float)
    for c in coefs[1:]:
        out = out * x + c
    return out


def norm_cdf_np(x):
    import numpy as np
    x = np.asarray(x, dtype=float)
    ax = np.abs(x)
    e = np.exp(-ax * ax / 2)
    near = e * _np_poly(_CDF_NUM, ax) / _np_poly(_CDF_DEN, ax)
    cf = ax + 0.65
    for k in (4, 3, 2, 1):
        cf = ax + k / cf
    far = e / cf / _SQRT_2PI
    tail = np.where(ax > 37, 0.0, np.where(ax < _CDF_SPLIT, near, far))
    return np.where(x > 0, 1 - tail, tail)


def norm_ppf_np(p):
    import numpy as np
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    r1 = 0.180625 - q * q
    central = q * _np_poly(_A[::-1], r1) / _np_poly(_B[::-1], r1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
        mid = _np_poly(_C[::-1], r - 1.6) / _np_poly(_D[::-1], r - 1.6)
        far = _np_poly(_E[::-1], r - 5) / _np_poly(_F[::-1], r - 5)
    tail = np.where(r <= 5, mid, far)
    return np.where(np.abs(q) <= 0.425, central, np.where(q < 0, -tail, tail))
