"""Statistical expressions: χ² upper tail, erfc, inverse normal, labels.

Spark has no ``erf``, ``erfc`` or inverse-normal function, and neither has
DuckDB.  Three forms share the same fixed coefficients:

* ``*_sql`` — portable SQL text (``exp``, ``ln``, ``sqrt``, ``abs``, ``CASE``)
  used by the SQL oracle and by ``F.expr`` where the expression stays small;
* ``chi2_sf`` — a compact Spark column (``aggregate`` over ``sequence``) for
  any integer degrees of freedom;
* ``inv_normal_np`` — the vectorised form used inside Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Rational approximation AS241 / PPND16 (Wichura 1988, Applied Statistics
# 37(3)), coefficients as published, highest power first.
PPND16_A = (2.5090809287301226727e+3, 3.3430575583588128105e+4,
            6.7265770927008700853e+4, 4.5921953931549871457e+4,
            1.3731693765509461125e+4, 1.9715909503065514427e+3,
            1.3314166789178437745e+2, 3.3871328727963666080e+0)
PPND16_B = (5.2264952788528545610e+3, 2.8729085735721942674e+4,
            3.9307895800092710610e+4, 2.1213794301586595867e+4,
            5.3941960214247511077e+3, 6.8718700749205790830e+2,
            4.2313330701600911252e+1, 1.0)
PPND16_C = (7.74545014278341407640e-4, 2.27238449892691845833e-2,
            2.41780725177450611770e-1, 1.27045825245236838258e+0,
            3.64784832476320460504e+0, 5.76949722146069140550e+0,
            4.63033784615654529590e+0, 1.42343711074968357734e+0)
PPND16_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4,
            1.51986665636164571966e-2, 1.48103976427480074590e-1,
            6.89767334985100004550e-1, 1.67638483018380384940e+0,
            2.05319162663775882187e+0, 1.0)
PPND16_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5,
            1.24266094738807843860e-3, 2.65321895265761230930e-2,
            2.96560571828504891230e-1, 1.78482653991729133580e+0,
            5.46378491116411436990e+0, 6.65790464350110377720e+0)
PPND16_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7,
            1.84631831751005468180e-5, 7.86869131145613259100e-4,
            1.48753612908506148525e-2, 1.36929880922735805310e-1,
            5.99832206555887937690e-1, 1.0)
# Complementary error function, Chebyshev fit with fractional error below
# 1.2e-7 (Numerical Recipes, "erfcc"), coefficients in order t^0 .. t^9.
ERFC_COEF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
             0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# Quantile→normal transform: probabilities are kept inside
# [1e-7, 1 - 1e-7] before the inverse normal, giving a clip at about ±5.1993.
QT_BOUND = 1e-7
# --------------------------------------------------------------------------


def _lit(x: float) -> str:
    return repr(float(x)).replace("e", "E") if "e" in repr(float(x)) else f"{float(x)!r}E0"


def _horner(coefs: tuple, r: str) -> str:
    """Polynomial with coefficients highest power first, in Horner form."""
    s = _lit(coefs[0])
    for c in coefs[1:]:
        s = f"(({s}) * {r} + {_lit(c)})"
    return s


def inv_normal_sql(p: str) -> str:
    """Φ⁻¹(p) for 0 < p < 1 (AS241).  ``p`` must be a column name."""
    q = f"({p} - 0.5E0)"
    r1 = f"(0.180625E0 - {q} * {q})"
    central = f"({q} * {_horner(PPND16_A, r1)} / {_horner(PPND16_B, r1)})"
    tail_r = f"sqrt(-ln(CASE WHEN {p} < 0.5E0 THEN {p} ELSE 1.0E0 - {p} END))"
    r2 = f"({tail_r} - 1.6E0)"
    r3 = f"({tail_r} - 5.0E0)"
    mid = f"({_horner(PPND16_C, r2)} / {_horner(PPND16_D, r2)})"
    far = f"({_horner(PPND16_E, r3)} / {_horner(PPND16_F, r3)})"
    tail = f"(CASE WHEN {tail_r} <= 5.0E0 THEN {mid} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425E0 THEN {central} "
            f"WHEN {p} < 0.5E0 THEN -{tail} ELSE {tail} END)")


def erfc_sql(z: str) -> str:
    """erfc(z) for z >= 0 (column name or literal)."""
    t = f"(1.0E0 / (1.0E0 + 0.5E0 * {z}))"
    poly = _horner(tuple(reversed(ERFC_COEF)), t)
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def chi2_sf_sql(x: str, k: int) -> str:
    """Upper tail P(χ²_k > x) for an integer k >= 1, closed form."""
    half = f"({x} / 2.0E0)"
    if k % 2 == 0:
        terms = [f"pow({half}, {j}.0E0) / {_lit(math.factorial(j))}" for j in range(k // 2)]
        return f"(exp(-{half}) * ({' + '.join(terms)}))"
    m = (k - 1) // 2
    base = erfc_sql(f"sqrt({half})")
    if m == 0:
        return base
    terms = []
    for j in range(1, m + 1):
        g = math.gamma(j + 0.5)
        terms.append(f"pow({half}, {j - 0.5!r}E0) / {_lit(g)}")
    return f"({base} + exp(-{half}) * ({' + '.join(terms)}))"


def chi2_sf_by_df_sql(x: str, df: str, max_df: int = 30) -> str:
    """Upper χ² tail when the degrees of freedom are a column (1..max_df)."""
    whens = " ".join(f"WHEN {df} = {k} THEN {chi2_sf_sql(x, k)}" for k in range(1, max_df + 1))
    return f"(CASE WHEN {x} IS NULL OR {df} IS NULL OR {df} < 1 THEN NULL {whens} END)"


def stars_sql(p: str, blank_ns: bool = False) -> str:
    """Significance marks *** / ** / * / ns."""
    ns = "''" if blank_ns else "'ns'"
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.001E0 THEN '***' "
            f"WHEN {p} < 0.01E0 THEN '**' WHEN {p} < 0.05E0 THEN '*' ELSE {ns} END)")


def kmo_label_sql(kmo: str) -> str:
    """KMO adequacy label (M7)."""
    return (f"(CASE WHEN {kmo} >= 0.9E0 THEN 'Excelente' WHEN {kmo} >= 0.8E0 THEN 'Bueno' "
            f"WHEN {kmo} >= 0.7E0 THEN 'Aceptable' ELSE 'Mediocre' END)")


def ari_strength_sql(ari: str) -> str:
    """Agreement label for an adjusted Rand index."""
    return (f"(CASE WHEN {ari} > 0.6E0 THEN 'alta' WHEN {ari} > 0.3E0 THEN 'moderada' "
            f"ELSE 'baja' END)")


def expr(sql_text: str) -> Column:
    """Spark column from one of the SQL texts above."""
    return F.expr(sql_text)


def chi2_sf(x: Column, k: Column) -> Column:
    """Upper χ² tail for integer degrees of freedom given as a column.

    Same finite series as :func:`chi2_sf_sql`, summed with ``aggregate`` over
    ``sequence`` so the expression stays small for any ``k``.
    even k = 2m:   e^{-x/2} Σ_{j<m} (x/2)^j / j!
    odd  k = 2m+1: erfc(√(x/2)) + e^{-x/2} Σ_{j=1..m} (x/2)^{j-1/2} / Γ(j+1/2)
    """
    half = x / 2.0
    m_even = F.floor(k / 2).cast("int")
    m_odd = F.floor((k - 1) / 2).cast("int")

    def upto(n):  # 1..n, empty when n < 1
        return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: j <= n)

    even_sum = F.aggregate(
        upto(m_even - 1),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, j: F.struct((acc["t"] * half / j).alias("t"), (acc["s"] + acc["t"] * half / j).alias("s")),
        lambda acc: acc["s"])
    t1 = F.sqrt(half) * (2.0 / math.sqrt(math.pi))
    odd_sum = F.aggregate(
        upto(m_odd),
        F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"), F.lit(0).alias("i")),
        lambda acc, j: F.struct(
            F.when(j == 1, t1).otherwise(acc["t"] * half / (j - 0.5)).alias("t"),
            (acc["s"] + F.when(j == 1, t1).otherwise(acc["t"] * half / (j - 0.5))).alias("s"),
            j.alias("i")),
        lambda acc: acc["s"])
    z = F.sqrt(half)
    tt = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(ERFC_COEF[-1])
    for c in reversed(ERFC_COEF[:-1]):
        poly = poly * tt + F.lit(c)
    erfc = tt * F.exp(-z * z + poly)
    return (F.when(x.isNull() | k.isNull() | (k < 1), F.lit(None).cast("double"))
            .when(k % 2 == 0, F.exp(-half) * even_sum)
            .otherwise(erfc + F.exp(-half) * odd_sum))


def _horner_np(coefs: tuple, r):
    s = coefs[0]
    for c in coefs[1:]:
        s = s * r + c
    return s


def inv_normal_np(p):
    """Vectorised Φ⁻¹(p) for 0 < p < 1 (AS241, same coefficients as the SQL text)."""
    import numpy as np

    p = np.asarray(p, dtype=float)
    q = p - 0.5
    out = np.empty_like(p)
    central = np.abs(q) <= 0.425
    r1 = 0.180625 - q[central] * q[central]
    out[central] = q[central] * _horner_np(PPND16_A, r1) / _horner_np(PPND16_B, r1)
    tail = ~central & ~np.isnan(p)
    pt = p[tail]
    r = np.sqrt(-np.log(np.where(pt < 0.5, pt, 1.0 - pt)))
    near = r <= 5.0
    val = np.where(near,
                   _horner_np(PPND16_C, r - 1.6) / _horner_np(PPND16_D, r - 1.6),
                   _horner_np(PPND16_E, r - 5.0) / _horner_np(PPND16_F, r - 5.0))
    out[tail] = np.where(pt < 0.5, -val, val)
    out[np.isnan(p)] = np.nan
    return out
