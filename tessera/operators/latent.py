"""Latent-dimension operators.

Division of labour: Spark does every pass over rows (medians, ranks,
correlation/covariance moments, category-pair counts, score projection); the
resulting p×p or J×J matrices — p variables of a block, J categories — are
tiny and solved with numpy on the driver.  Fitted results are returned as
small parameter DataFrames / dicts and applied back as column expressions,
so scoring a new table is a projection (no join, no shuffle).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import gram, ranks
from tessera.sources.scratch import saved


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------------------
# imputation and scaling
# ---------------------------------------------------------------------------

def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median of each column (A14) — one small collect (p values)."""
    m = ranks.exact_median(df, cols).collect()
    return {r["var"]: r["median"] for r in m}


def median_impute(df: DataFrame, cols: list[str], medians: dict | None = None) -> DataFrame:
    """Fill nulls with the column median (M1)."""
    medians = medians or column_medians(df, cols)
    return df.withColumns({c: F.coalesce(_q(c).try_cast("double"), F.lit(medians.get(c)))
                           for c in cols})


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per column, ties → smallest value.

    ``(var, mode, n)``: (var, value) counts, then ``min_by`` over
    ``(-count, value)`` — a combinable aggregate, no per-group value map.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), _q(c).cast("string").alias("val"))
                                for c in cols]))
    hist = (df.select(stack.alias("s")).select("s.*").where(F.col("val").isNotNull())
            .groupBy("var", "val").agg(F.count(F.lit(1)).alias("cnt")))
    return hist.groupBy("var").agg(
        F.min_by("val", F.struct(-F.col("cnt"), F.col("val"))).alias("mode"),
        F.max("cnt").alias("n"))


def mode_impute(df: DataFrame, cols: list[str], fallback: str = "Otro", modes: dict | None = None) -> DataFrame:
    """Fill nulls with the column mode; all-null columns get ``fallback`` (M2)."""
    if modes is None:
        modes = {r["var"]: r["mode"] for r in column_modes(df, cols).collect()}
    return df.withColumns({c: F.coalesce(_q(c).cast("string"), F.lit(modes.get(c, fallback)))
                           for c in cols})


def zscore(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x − mean) / population std (ddof 0) (M15); a constant column becomes 0."""
    st = df.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c + suffix: (_q(c) - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"] or 1.0)
                           for i, c in enumerate(cols)})


# ---------------------------------------------------------------------------
# correlation / covariance matrices
# ---------------------------------------------------------------------------

def moment_matrix(df: DataFrame, cols: list[str], kind: str = "corr") -> tuple[np.ndarray, int]:
    """p×p Pearson correlation (``corr``) or sample covariance (``cov``) and n.

    One aggregation whatever p is (:mod:`tessera.operators.gram`); rows with a
    null in a pair are skipped pairwise (callers impute first for complete-case
    matrices).
    """
    m, _, n = gram.moments(df, cols, kind)
    return m, n


def spearman_matrix(df: DataFrame, cols: list[str], id_col: str = "row_id") -> tuple[np.ndarray, int]:
    """Spearman matrix = Pearson of average ranks (M3, M4)."""
    rk = ranks.rank_columns(df, cols, id_col)
    return moment_matrix(rk, cols, "corr")


# ---------------------------------------------------------------------------
# KMO and Bartlett (M5, M6, M7)
# ---------------------------------------------------------------------------

def chi2_sf_py(x: float, k: int) -> float:
    """Upper χ² tail for integer k (same series as the SQL expression, in logs)."""
    if x is None or k < 1 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if k % 2 == 0:
        terms = [j * math.log(half) - math.lgamma(j + 1) for j in range(k // 2)]
        base = 0.0
    else:
        terms = [(j - 0.5) * math.log(half) - math.lgamma(j + 0.5) for j in range(1, (k - 1) // 2 + 1)]
        base = math.erfc(math.sqrt(half))
    if not terms:
        return base
    mx = max(terms)
    s = sum(math.exp(t - mx) for t in terms)
    return min(1.0, base + math.exp(mx - half) * s)


def bartlett_sphericity(r: np.ndarray, n: int) -> tuple[float, int, float]:
    """χ² = −(n − 1 − (2p+5)/6)·ln|R|, df = p(p−1)/2 (M5)."""
    p = r.shape[0]
    sign, logdet = np.linalg.slogdet(r)
    stat = -(n - 1 - (2 * p + 5) / 6.0) * logdet
    dof = p * (p - 1) // 2
    return float(stat), dof, chi2_sf_py(float(stat), dof)


def kmo(r: np.ndarray) -> tuple[float, np.ndarray]:
    """Kaiser–Meyer–Olkin adequacy: Σr² / (Σr² + Σq²), q partial correlations (M6)."""
    inv = np.linalg.inv(r)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    partial = -inv / d
    rr = r.copy()
    np.fill_diagonal(rr, 0.0)
    np.fill_diagonal(partial, 0.0)
    r2, q2 = rr ** 2, partial ** 2
    per_item = r2.sum(0) / (r2.sum(0) + q2.sum(0))
    total = r2.sum() / (r2.sum() + q2.sum())
    return float(total), per_item


def kmo_label(v: float) -> str:
    """M7 labels."""
    return "Excelente" if v >= 0.9 else "Bueno" if v >= 0.8 else "Aceptable" if v >= 0.7 else "Mediocre"


# ---------------------------------------------------------------------------
# eigen helpers and rotation
# ---------------------------------------------------------------------------

def sorted_eigh(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs by descending eigenvalue; each vector's largest-|entry| positive."""
    w, v = np.linalg.eigh(m)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    for k in range(v.shape[1]):
        i = np.argmax(np.abs(v[:, k]))
        if v[i, k] < 0:
            v[:, k] = -v[:, k]
    return w, v


def varimax(a: np.ndarray, max_iter: int = 500, tol: float = 1e-6) -> np.ndarray:
    """Orthogonal varimax rotation with Kaiser normalisation."""
    p, m = a.shape
    if m < 2:
        return a
    h = np.sqrt((a ** 2).sum(1))
    h[h == 0] = 1.0
    x = a / h[:, None]
    rot = np.eye(m)
    d = 0.0
    for _ in range(max_iter):
        z = x @ rot
        b = x.T @ (z ** 3 - z @ np.diag((z ** 2).sum(0)) / p)
        u, s, vt = np.linalg.svd(b)
        rot = u @ vt
        d_old, d = d, s.sum()
        if d_old != 0 and d / d_old < 1 + tol:
            break
    return (x @ rot) * h[:, None]


def oblimin(a: np.ndarray, gamma: float = 0.0, max_iter: int = 1000, tol: float = 1e-5):
    """Oblique oblimin (quartimin for gamma=0) by gradient projection.

    Kaiser-normalised rows.  Returns ``(pattern loadings, phi)`` where phi is
    the factor correlation matrix.
    """
    p, m = a.shape
    if m < 2:
        return a, np.eye(m)
    h = np.sqrt((a ** 2).sum(1))
    h[h == 0] = 1.0
    an = a / h[:, None]
    t = np.eye(m)
    n_mat = np.ones((m, m)) - np.eye(m)

    def crit(lam):
        l2 = lam ** 2
        cm = (np.eye(p) - gamma * np.ones((p, p)) / p) @ l2 @ n_mat
        return (l2 * cm).sum() / 4.0, lam * cm

    lam = an @ np.linalg.inv(t).T
    f, gq = crit(lam)
    g = -(lam.T @ gq @ np.linalg.inv(t)).T
    alpha = 1.0
    for _ in range(max_iter):
        gp = g - t @ np.diag((t * g).sum(0))
        s = np.sqrt((gp ** 2).sum())
        if s < tol:
            break
        alpha *= 2
        for _ in range(11):
            x = t - alpha * gp
            tt = x @ np.diag(1.0 / np.sqrt((x ** 2).sum(0)))
            lam_n = an @ np.linalg.inv(tt).T
            ft, gq_n = crit(lam_n)
            if ft < f - 0.5 * s ** 2 * alpha:
                break
            alpha /= 2
        t, f, lam, gq = tt, ft, lam_n, gq_n
        g = -(lam.T @ gq @ np.linalg.inv(t)).T
    phi = t.T @ t
    return lam * h[:, None], phi


# ---------------------------------------------------------------------------
# block factor analysis (M8, M9)
# ---------------------------------------------------------------------------

@dataclass
class FactorModel:
    block: str
    cols: list[str]
    n_factors: int
    loadings: np.ndarray        # p × m pattern
    structure: np.ndarray       # p × m structure (= pattern for orthogonal)
    weights: np.ndarray         # p × m regression weights R⁻¹·structure
    means: np.ndarray
    stds: np.ndarray            # ddof 0
    variance_pct: float
    kmo: float
    bartlett_p: float
    bartlett_chi2: float
    n: int

    def score_columns(self, prefix: str | None = None) -> list[Column]:
        """Regression factor scores as column expressions over the ranked columns."""
        prefix = prefix or self.block
        out = []
        for k in range(self.n_factors):
            e = F.lit(0.0)
            for j, c in enumerate(self.cols):
                if self.stds[j] > 0:
                    e = e + F.lit(float(self.weights[j, k])) * ((_q(c) - F.lit(float(self.means[j])))
                                                                / F.lit(float(self.stds[j])))
            out.append(e.alias(f"{prefix}_F{k + 1}"))
        return out

    def to_table(self, spark) -> DataFrame:
        """Everything that scoring needs, one row per variable and factor."""
        rows = [(self.block, j, c, k + 1, float(self.loadings[j, k]), float(self.weights[j, k]), float(self.means[j]),
                 float(self.stds[j])) for j, c in enumerate(self.cols) for k in range(self.n_factors)]
        return spark.createDataFrame(rows, "block string, i int, var string, factor int, loading double, weight double, "
                                           "mean double, std double")

    @classmethod
    def from_table(cls, table: DataFrame) -> "FactorModel":
        """The scoring part of a saved model; the fit's tests are not kept.

        The order of the variables is that of the fit, so that sums round alike."""
        rows = table.orderBy("i", "factor").collect()
        cols = list(dict.fromkeys(r["var"] for r in rows))
        m = max(r["factor"] for r in rows)
        load, weights = np.zeros((len(cols), m)), np.zeros((len(cols), m))
        means, stds = np.zeros(len(cols)), np.zeros(len(cols))
        for r in rows:
            j, k = cols.index(r["var"]), r["factor"] - 1
            load[j, k], weights[j, k], means[j], stds[j] = r["loading"], r["weight"], r["mean"], r["std"]
        nan = float("nan")
        return cls(rows[0]["block"], cols, m, load, load, weights, means, stds, nan, nan, nan, nan, 0)

    def loadings_table(self, spark) -> DataFrame:
        rows = [(self.block, c, k + 1, float(round(self.loadings[j, k], 3)))
                for j, c in enumerate(self.cols) for k in range(self.n_factors)]
        return spark.createDataFrame(rows, "block string, var string, factor int, loading double")


class SingularBlock(ValueError):
    """A block whose items cannot be told apart: one is constant, or a sum of others."""


def fit_factor_block(ranked: DataFrame, cols: list[str], n_factors: int = 1,
                     block: str = "B") -> FactorModel:
    """Principal-axis extraction on the rank correlation matrix (M8).

    Loadings = eigenvector·√eigenvalue of R (the correlation of each variable
    with each principal component); varimax for one factor is the identity,
    oblimin for two or more; each factor's loading sum is made non-negative.
    % variance = Σ loadings² / p.  Regression weights = R⁻¹·structure.
    Raises :class:`SingularBlock` if R is not defined or not of full rank.
    """
    r, n = moment_matrix(ranked, cols, "corr")
    if np.isnan(r).any() or np.linalg.eigvalsh(r)[0] < 1e-9:
        raise SingularBlock(f"{block}: an item is constant or follows from others ({', '.join(cols)})")
    st = ranked.agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    means = np.array([st[f"m{i}"] for i in range(len(cols))], dtype=float)
    stds = np.array([st[f"s{i}"] for i in range(len(cols))], dtype=float)
    try:
        k_total, _ = kmo(r)
        chi2, _, p_bart = bartlett_sphericity(r, n)
    except np.linalg.LinAlgError:
        k_total, chi2, p_bart = 0.0, float("nan"), 1.0
    w, v = sorted_eigh(r)
    load = v[:, :n_factors] * np.sqrt(np.clip(w[:n_factors], 0, None))
    if n_factors > 1:
        pattern, phi = oblimin(load)
        structure = pattern @ phi
    else:
        pattern, structure = load, load
    signs = np.sign(pattern.sum(0))
    signs[signs == 0] = 1
    pattern, structure = pattern * signs, structure * signs
    weights = np.linalg.solve(r, structure)
    var_pct = float((pattern ** 2).sum() / len(cols) * 100)
    return FactorModel(block, cols, n_factors, pattern, structure, weights, means, stds,
                       var_pct, k_total, p_bart, chi2, n)


def strong_loadings(models: list[FactorModel], spark, threshold: float = 0.5, top: int = 3) -> DataFrame:
    """|loading| > threshold, top 3 per factor (M9) — ``unpivot`` + ``row_number``."""
    from pyspark.sql import Window as W
    tab = None
    for m in models:
        t = m.loadings_table(spark)
        tab = t if tab is None else tab.unionByName(t)
    w = W.partitionBy("block", "factor").orderBy(F.desc(F.abs("loading")), "var")
    return (tab.where(F.abs("loading") > threshold).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top))


# ---------------------------------------------------------------------------
# multiple correspondence analysis
# ---------------------------------------------------------------------------

def burt_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Category-pair counts (the Burt table) ``(var_a, cat_a, var_b, cat_b, n)``.

    Each row emits K² pairs (K = number of nominal columns, a constant of
    the configuration); counts are combined map-side.
    """
    items = F.array(*[F.struct(F.lit(c).alias("v"), _q(c).cast("string").alias("c")) for c in cols])
    a = df.select(items.alias("it")).select(F.explode("it").alias("a"), "it")
    pairs = a.select("a", F.explode("it").alias("b"))
    return (pairs.groupBy(F.col("a.v").alias("var_a"), F.col("a.c").alias("cat_a"),
                          F.col("b.v").alias("var_b"), F.col("b.c").alias("cat_b"))
            .agg(F.count(F.lit(1)).alias("n")))


@dataclass
class MCAModel:
    cols: list[str]
    categories: list[tuple[str, str]]
    eigenvalues: np.ndarray
    inertia_pct: list[float]
    cat_scores: np.ndarray      # J × d scores c_j^{-1/2} v_jk

    def to_table(self, spark) -> DataFrame:
        """Category scores, one row per category and dimension."""
        rows = [(v, c, k + 1, float(self.cat_scores[j, k])) for j, (v, c) in enumerate(self.categories)
                for k in range(self.cat_scores.shape[1])]
        return spark.createDataFrame(rows, "var string, category string, dim int, score double")

    @classmethod
    def from_table(cls, table: DataFrame, cols: list[str]) -> "MCAModel":
        """The scoring part of a saved model; inertia is not kept."""
        rows = sorted((tuple(r) for r in table.collect()), key=lambda r: (cols.index(r[0]), str(r[1]), r[2]))
        cats = list(dict.fromkeys((r[0], r[1]) for r in rows))
        scores = np.zeros((len(cats), max(r[2] for r in rows)))
        for v, c, k, x in rows:
            scores[cats.index((v, c)), k - 1] = x
        return cls(cols, cats, np.array([]), [], scores)

    def coord_columns(self, prefix: str = "acm_dim") -> list[Column]:
        """Row coordinate = mean over the K answers of the category scores."""
        out = []
        for k in range(self.cat_scores.shape[1]):
            parts = []
            for var in self.cols:
                mp = {cat: float(self.cat_scores[j, k]) for j, (v, cat) in enumerate(self.categories)
                      if v == var}
                m = F.create_map(*[F.lit(x) for kv in mp.items() for x in kv])
                parts.append(F.coalesce(F.try_element_at(m, _q(var).cast("string")), F.lit(0.0)))
            out.append((sum(parts, F.lit(0.0)) / F.lit(float(len(self.cols)))).alias(f"{prefix}{k + 1}"))
        return out


#: Columns of the iterated block beyond the wanted ones; up to this many
#: categories the block is the whole space and one product solves the problem.
MCA_BLOCK = 64
MCA_ROUNDS = 500


def _answer_patterns(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[tuple[str, str]], np.ndarray]:
    """(distinct answer patterns with their counts ``_w``, categories, category counts)."""
    patterns = saved(df.groupBy(*[_q(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
                     .agg(F.count(F.lit(1)).alias("_w")), "patterns")
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("cat")) for i in range(len(cols))])
    counts = (patterns.select(F.explode(items).alias("x"), "_w").where("x.cat is not null")
              .groupBy("x.i", "x.cat").agg(F.sum("_w").alias("n")).collect())
    rows = sorted((r["i"], r["cat"], r["n"]) for r in counts)
    return patterns, [(cols[i], c) for i, c, _ in rows], np.array([n for *_, n in rows], float)


def _indicator_product(patterns: DataFrame, cols: list[str], cats: list[tuple[str, str]], u: np.ndarray) -> np.ndarray:
    """Zᵀ Z u for the indicator matrix Z of all rows (J × q).

    A task adds the rows' products up per category; one row per category and
    task is shuffled, J × q numbers reach the driver."""
    import pyarrow as pa

    place: dict = {c: {} for c in cols}
    for j, (c, cat) in enumerate(cats):
        place[c][cat] = j
    j_all, q = u.shape
    held = patterns.sparkSession.sparkContext.broadcast(([place[c] for c in cols], u))

    def run(batches):
        maps, v = held.value
        total, touched = np.zeros((j_all, q)), np.zeros(j_all, bool)
        for batch in batches:
            w = batch.column(len(maps)).to_numpy().astype(float)
            code = np.array([[m.get(x, -1) for x in batch.column(i).to_pylist()] for i, m in enumerate(maps)])
            known = (code >= 0)[:, :, None]
            row = (v[code] * known).sum(0) * w[:, None]
            for at in code:
                ok = at >= 0
                np.add.at(total, at[ok], row[ok])
                touched[at[ok]] = True
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))],
                                         ["j", "v"])

    rows = (patterns.mapInArrow(run, "j int, v array<double>").groupBy("j")
            .agg(F.array(*[F.sum(F.col("v")[i]) for i in range(q)]).alias("v")).collect())
    out = np.zeros((j_all, q))
    for r in rows:
        out[r["j"]] = r["v"]
    return out


def fit_mca(df: DataFrame, cols: list[str], n_components: int = 3, block: int = MCA_BLOCK, tol: float = 1e-12) -> MCAModel:
    """MCA by subspace iteration.

    With Z the n×J indicator matrix, K answers per row and column masses
    c = counts/(nK), the wanted vectors are the first eigenvectors of
    S = D_c^{-1/2}(ZᵀZ/(nK²) − ccᵀ)D_c^{-1/2}; row principal coordinates are the
    mean of c_j^{-1/2}·v_j over a row's categories.  S is never formed: a block
    of vectors is multiplied by Z and Zᵀ where the answers are (once per distinct
    answer pattern) and made orthonormal on the driver, which holds J × q
    numbers, until the Ritz values stand still.  With no more categories than
    the block has columns one product is exact.
    Inertia % divides by the total inertia (J − K)/K (S-12).  Input columns must
    be complete (mode-impute first).
    """
    patterns, cats, counts = _answer_patterns(df, cols)
    j, k, n = len(cats), len(cols), counts.sum() / max(len(cols), 1)
    root = np.sqrt(counts / (n * k))

    def product(v):
        z = _indicator_product(patterns, cols, cats, v / root[:, None])
        return z / (n * k * k) / root[:, None] - np.outer(root, root @ v)

    d = min(n_components, j)
    q = min(j, max(block, 2 * d))
    v = np.eye(j) if q == j else np.linalg.qr(np.random.default_rng(0).standard_normal((j, q)))[0]
    values = np.full(d, np.inf)
    for _ in range(MCA_ROUNDS):
        sv = product(v)
        small_ = v.T @ sv
        w, x = sorted_eigh((small_ + small_.T) / 2)
        vectors = v @ x[:, :d]
        if q == j or np.abs(w[:d] - values).max() <= tol * max(abs(w[0]), 1e-300):
            break
        values, v = w[:d], np.linalg.qr(sv)[0]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])
    vectors = vectors * np.where(signs == 0, 1, signs)
    total = (j - k) / k
    inertia = [round(float(w[i] / total * 100), 2) if total > 0 else 0.0 for i in range(d)]
    return MCAModel(cols, cats, w[:d], inertia, vectors / root[:, None])


# ---------------------------------------------------------------------------
# PCA (M12, M14)
# ---------------------------------------------------------------------------

@dataclass
class PCAModel:
    cols: list[str]
    means: np.ndarray
    components: np.ndarray      # p × d
    explained_variance: np.ndarray
    explained_ratio: np.ndarray

    def to_table(self, spark) -> DataFrame:
        """Components, one row per variable and component."""
        rows = [(c, k + 1, float(self.components[j, k]), float(self.means[j]), float(self.explained_variance[k]),
                 float(self.explained_ratio[k])) for j, c in enumerate(self.cols)
                for k in range(self.components.shape[1])]
        return spark.createDataFrame(rows, "var string, component int, weight double, mean double, "
                                           "variance double, ratio double")

    @classmethod
    def from_table(cls, table: DataFrame, cols: list[str]) -> "PCAModel":
        rows = table.collect()
        d = max(r["component"] for r in rows)
        w, m, var, ratio = np.zeros((len(cols), d)), np.zeros(len(cols)), np.zeros(d), np.zeros(d)
        for r in rows:
            j, k = cols.index(r["var"]), r["component"] - 1
            w[j, k], m[j], var[k], ratio[k] = r["weight"], r["mean"], r["variance"], r["ratio"]
        return cls(cols, m, w, var, ratio)

    def score_columns(self, prefix: str = "pc") -> list[Column]:
        out = []
        for k in range(self.components.shape[1]):
            e = F.lit(0.0)
            for j, c in enumerate(self.cols):
                e = e + F.lit(float(self.components[j, k])) * (_q(c) - F.lit(float(self.means[j])))
            out.append(e.alias(f"{prefix}{k + 1}"))
        return out


def fit_pca(df: DataFrame, cols: list[str], n_components: int | None = None) -> PCAModel:
    """PCA from the sample covariance (one aggregation) + ``eigh``.

    Scores are centred (x − mean)·v; sign: the largest-|entry| of each
    component is positive.
    """
    cov, means, _ = gram.moments(df, cols, "cov")
    w, v = sorted_eigh(cov)
    d = n_components or len(cols)
    total = float(np.trace(cov))
    return PCAModel(cols, means, v[:, :d], w[:d], w[:d] / total)


def latent_space(df: DataFrame, cols: list[str], id_col: str = "row_id", n_components: int = 3,
                 n_quantiles: int = 1000) -> tuple[DataFrame, PCAModel, DataFrame]:
    """Quantile→normal on every latent column, then PCA.

    Returns ``(scores_df(id, pc1..pcd), pca_model, grid)``.
    """
    grid = ranks.quantile_grid(df, cols, n_quantiles)
    qt = saved(ranks.quantile_normal_transform(df.select(id_col, *cols), grid, cols), "normal")
    model = fit_pca(qt, cols, n_components)
    return qt.select(id_col, *model.score_columns()), model, grid
