"""Sections of the segment report (R3–R18) as long tables.

Every section returns ``(section, item, segment, stat, value)``: a number of one
item for one segment, ``TOTAL`` for all rows.  Sections unite into one report
table; nothing is printed or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import profile, ranks
from tessera.sources.scratch import saved

TOTAL = "TOTAL"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _stats(df: DataFrame, section: str, item, segment, stats: dict) -> DataFrame:
    """One row per statistic of a wide table."""
    cols = F.array(*[F.struct(F.lit(k).alias("stat"), v.cast("double").alias("value")) for k, v in stats.items()])
    name = F.lit(item) if isinstance(item, str) else item
    seg = F.lit(segment) if isinstance(segment, str) else segment.cast("string")
    return (df.select(F.lit(section).alias("section"), name.alias("item"), seg.alias("segment"),
                      F.explode(cols).alias("s"))
            .select("section", "item", "segment", "s.stat", "s.value"))


def distribution(df: DataFrame, seg: str, section: str = "distribution") -> DataFrame:
    """Size and share of every segment."""
    d = profile.freq_share(df, seg)
    return _stats(d, section, seg, F.col("value"), {"n": F.col("n"), "pct": 100.0 * F.col("share")})


class Summary:
    """Statistics and rank tests of the report's numeric columns, made at the first
    use by one scan and one sort (``ranks.group_summary``) and shared by all sections."""

    def __init__(self, df: DataFrame, cols: list[str], seg: str):
        self.df, self.cols, self.seg = df, list(dict.fromkeys(cols)), seg
        self._made = None

    def of(self, cols: list[str]) -> tuple[DataFrame, DataFrame]:
        if self._made is None:
            self._made = tuple(saved(t, "summary") for t in ranks.group_summary(self.df, self.cols, self.seg))
        return tuple(t.where(F.col("var").isin(list(cols))) for t in self._made)


def item_profile(df: DataFrame, items: list[str], seg: str, section: str, summary: Summary | None = None) -> DataFrame:
    """Mean of every item per segment and the p value across segments."""
    stats, kw = (summary or Summary(df, items, seg)).of(items)
    return (_stats(stats, section, F.col("var"), F.col(seg), {"n": F.col("n"), "mean": F.col("mean")})
            .unionByName(_stats(kw, section, F.col("var"), TOTAL, {"kw_h": F.col("h"), "kw_p": F.col("p_value")})))


def measure(df: DataFrame, col: str, seg: str, section: str, summary: Summary | None = None) -> DataFrame:
    """One measure per segment in full, with the rank test across segments."""
    stats, kw = (summary or Summary(df, [col], seg)).of([col])
    wide = {k: F.col(k) for k in ("n", "mean", "median", "std", "min", "max")}
    return _stats(stats, section, col, F.col(seg), wide).unionByName(
        _stats(kw, section, col, TOTAL, {"kw_h": F.col("h"), "kw_p": F.col("p_value")}))


def yes_rates(df: DataFrame, cols: list[str], seg: str, section: str, yes: str = "Si",
              answers: tuple = ("Si", "No")) -> DataFrame:
    """Share of every listed answer among the listed answers, per segment."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), _q(c).cast("string").alias("a")) for c in cols]))
    long = (df.where(_q(seg).isNotNull()).select(_q(seg).alias("g"), stack.alias("s")).select("g", "s.*")
            .where(F.col("a").isin(*answers)))
    n = long.groupBy("item", "g").agg(F.count(F.lit(1)).alias("n"),
                                      *[F.count_if(F.col("a") == a).alias(f"_{i}") for i, a in enumerate(answers)])
    return _stats(n, section, F.col("item"), F.col("g"), {"n": F.col("n"), **{
        f"pct {a}": 100.0 * F.col(f"_{i}") / F.col("n") for i, a in enumerate(answers)}})


def wellbeing(df: DataFrame, score: str, binary_cols: list[str], items: list[str], seg: str,
              summary: Summary | None = None) -> DataFrame:
    """The score in full, share of ones of the 0/1 answers, satisfaction items."""
    summary = summary or Summary(df, [score, *binary_cols, *items], seg)
    ones, _ = summary.of(binary_cols)
    return (measure(df, score, seg, "wellbeing_score", summary)
            .unionByName(_stats(ones, "wellbeing_yes", F.col("var"), F.col(seg), {"pct": 100.0 * F.col("mean")}))
            .unionByName(item_profile(df, items, seg, "wellbeing_items", summary)))


def programme(df: DataFrame, col: str, seg: str, top: int = 8, per_group: int = 5) -> DataFrame:
    """Coverage, distinct values, top values overall and per segment, and the
    segment shares within the top values."""
    known = F.col("c").isNotNull()
    base = df.select(_q(seg).alias("g"), F.when(_q(col) != "nan", _q(col)).alias("c"))
    cover = base.agg(F.count_if(known).alias("n"), (100.0 * F.count_if(known) / F.count(F.lit(1))).alias("pct"))
    distinct = base.where(known).select("c").distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    share = profile.freq_share(base, "c").orderBy(F.desc("n"), F.asc("value")).limit(top)
    groups = profile.top_n_per_group(base, "c", "g", per_group)
    inverse = profile.inverse_marginal(base, "c", "g", top)
    return (_stats(cover, "programme_coverage", col, TOTAL, {"n": F.col("n"), "pct": F.col("pct")})
            .unionByName(_stats(distinct, "programme_coverage", col, TOTAL, {"n_distinct": F.col("n_distinct")}))
            .unionByName(_stats(share, "programme_top", F.col("value"), TOTAL,
                                {"n": F.col("n"), "pct": 100.0 * F.col("share")}))
            .unionByName(_stats(groups, "programme_by_segment", F.col("value"), F.col("g"), {
                "rank": F.col("rank"), "n": F.col("n"), "pct_segment": F.col("pct_group"),
                "pct_programme": F.col("pct_value")}))
            .unionByName(_stats(inverse, "programme_inverse", F.col("c"), F.col("g"), {"pct": F.col("pct")})))


def mobility(df: DataFrame, col: str, seg: str) -> DataFrame:
    """Up / same / down shares, overall and per segment."""
    m = profile.sign_classes(df, col, seg)
    who = F.when(F.col("is_total") == 1, F.lit(TOTAL)).otherwise(F.col(seg).cast("string"))
    return _stats(m, "mobility", col, who, {"n": F.col("n"), "pct_up": F.col("pct_up"),
                                            "pct_same": F.col("pct_same"), "pct_down": F.col("pct_down")})


def categorical(df: DataFrame, cols: list[str], seg: str, section: str = "categorical") -> DataFrame:
    """Shares of the valid categories (F10) within every segment; the
    item is ``column=category``."""
    out = None
    for c in cols:
        valid = df.select(_q(seg).alias("g"), tx.valid_category(c).alias("c"))
        t = profile.crosstab_row_pct(valid, "g", "c")
        part = _stats(t, section, F.concat(F.lit(f"{c}="), F.col("c")), F.col("g"),
                      {"n": F.col("n"), "pct": F.col("pct")})
        out = part if out is None else out.unionByName(part)
    return out


def robustness(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings."""
    from tessera.operators import validate

    r = validate.adjusted_rand(df, a, b)
    return _stats(r, "robustness", f"{a} / {b}", TOTAL, {"n": F.col("n"), "ari": F.col("ari")})


def eda(df: DataFrame, items: list[str], top: int = 5, low: float = 2.0) -> DataFrame:
    """Item statistics, low shares, strongest correlations and their mean."""
    d = profile.describe_many(df, items)
    pairs = profile.top_corr_pairs(df, items, top)
    mean = profile.mean_corr(df, items)
    lows = profile.low_share(df, items, low)
    return (_stats(d, "eda_items", F.col("var"), TOTAL, {k: F.col(k) for k in ("n", "mean", "std", "min", "max")})
            .unionByName(_stats(lows, "eda_low", F.col("var"), TOTAL, {"pct_low": F.col("pct_low")}))
            .unionByName(_stats(pairs, "eda_pairs", F.concat("var1", F.lit(" / "), "var2"), TOTAL, {"r": F.col("r")}))
            .unionByName(_stats(mean, "eda_pairs", "all", TOTAL, {"mean_r": F.col("mean_r"),
                                                                  "mean_abs_r": F.col("mean_abs_r")})))


def modelling(df: DataFrame, items: list[str], seg: str, target: float = 85.0, n: int = 3) -> DataFrame:
    """The variance table of the items' principal components with the number
    that reaches ``target`` %, the segments' centroids on the first two, and the
    strongest and weakest ``n`` items of every segment."""
    from tessera.operators import latent, validate

    spark = df.sparkSession
    model = latent.fit_pca(df, items)
    table = spark.createDataFrame([(k + 1, float(v * 100)) for k, v in enumerate(model.explained_ratio)], "comp int, pct double")
    cum, first = profile.cumulative_share(table, "comp", "pct", target)
    two = latent.PCAModel(model.cols, model.means, model.components[:, :2], model.explained_variance, model.explained_ratio)
    pcs = [f"pc{k + 1}" for k in range(two.components.shape[1])]
    centres = validate.centroids(df.select(_q(seg).alias("g"), *two.score_columns()).where("g is not null"), pcs, "g")
    extremes = profile.mean_extremes(df, items, seg, n)
    return (_stats(cum, "model_pca", F.concat(F.lit("pc"), F.col("comp").cast("string")), TOTAL,
                   {"pct": F.col("pct"), "cum_pct": F.col("cum"), "kaiser_pct": F.lit(100.0 / len(items))})
            .unionByName(_stats(first, "model_pca", "components", TOTAL, {"n_for_target": F.col("n_for_target")}))
            .unionByName(_stats(centres, "model_projection", seg, F.col("g"), {"n": F.col("n"), **{c: F.col(c) for c in pcs}}))
            .unionByName(_stats(extremes, "model_strengths", F.col("var"), F.col(seg), {
                "top": F.when(F.col("side") == "top", F.col("rank")), "bottom": F.when(F.col("side") == "bottom", F.col("rank")),
                "mean": F.col("mean")}).where("value is not null")))


def compare_studies(a: DataFrame, b: DataFrame, a_item: str, b_item: str, a_seg: str, b_seg: str) -> DataFrame:
    """Two studies' segments side by side by the rank of an item's mean (full outer join)."""
    from pyspark.sql import Window as W

    def ranked(df, item, seg, x):
        """Segments numbered by their mean: by the distributed rank, ties by name."""
        m = saved(df.groupBy(_q(seg).alias(f"seg_{x}")).agg(F.avg(_q(item)).alias(f"mean_{x}")), "means")
        hist = m.groupBy(F.lit(0).alias("_k"), F.col(f"mean_{x}").alias("_v")).agg(F.count(F.lit(1)).alias("cnt"))
        at = ranks.rank_histogram(hist, ["_k"], "_v").select("_v", "before")
        tie = F.row_number().over(W.partitionBy(f"mean_{x}").orderBy(f"seg_{x}"))
        return (m.withColumn("_t", tie).join(at, F.col(f"mean_{x}").eqNullSafe(F.col("_v")))
                .select(f"seg_{x}", f"mean_{x}", (F.col("before") + F.col("_t")).cast("long").alias("rk")))

    return ranked(a, a_item, a_seg, "a").join(ranked(b, b_item, b_seg, "b"), "rk", "full_outer").select(
        "rk", "seg_a", "mean_a", "seg_b", "mean_b")
