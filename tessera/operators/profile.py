"""Profile queries.

Wide→long via ``unpivot`` then one ``groupBy``: one scan for any number of
variables (the reference makes one pass per column and segment).  Shares of a
total use the total of the *aggregated* table; windows run only over
aggregated tables (counts per key), never over raw rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import gram
from tessera.operators.ranks import to_long, exact_quantiles
from tessera.sources.scratch import saved, small


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def describe_many(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = ()) -> DataFrame:
    """``(group..., var, n, mean, std, min, max)`` (A3).  std is ddof=1."""
    long = to_long(df, cols, list(group_cols))
    return long.groupBy(*group_cols, "var").agg(
        F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"),
        F.stddev_samp("val").alias("std"), F.min("val").alias("min"), F.max("val").alias("max"))


def grouped_means(df: DataFrame, cols: list[str], group_col: str) -> DataFrame:
    """Mean of many variables per segment, long form ``(var, seg, n, mean)``."""
    long = to_long(df, cols, [group_col]).where(_q(group_col).isNotNull())
    return long.groupBy("var", group_col).agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"))


def grouped_stats(df: DataFrame, col: str, group_col: str) -> DataFrame:
    """``(seg, n, mean, median, std, min, max)`` of one measure.

    The median is exact and comes from the ranked histogram (bounded memory
    per task whatever the group size).
    """
    x = _q(col).try_cast("double")
    base = df.select(_q(group_col).alias(group_col), x.alias(col)).where(
        F.col(col).isNotNull() & F.col(group_col).isNotNull())
    st = base.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    med = exact_quantiles(to_long(base, [col], [group_col]), [group_col], [0.5]).select(
        group_col, F.col("q").alias("median"))
    return st.join(med, group_col).select(group_col, "n", "mean", "median", "std", "min", "max")


def freq_share(df: DataFrame, col: str, group_col: str | None = None) -> DataFrame:
    """Frequency and share (nulls excluded).

    ``(group?, value, n, share)`` — share of the group (or grand) total.  The
    totals come from a second aggregation of the counts table, which is computed
    once; the source is read once.
    """
    keys = [group_col] if group_col else []
    base = df.where(_q(col).isNotNull())
    counts = base.groupBy(*[_q(k) for k in keys], _q(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    if keys:
        tot = counts.groupBy(*keys).agg(F.sum("n").alias("_tot"))
        out = counts.join(tot, keys)
    else:
        # grand total: one number, read back as a literal (no join, no
        # single-partition window over the counts table)
        counts = saved(counts, "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        out = counts.withColumn("_tot", F.lit(total))
    return out.select(*keys, "value", "n", (F.col("n") / F.col("_tot")).alias("share"))


def top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """Top ``n`` values by count, ties by value (O2)."""
    return (df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(n))


def top_n_per_group(df: DataFrame, col: str, group_col: str, n: int, salt: int = 16) -> DataFrame:
    """Top ``n`` values per group with share of the group and share of the value.

    ``(seg, rank, value, n, pct_group, pct_value)``.  Two-level top-n over
    the (group, value) count table: first within (group, hash(value) mod
    ``salt``), then within the group over at most ``salt × n`` survivors — a
    group with millions of distinct values is never sorted in one task.
    Exact: with the tie order (count desc, value asc) every member of a
    group's top n is in the top n of its own salt bucket.
    """
    base = df.where(_q(col).isNotNull() & _q(group_col).isNotNull())
    pair = base.groupBy(_q(group_col).alias(group_col), _q(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    gt = pair.groupBy(group_col).agg(F.sum("n").alias("_g"))
    vt = pair.groupBy("value").agg(F.sum("n").alias("_v"))
    order = [F.desc("n"), F.asc("value")]
    w1 = W.partitionBy(group_col, F.pmod(F.xxhash64("value"), F.lit(salt))).orderBy(*order)
    cand = pair.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1")
    w = W.partitionBy(group_col).orderBy(*order)
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return (ranked.join(gt, group_col).join(vt, "value")
            .select(group_col, F.col("rank").cast("long").alias("rank"), "value", "n",
                    (100.0 * F.col("n") / F.col("_g")).alias("pct_group"),
                    (100.0 * F.col("n") / F.col("_v")).alias("pct_value")))


def crosstab_row_pct(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Cross-tabulation normalised by row, long form ``(row, col, n, pct)``."""
    base = df.where(_q(row_col).isNotNull() & _q(col_col).isNotNull())
    pair = base.groupBy(_q(row_col).alias(row_col), _q(col_col).alias(col_col)).agg(
        F.count(F.lit(1)).alias("n"))
    rt = pair.groupBy(row_col).agg(F.sum("n").alias("_r"))
    return pair.join(rt, row_col).select(row_col, col_col, "n",
                                         (100.0 * F.col("n") / F.col("_r")).alias("pct"))


def inverse_marginal(df: DataFrame, key_col: str, group_col: str, top: int) -> DataFrame:
    """For the ``top`` most frequent keys: share of each group within the key."""
    topk = top_n(df, key_col, top).select(F.col("value").alias(key_col))
    sub = df.join(topk, key_col, "left_semi")
    return crosstab_row_pct(sub, key_col, group_col)


def yes_share(df: DataFrame, cols: list[str], group_col: str,
              yes: str = "Si", no: str = "No") -> DataFrame:
    """Percentage answering ``yes`` among yes/no answers per group."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), _q(c).cast("string").alias("val"))
                                for c in cols]))
    long = df.select(_q(group_col).alias(group_col), stack.alias("s")).select(group_col, "s.*")
    return (long.where(F.col(group_col).isNotNull()).groupBy("var", group_col).agg(
        F.count_if(F.col("val") == yes).alias("n_yes"),
        F.count_if(F.col("val").isin(yes, no)).alias("n_answered"))
        .withColumn("pct_yes", F.when(F.col("n_answered") > 0,
                                      100.0 * F.col("n_yes") / F.col("n_answered"))))


def sign_classes(df: DataFrame, col: str, group_col: str) -> DataFrame:
    """Share of up / same / down changes, per group and global.

    ``rollup(group)``: the row with a null group is the global total.
    """
    x = _q(col)
    base = df.where(x.isNotNull())
    return (base.rollup(_q(group_col)).agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.count_if(x > 0) / F.count(F.lit(1))).alias("pct_up"),
        (100.0 * F.count_if(x == 0) / F.count(F.lit(1))).alias("pct_same"),
        (100.0 * F.count_if(x < 0) / F.count(F.lit(1))).alias("pct_down"),
        F.grouping(_q(group_col)).alias("is_total")))


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of all pairs ``var1 < var2``.

    One aggregation computes every pair whatever their number
    (:mod:`tessera.operators.gram`); a pair skips rows where either side is null.
    """
    sums, _ = gram.pair_sums(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    first, second = names[F.col("i")], names[F.col("j")]
    return sums.where("i < j").select(first.alias("var1"), second.alias("var2"), gram.correlation().alias("r"))


def top_corr_pairs(df: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    """Strongest ``n`` pairs by |r| (A18 top pairs)."""
    return corr_pairs(df, cols).orderBy(F.desc(F.abs("r")), "var1", "var2").limit(n)


def mean_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean correlation over all pairs (A18): one row ``(n_pairs, mean_r, mean_abs_r)``."""
    return corr_pairs(df, cols).agg(F.count("r").alias("n_pairs"), F.avg("r").alias("mean_r"),
                                    F.avg(F.abs("r")).alias("mean_abs_r"))


def box_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Five-number summary + 1.5·IQR fences and outlier count per column."""
    long = to_long(df, cols)
    q = (exact_quantiles(long, ["var"], [0.25, 0.5, 0.75])
         .groupBy("var").agg(F.max(F.when(F.col("j") == 0, F.col("q"))).alias("q1"),
                             F.max(F.when(F.col("j") == 1, F.col("q"))).alias("median"),
                             F.max(F.when(F.col("j") == 2, F.col("q"))).alias("q3")))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    q = saved(q, "fences")          # a row per column: the values stay where they are
    mm = long.join(F.broadcast(q.select("var", "lo_fence", "hi_fence")), "var").groupBy("var").agg(
        F.count(F.lit(1)).alias("n"), F.min("val").alias("min"), F.max("val").alias("max"),
        F.count_if((F.col("val") < F.col("lo_fence")) | (F.col("val") > F.col("hi_fence"))).alias("n_outliers"))
    return q.join(mm, "var")


def bin_labels(col: str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins ``(e_i, e_{i+1}]`` (A20).  ``Bucketizer`` is left-closed."""
    x = _q(col)
    out = None
    for (lo, hi), lab in zip(zip(edges[:-1], edges[1:]), labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def bin_histogram(df: DataFrame, col: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts per right-closed bin."""
    return (df.select(bin_labels(col, edges, labels).alias("bin"))
            .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def prefix_sums(df: DataFrame, prefix: str) -> DataFrame:
    """Sum of every column named ``prefix*`` (one-hot counts), long form."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    one = df.agg(*[F.sum(_q(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_s{i}").alias("total"))
                                for i, c in enumerate(cols)]))
    return one.select(stack.alias("s")).select("s.*")


#: Bins per bandwidth and moments per bin of the density.
DENSITY_BINS = 8
DENSITY_MOMENTS = 7


def group_density(df: DataFrame, col: str, group_col: str, grid_size: int = 50) -> DataFrame:
    """Gaussian kernel density of ``col`` per group on a common grid.

    Bandwidth per group by Scott's rule ``h = s·n^(-1/5)`` (s = sample std);
    grid = ``grid_size`` points from the global min to max.  Values are binned,
    ``DENSITY_BINS`` to a bandwidth, and a bin keeps the sums of the first powers
    of their distances to its middle (mergeable, one pass).  A bin's kernels at a
    grid point are then a convolution: with u the distance of the middles in
    bandwidths, exp(-(u-v)²/2) = exp(-u²/2)·Σ He_k(u)·v^k/k!.  As |v| <= 1/16, the
    terms left out are below 1e-9 of a kernel's peak, at any number of rows.
    ``(seg, g, x, density)``; a group without spread has none.
    """
    x = _q(col).try_cast("double")
    base = df.select(_q(group_col).alias("_seg"), x.alias("x")).where(
        F.col("x").isNotNull() & F.col("_seg").isNotNull())
    st = saved(base.groupBy(F.col("_seg").alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), (F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"),
        F.min("x").alias("lo"), F.max("x").alias("hi")), "spread")
    rng = st.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if rng["lo"] is None:
        return base.select(F.col("_seg").alias(group_col), F.lit(0).alias("g"), "x", F.col("x").alias("density")).where("false")
    lo, hi = float(rng["lo"]), float(rng["hi"])
    step = (hi - lo) / (grid_size - 1) if grid_size > 1 else 0.0
    width = F.col("h") / DENSITY_BINS
    bins = (base.join(small(st.select("_g", "n", "h")), F.col("_seg") == F.col("_g")).where("h > 0")
            .withColumn("bin", F.floor((F.col("x") - lo) / width))
            .withColumn("v", (F.col("x") - lo - (F.col("bin") + 0.5) * width) / F.col("h")))
    power, sums = F.lit(1.0), []
    for k in range(DENSITY_MOMENTS):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("v")
    bins = bins.groupBy("_seg", "n", "h", "bin").agg(*sums)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.lit(lo + i * step).alias("x")) for i in range(grid_size)]))
    u = (F.col("p.x") - lo - (F.col("bin") + 0.5) * width) / F.col("h")
    hermite, total = [F.lit(1.0), F.col("u")], F.col("m0") + F.col("m1") * F.col("u")
    for k in range(2, DENSITY_MOMENTS):
        hermite.append(F.col("u") * hermite[-1] - (k - 1) * hermite[-2])
        total = total + F.col(f"m{k}") * hermite[k] / math.factorial(k)
    at = bins.select("*", grid.alias("p")).withColumn("u", u).where("abs(u) < 39")
    every = st.where("h > 0").select(F.col("_g").alias("_seg"), "n", "h", grid.alias("p")).select(
        "_seg", "n", "h", F.col("p.g").alias("g"), F.col("p.x").alias("x"))
    kernel = at.groupBy("_seg", F.col("p.g").alias("g")).agg(
        F.sum(F.exp(-0.5 * F.col("u") * F.col("u")) * total).alias("k"))
    c = 1.0 / (2.0 * math.pi) ** 0.5
    return every.join(kernel, ["_seg", "g"], "left").select(
        F.col("_seg").alias(group_col), "g", "x", (F.coalesce("k", F.lit(0.0)) * c / (F.col("n") * F.col("h"))).alias("density"))


def mean_extremes(df: DataFrame, cols: list[str], group_col: str, n: int = 3) -> DataFrame:
    """Strongest and weakest ``n`` variables per segment by mean.

    ``(seg, side, rank, var, mean)`` with side 'top' / 'bottom'.
    """
    m = grouped_means(df, cols, group_col)
    wt = W.partitionBy(group_col).orderBy(F.desc("mean"), "var")
    wb = W.partitionBy(group_col).orderBy(F.asc("mean"), "var")
    top = m.withColumn("rank", F.row_number().over(wt)).where(F.col("rank") <= n).withColumn("side", F.lit("top"))
    bot = m.withColumn("rank", F.row_number().over(wb)).where(F.col("rank") <= n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot).select(group_col, "side", F.col("rank").cast("long").alias("rank"), "var", "mean")


def arg_extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variable with the highest and lowest mean (O3): ``max_by`` / ``min_by``."""
    long = to_long(df, cols).groupBy("var").agg(F.avg("val").alias("mean"))
    return long.agg(F.max_by("var", F.struct("mean", "var")).alias("max_var"), F.max("mean").alias("max_mean"),
                    F.min_by("var", F.struct("mean", F.col("var"))).alias("min_var"), F.min("mean").alias("min_mean"))


def low_share(df: DataFrame, cols: list[str], threshold: float = 2.0) -> DataFrame:
    """Share of answers ≤ threshold among non-null answers per item (R17 item focus)."""
    long = to_long(df, cols)
    return long.groupBy("var").agg(F.count(F.lit(1)).alias("n"),
                                   (100.0 * F.count_if(F.col("val") <= threshold) / F.count(F.lit(1))).alias("pct_low"))


def cumulative_share(df: DataFrame, order_col: str, value_col: str, target: float = 85.0):
    """Cumulative sum of a share column and the first index reaching ``target``.

    Runs on a small ordered table (one row per component)."""
    w = W.orderBy(order_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = df.withColumn("cum", F.sum(value_col).over(w))
    first = cum.where(F.col("cum") >= target).agg(F.min(order_col).alias("n_for_target"))
    return cum, first
