"""Correlation and covariance of many columns from one blocked Gram accumulator
(M4, M12, M14, A18).

Every task keeps, for all pairs of columns at once, the sums that a pair's
moments need over the rows in which both are known (four matrix products per
batch) and hands them on as one row per pair; one aggregation adds them up, so
the plan has one aggregate with six sums whatever the number of columns.

Values are shifted by the columns' means over a first few rows.  Moments do not
depend on the shift; it keeps the sums of squares near the variances, where
differences of large numbers would lose the digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose means are the shift.
SHIFT_ROWS = 1000

_PAIR = ["i", "j", "n", "ai", "aj", "bi", "bj", "g"]
_SCHEMA = "i int, j int, n double, ai double, aj double, bi double, bj double, g double"


def _doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    x = [F.col(f"`{c}`").try_cast("double") for c in cols]
    return df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(x)])


def _shift(values: DataFrame, p: int) -> np.ndarray:
    row = values.limit(SHIFT_ROWS).agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(p)]).first()
    return np.array([v or 0.0 for v in row], float)


def pair_sums(df: DataFrame, cols: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(one row per pair ``i <= j`` with the number of rows that know both, the sums
    ``ai, aj`` of the shifted values, ``bi, bj`` of their squares and ``g`` of
    their products; the shift)."""
    p = len(cols)
    values = _doubles(df, cols)
    shift = _shift(values, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b, g = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            n += m.T @ m
            a += x.T @ m                # a[i, j]: values of i where j is known
            b += (x * x).T @ m
            g += x.T @ x
        i, j = np.triu_indices(p)
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], a[i, j], a[j, i], b[i, j], b[j, i], g[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _PAIR)

    sums = values.mapInArrow(run, _SCHEMA).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _PAIR[2:]])
    return sums, shift


def correlation() -> Column:
    """Pearson correlation of a row of :func:`pair_sums`; null where a variance is
    zero or fewer than two rows know both."""
    n = F.col("n")
    vi = F.col("bi") - F.col("ai") * F.col("ai") / n
    vj = F.col("bj") - F.col("aj") * F.col("aj") / n
    c = F.col("g") - F.col("ai") * F.col("aj") / n
    # what rounding leaves of a constant column's variance is no variance
    some = (vi > 1e-13 * F.col("bi")) & (vj > 1e-13 * F.col("bj"))
    return F.when((n > 1) & some, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / F.sqrt(vi * vj))))


def covariance() -> Column:
    """Sample covariance of a row of :func:`pair_sums`."""
    n = F.col("n")
    return F.when(n > 1, (F.col("g") - F.col("ai") * F.col("aj") / n) / (n - 1))


def moments(df: DataFrame, cols: list[str], kind: str = "corr") -> tuple[np.ndarray, np.ndarray, int]:
    """(p x p correlation or sample covariance matrix, column means, rows).

    Rows with a null in a pair are left out of that pair; the p x p result is
    what the driver solves."""
    p = len(cols)
    sums, shift = pair_sums(df, cols)
    value = correlation() if kind == "corr" else covariance()
    rows = sums.select("i", "j", value.alias("v"), "n", (F.col("ai") / F.col("n")).alias("mean")).collect()
    out, means, n = np.full((p, p), np.nan), np.full(p, np.nan), 0
    for r in rows:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = np.nan if r["v"] is None else r["v"]
        if i == j:
            means[i] = np.nan if r["mean"] is None else r["mean"] + shift[i]
            n = max(n, int(r["n"]))
            if kind == "corr":
                out[i, i] = 1.0
    return out, means, n
