"""Orders over whole tables without a task that holds a group.

Rows are cut into ranges of their sort key and written with the number of the
range.  What a range needs from the others is one row per range: the sums that
its first group brings along, or the row that follows its last one.  These small
tables (as many rows as ranges) are broadcast; all else happens within a range.

Rows whose whole sort key is equal lie in one range; ``SPREAD`` can be added as
the last key where such rows may be many and their order does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import saved

SPREAD = "_spread"


def spread(df: DataFrame, seed: int = 1) -> DataFrame:
    """``df`` with a column that deals equal rows over ranges."""
    return df.withColumn(SPREAD, F.rand(seed))


def ranged(df: DataFrame, keys: list[str], name: str = "ranges") -> DataFrame:
    """``df`` cut into ranges of ``keys`` (nulls first), written with ``_part``,
    the number of the range."""
    return saved(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)


def _same(group: list[str], side: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{side}.{g}")) for g in group], F.lit(True))


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` (``ranged`` by ``group`` and ``order``) with running sums per group,
    each row's own value included."""
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_part", *group).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    # a range goes on with at most one group of the ranges before it
    carried = (totals.select("_part", *group, *[F.sum(n).over(before).alias(n) for n in sums])
               .where(f"`{next(iter(sums))}` is not null")
               .select("_part", F.struct(*[F.col(g) for g in group], F.lit(0).alias("_")).alias("_g"),
                       *[F.col(n).alias(f"_before_{n}") for n in sums]))
    own = df.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    own = own.join(F.broadcast(carried), "_part", "left")
    mine = _same(group, "_g")
    return own.withColumns({n: F.col(n) + F.when(mine, F.coalesce(f"_before_{n}", F.lit(0))).otherwise(0)
                            for n in sums}).drop("_g", *[f"_before_{n}" for n in sums])


def neighbour(df: DataFrame, group: list[str], order: str, value: str, out: str, ahead: bool = True) -> DataFrame:
    """``df`` (``ranged`` by ``group`` and ``order``, or some of its rows) with ``out``:
    ``value`` of the next row of the group, or of the one before; null at the end."""
    inside = Window.partitionBy("_part", *group).orderBy(order)
    shift, pick = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    row = F.struct(*group, F.col(value).alias("_value"))
    ends = (df.groupBy("_part").agg(pick(row, F.struct(*group, order)).alias("_end"))
            .select("_part", shift("_end").over(Window.orderBy("_part")).alias("_near")))
    own = (df.withColumn(out, shift(value).over(inside))
           .withColumn("_edge", shift(F.lit(1)).over(inside).isNull()).join(F.broadcast(ends), "_part"))
    return own.withColumn(out, F.when(F.col("_edge"), F.when(_same(group, "_near"), F.col("_near._value")))
                          .otherwise(F.col(out))).drop("_near", "_edge")


def following(df: DataFrame, group: list[str], col: str, out: str) -> DataFrame:
    """``neighbour`` of ``col`` itself."""
    return neighbour(df, group, col, col, out)
