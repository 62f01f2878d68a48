"""Reproducible shuffle and shards from a Feistel permutation with cycle walking.

Every row gets a global number 0..N-1 (its place within a range of the sorted rows
plus the sizes of the ranges before; equal rows are dealt over ranges).  A Feistel network over pairs (left, right) with
left < a, right < b, a * b >= N, permutes 0..a*b-1; a result outside 0..N-1 is
permuted again until it lies inside, which permutes 0..N-1.  As a * b - N < a,
walks are rare, and a walk visits each outside value at most once, which bounds
its length exactly.  Position p means shard p mod n and slot p div n, so shard
sizes differ by at most one row, and both are computable from the row number;
``unpermute`` goes back from shard and slot.

Only built-in functions run.  Defined cases: a null text has no bytes; null ids
and repeated rows are numbered like any other (equal rows in any order); an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._ranges import SPREAD, ranged, running, spread
from tessera.sources.scratch import saved

ROUNDS = 6


class Feistel:
    """Permutation of 0..n-1 as column expressions."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n = max(n, 1)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        self.seed, self.rounds = seed, rounds
        #: values outside 0..n-1, so also the longest walk
        self.outside = self.a * self.b - self.n

    def _round(self, x: Column, i: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), x.cast("long")), F.lit(m).cast("long"))

    def _once(self, p: Column) -> Column:
        right = F.pmod(p, F.lit(self.b).cast("long"))
        left = ((p - right) / self.b).cast("long")
        for i in range(self.rounds):
            if i % 2 == 0:
                left = F.pmod(left + self._round(right, i, self.a), F.lit(self.a).cast("long"))
            else:
                right = F.pmod(right + self._round(left, i, self.b), F.lit(self.b).cast("long"))
        return left * self.b + right

    def _back(self, p: Column) -> Column:
        right = F.pmod(p, F.lit(self.b).cast("long"))
        left = ((p - right) / self.b).cast("long")
        for i in reversed(range(self.rounds)):
            if i % 2 == 0:
                left = F.pmod(left - self._round(right, i, self.a), F.lit(self.a).cast("long"))
            else:
                right = F.pmod(right - self._round(left, i, self.b), F.lit(self.b).cast("long"))
        return left * self.b + right

    def _walk(self, df: DataFrame, col: str, step) -> DataFrame:
        first = df.withColumn(col, step(F.col(col)))
        if not self.outside:
            return first
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(self.outside)), F.col(col),
                             lambda p, _: F.when(p < self.n, p).otherwise(step(p)))
        return first.withColumn(col, F.when(F.col(col) < self.n, F.col(col)).otherwise(walked))

    def permute(self, df: DataFrame, col: str) -> DataFrame:
        """``df`` with the numbers in ``col`` permuted."""
        return self._walk(df, col, self._once)

    def unpermute(self, df: DataFrame, col: str) -> DataFrame:
        """The inverse of ``permute``."""
        return self._walk(df, col, self._back)


def number_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``row_number`` 0..N-1 in the order of ``keys``, equal rows in any order."""
    order = [*keys, SPREAD]
    rows = running(ranged(spread(df), order, "numbered"), [], order, {"row_number": F.lit(1).cast("long")})
    return rows.withColumn("row_number", F.col("row_number") - 1).drop("_part", SPREAD)


def assign_shards(docs: DataFrame, n_shards: int = 24, seed: int = 0, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, row_number, position, shard, slot`` per row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = saved(docs.select(F.col(id_col).alias("doc_id"),
                             (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32")), "rows")
    numbered = number_rows(rows, ["doc_id", "text_crc32", "size"])
    f = Feistel(rows.count(), seed)
    out = f.permute(numbered.withColumn("position", F.col("row_number")), "position")
    return out.withColumn("shard", F.pmod(F.col("position"), F.lit(n_shards)).cast("int")).withColumn(
        "slot", ((F.col("position") - F.col("shard")) / n_shards).cast("long"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as Parquet, a folder ``_shard=n`` per shard, rows in slot order.

    Rows with equal id and text are dealt to their places in any order.
    """
    def numbered(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy("i", "c").orderBy(order)))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    left = numbered(docs.select(row.alias("row"), F.col(id_col).alias("i"),
                                F.crc32(text.cast("binary")).alias("c")), "i")
    place = assign_shards(docs, n_shards, seed, id_col, text_col)
    right = numbered(place.select(F.col("doc_id").alias("i"), F.col("text_crc32").alias("c"),
                                  F.col("shard").alias("_shard"), F.col("slot").alias("at")), "at")
    out = left.join(right.select(F.col("i").alias("i2"), F.col("c").alias("c2"), F.col("k").alias("k2"),
                                 "_shard", "at"),
                    F.col("i").eqNullSafe(F.col("i2")) & (F.col("c") == F.col("c2"))
                    & (F.col("k") == F.col("k2")))
    (out.repartition(n_shards, "_shard").sortWithinPartitions("_shard", "at")
     .select("row.*", "_shard").write.partitionBy("_shard").parquet(path))
