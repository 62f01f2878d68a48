"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then
answer, for any context limit, how many documents and tokens lie at or above
it, what remains after truncation, and the quantiles.  Only the histogram, one
row per distinct length, is shuffled; sums run within blocks of ``BLOCK``
lengths, with one total per block added from above, so no task takes the whole
histogram.

Defined cases: null and empty texts have length 0; every input row counts, also
repeated ones; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.sources.scratch import saved

BLOCK = 1024


def token_length(path: str):
    @F.arrow_udf("bigint")
    def length(text: pa.Array) -> pa.Array:
        enc = tokens.encoder(path)
        return pa.array([len(enc.ids(t.as_py())) for t in text], pa.int64())
    return length


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``length, n_docs``: documents by encoded length."""
    size = token_length(path or tokens.default_path())
    return (docs.select(size(F.col(text_col)).alias("length"))
            .groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame, limits: tuple = ()) -> DataFrame:
    """A row per distinct length and per further limit, as the context limit.

    ``docs_over``: documents longer than the limit; ``docs_fit``: the others;
    ``tokens_fit``: tokens of documents that fit; ``tokens_truncated``: tokens
    kept when every document is cut at the limit; ``tokens_lost``: the rest;
    ``rank``: share of documents of at most this length (the quantile it is).
    """
    spark = hist.sparkSession
    hist = saved(hist, "lengths")
    extra = spark.createDataFrame([(int(x), 0) for x in limits], "length long, n_docs long")
    h = (hist.select("length", "n_docs").unionByName(extra)
         .groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
         .withColumn("block", F.floor(F.col("length") / BLOCK)))
    h = h.withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = (h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
              .select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
                      F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
                      F.sum("d").over(every).alias("all_docs"),
                      F.sum("t").over(every).alias("all_tokens")))
    over = (Window.partitionBy("block").orderBy(F.desc("length"))
            .rowsBetween(Window.unboundedPreceding, -1))
    out = h.join(blocks, "block").select(
        "length", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(over), F.lit(0))).alias("docs_over"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(over), F.lit(0))).alias("_over"))
    kept = F.col("all_tokens") - F.col("_over") + F.col("docs_over") * F.col("length")
    return out.select(
        F.col("length").alias("context_limit"), "n_docs", "tokens",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_fit"), "docs_over",
        (F.col("all_tokens") - F.col("_over")).alias("tokens_fit"),
        kept.alias("tokens_truncated"), (F.col("all_tokens") - kept).alias("tokens_lost"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("rank"))


def quantiles(sums: DataFrame, probabilities: tuple) -> DataFrame:
    """Least length whose rank reaches each probability (inverse distribution)."""
    ps = sums.sparkSession.createDataFrame([(float(p),) for p in probabilities], "p double")
    return (sums.where("n_docs > 0")
            .select("context_limit", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
                    .alias("p"), "rank")
            .where("rank >= p").groupBy("p").agg(F.min("context_limit").alias("length"))
            .join(F.broadcast(ps), "p", "right"))
