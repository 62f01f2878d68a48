"""Streaming use of the row-local operators.

The reference is batch only.  The cleaning and encoding operators that look
at one row at a time (range / domain validation, token nulling, dictionary
scales, yes/no codes) are plain projections, so they run unchanged on a
streaming DataFrame; this module only wires them to ``readStream`` /
``writeStream``.  Operators that need the whole table (duplicates, sparse
columns, ranks, clustering) stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import encode, quality


def clean_rows(df: DataFrame, likert: dict | None = None, domains: dict | None = None,
               token: tuple | None = None, binaries: dict | None = None) -> DataFrame:
    """Row-local cleaning: ``likert={col: (lo, hi)}``, ``domains={col: [values]}``,
    ``token=(value, [cols])``, ``binaries={col: (yes, no)}`` (adds ``col_code``)."""
    for c, (lo, hi) in (likert or {}).items():
        df = df.withColumn(c, quality.in_range(c, lo, hi))
    if domains:
        df = quality.domain_validate(df, domains)
    if token:
        df = quality.token_to_null(df, token[1], token[0])
    for c, (yes, no) in (binaries or {}).items():
        df = df.withColumn(f"{c}_code", encode.binary_encode(c, yes, no))
    return df


def stream_to_stage(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append a cleaned stream to a Parquet stage table (exactly-once via the
    streaming checkpoint).  Returns the started query."""
    w = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


__all__ = ["clean_rows", "stream_to_stage"]
