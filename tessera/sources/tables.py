"""Scans (S1, S2, S6).

``load`` reads one of the test tables; ``read_source`` reads a raw survey
export in any Spark format.  Both return lazy DataFrames, so projections and
filters applied later are pushed into the Parquet scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_source(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | str | None = None,
                header: bool = True) -> DataFrame:
    """Read a raw survey table.

    ``csv`` is read with a header; without an explicit schema the types are
    inferred (one extra pass; give a schema in production).  A missing path
    raises ``AnalysisException`` as the reference raises on a missing file.
    Double columns have NaN turned into null so that SQL null is the only
    "missing" marker downstream.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", header).option(
            "inferSchema", schema is None).csv(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = reader.format(fmt).load(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → null for every floating column (pandas treats both as missing)."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)
