"""Stage sinks.

Stages hand over through Parquet, as in the reference, but a stage never
overwrites the path it reads from (S7): callers pass a new path or version.
Fitted parameters (medians, loadings, category coordinates, quantile grids,
centroids) are small DataFrames written as Parquet next to the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stringify_text_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast mixed/object-like columns to string, keeping nulls (S3).

    ``columns`` defaults to all non-numeric, non-temporal columns.
    """
    keep = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
            T.TimestampNTZType)
    if columns is None:
        columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, keep)]
    todo = set(columns)
    return df.select(*[
        (F.col(f"`{f.name}`").cast("string").alias(f.name) if f.name in todo
         else F.col(f"`{f.name}`")) for f in df.schema.fields])


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> str:
    """Parquet sink of a stage table (S3); an existing path is an error unless ``mode`` says otherwise."""
    w = stringify_text_columns(df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV sink with header (S4: metrics tables, loadings)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def save_params(spark: SparkSession, params: dict[str, DataFrame], path: str) -> str:
    """Save a bundle of fitted parameter tables (S5), one Parquet each."""
    for name, p in params.items():
        p.write.parquet(f"{path.rstrip('/')}/{name}")
    return path


def load_params(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
