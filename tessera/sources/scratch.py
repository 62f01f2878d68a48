"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Rows that a broadcast side may have; a wider one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


#: Per thread, the paths written within each open :func:`temporary`, outermost first.
_WRITTEN: dict[int, list[list[str]]] = {}


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what :func:`saved` wrote within, but for tables to ``keep``,
    and has Spark's cleaner drop the shuffle files of plans that nobody holds any more."""
    scopes = _WRITTEN.setdefault(get_ident(), [])
    paths: list[str] = []
    scopes.append(paths)
    try:
        yield
    finally:
        scopes.remove(paths)
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()            # Python's handles on plans, then the JVM's
        spark._jvm.System.gc()


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again.

    Later reads neither recompute it nor depend on the executors that made it.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    scopes = _WRITTEN.get(get_ident(), [])
    scopes = scopes[:-1] if keep else scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, a saved table of a few narrow columns, with a broadcast hint if it
    has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
