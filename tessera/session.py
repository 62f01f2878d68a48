"""Session helpers.

On a cluster the session comes from the launcher and already carries its own
settings; these helpers only fill in what is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on.  They are applied with
# ``setIfMissing`` semantics so a cluster configuration always wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Runtime settings that are filled in where neither launcher nor caller set them.
# Texts have no common length, so Arrow batches are bounded by bytes, not by rows
# alone: Spark's own 256 MB would meet a task's memory several times over.
_RUNTIME = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` when no session exists.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    b = b.master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value
    is always used.  Only when it is unset and the master is local (tests) a
    private scratch folder is created; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    for key, value in _RUNTIME.items():
        # asked for by key: this runs before every saved table, and all settings are slow to list
        if spark.conf.get(key, None) is None and sc.getConf().get(key) is None:
            spark.conf.set(key, value)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written stage tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
