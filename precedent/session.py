"""Spark session and shared-storage helpers.

On a cluster the session is created by the platform and carries
``spark.checkpoint.dir`` (a shared folder every executor can reach). We only
read that setting; a private scratch folder is chosen only when it is unset,
which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "precedent",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is set only if none is configured."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            # A private folder is on one machine; other executors would not see it.
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="precedent-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str, metrics: dict | None = None):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: one computation (``checkpoint()`` computes twice unless cached),
    lineage cut, and later scans get column pruning and filter pushdown.

    ``metrics`` (name → aggregate Column) are computed during that same write
    through an ``Observation``; then ``(frame, metrics_dict)`` is returned.
    """
    from pyspark.sql import Observation

    path = shared_path(df.sparkSession, name)
    obs = None
    if metrics:
        obs = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        df = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.parquet(path)
    return (out, dict(obs.get)) if obs is not None else out
