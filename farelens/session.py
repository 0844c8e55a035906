"""Session construction and the shared scratch location.

On a cluster, ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
that every executor can reach; all lineage cuts and materialised tables go
below it. Only when the setting is missing and the master is local (tests) do
we pick a fresh local folder, once per process; a cluster session without the
setting is refused, for its executors would each write to their own disk.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(cpus: int | str = "*", app: str = "farelens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured the way the operators expect.

    AQE stays on: it coalesces small shuffle partitions, converts joins to
    broadcast only after measuring the real size of the smaller side, and
    splits skewed join partitions. The UI is off (no ports beyond Spark's own).
    """
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # checkpoint files of short-lived results (per-route stats) are removed
        # once their DataFrame is garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Reads ``spark.checkpoint.dir`` from the session. If it is unset, a session
    with a checkpoint folder of its own uses that one; a local session gets a
    fresh local folder, registered as the checkpoint directory; any other master
    raises, as no folder is known that all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        # setCheckpointDir appends a per-application uuid folder; use its parent
        return current.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="farelens-scratch-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[key])
    return _LOCAL_FALLBACK[key]
