"""Session defaults and the shared scratch / checkpoint folder.

The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a
local session (tests, the bench) may leave it unset; a temporary one is then
chosen and written back into the session, so every later call agrees on it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins from measured sizes
# (runtime broadcast only below the threshold, skew-join splitting of hot
# keys), coalesces small shuffle partitions, and the checkpoint folder cuts
# lineage of iterative operators.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of iterative rounds are dropped once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "kgprep",
            extra: dict[str, str] | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset: then a temporary folder is
    chosen.  On a cluster a folder of one machine is of no use to the others.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="kgprep-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


__all__ = ["DEFAULT_CONF", "checkpoint_dir", "scratch_path", "session"]

