"""Session construction and shared-storage helpers.

Cluster rules followed here:
* scratch output (landing tables, snapshots, stream checkpoints) goes under the
  folder named by ``spark.checkpoint.dir`` - on a cluster that is a shared
  filesystem, and without the setting an error is raised; a machine-local
  temporary folder is only used by a local master without the setting, and then
  it is written back into the session so every later call agrees;
* lineage is cut with ``DataFrame.checkpoint()`` (reliable, on that folder),
  never ``localCheckpoint``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


# Settings for a large cluster reading ~100 TB: big input splits (fewer,
# fuller tasks), many shuffle partitions that AQE coalesces to ~256 MB each,
# and skew splitting for partitions far above the median.
CLUSTER_PROFILE = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
}


def build_session(master: str | None = None, app: str = "threadmill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, profile: str | None = None) -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE, no UI).

    ``profile="cluster"`` adds CLUSTER_PROFILE (used by the spark-submit job).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of intermediates are removed once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Broadcasts come from three places only: file scans whose size
        # Catalyst knows below this threshold, operators.joins.small_side
        # after a row count, and AQE from the measured size of a finished stage.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if profile == "cluster":
        conf.update(CLUSTER_PROFILE)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables and checkpoints.

    Read from the session; only when unset (local tests) a private temporary
    folder is created and registered so later calls reuse it.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="threadmill-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for one run."""
    root = checkpoint_root(spark)
    if "://" not in root and not root.startswith("/"):
        root = os.path.abspath(root)
    return f"{root.rstrip('/')}/threadmill/{name}/{uuid.uuid4().hex}"


def materialize(df):
    """Cut lineage of a small, multiply-used intermediate with a reliable
    checkpoint in the shared checkpoint folder (survives executor loss;
    never ``localCheckpoint``)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_rows(df, name: str):
    """Like ``materialize``, for tables that grow with the input: compressed Parquet in a scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
