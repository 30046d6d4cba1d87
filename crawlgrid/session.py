"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# SQL settings every operator assumes. They are runtime-settable, so they are
# applied to whatever session the caller hands us.
SESSION_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # map_concat overlays (parameters over defaults) keep the last key.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # job files are many and small: several hundred of them make one task, and
    # listing their folders takes that many tasks at most
    "spark.sql.files.openCostInBytes": str(256 << 10),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # of repeated keys of an item the last one holds, as in a map
    "spark.sql.variant.allowDuplicateKeys": "true",
    # ids are hex digests, of which zstd saves half and snappy nothing
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    for k, v in SESSION_SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, app: str = "crawlgrid",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``shuffle_partitions`` is only a starting point: AQE coalesces small
    shuffle outputs at run time and splits skewed ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SESSION_SQL_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder (``spark.checkpoint.dir``), registered with
    the SparkContext. Only a local session may go without the setting: it gets
    a folder under /tmp. On a cluster a machine's own folder would scatter the
    files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join("/tmp", "crawlgrid-ckpt-" + uuid.uuid4().hex[:8])
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory name under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name + "-" + uuid.uuid4().hex[:12]
