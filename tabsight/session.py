"""Spark session helpers.

The library never creates data on the driver; it only builds plans.  The session
settings below are the ones the operators rely on:

* AQE on, with skew-join splitting, so joins back onto hot keys (group sizes,
  duplicate marks, rank join-backs) are split at run time instead of landing in
  one task;
* session time zone pinned to UTC so timestamps compare equal to other engines;
* the Spark UI off (no server is opened by the library).

``ensure_checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session and only
sets a directory when none is configured (local tests).  On a cluster the shared
folder named there is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # saved tables go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # local runs: the driver JVM is the executor too
    "spark.driver.memory": "8g",
}


def build_session(master: str | None = None, app: str = "tabsight",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is returned
    unchanged.  A local master (tests, bench) gets a fresh folder under the system
    temporary directory; any other without the setting is refused, since executors
    do not share the driver's folders.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tabsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Parquet scan of one fixture table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
