"""Session helpers.

Library code never creates its own session: every operator takes a
DataFrame. These helpers are for tests, the bench and the entry module.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "attrition") -> SparkSession:
    """A local session with the settings the tests and bench rely on.

    AQE stays on (coalescing and skew-join splitting at runtime); the UI is
    off; session time zone is UTC so day arithmetic matches DuckDB.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in
    ``spark.checkpoint.dir``.

    A session on a local master that names none gets a private one (tests, bench);
    on a cluster that is an error, as executors don't share local disks.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="attrition-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for written tables below the shared folder. They stay until the
    folder is cleared: results are lazy, so no reader is known to be the last."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}"
