"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on for correct results (not tuning).
REQUIRED_CONF = {
    # Timestamps parsed from ISO strings and epoch conversions are UTC.
    "spark.sql.session.timeZone": "UTC",
}

# Tuning defaults applied only when the cluster has not set them.
TUNING_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply required settings to an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in TUNING_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir`` (or the SparkContext). A local master
    without one (tests, the bench) gets a fresh scratch folder; any other
    master without one is an error, since executors would each write to
    their own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a session without a local SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        require_local(spark.conf.get("spark.master", "local"))
        configured = tempfile.mkdtemp(prefix="pitlane-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def require_local(master: str) -> None:
    """Raise unless ``master`` runs everything in one JVM."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")


#: For rows of many KB: writers look at their buffers only every hundred rows if not told otherwise, and readers take a row group at once.
BIG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def land(df: DataFrame, name: str, reader: SparkSession | None = None, **options: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back, by ``reader`` if given: later branches share the work, and lineage is cut."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/pitlane-landed/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def row_by_row(spark: SparkSession, limit: int = 8 << 20) -> SparkSession:
    """A session of the same application that hands Python about ``limit`` bytes at a time (one row at least), for rows of many KB."""
    own = prepare(spark.newSession())
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
        if spark.conf.get(k, None) is not None:
            own.conf.set(k, spark.conf.get(k))
    return own


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pitlane") -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.maxMetadataStringLength", "1000")  # plans are read in tests and in PLANS.md
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
