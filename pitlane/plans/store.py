"""The written feature table that training, scoring and exploring read (S12 -> S3).

The reference builds its feature table once and every later step loads it.
Here the table is written once per application under the shared checkpoint
folder (``spark.checkpoint.dir``), partitioned by race, and read back; that
also cuts the lineage, so the fitted steps downstream (split sizes,
medians, scalers, model fits) do not recompute the joins and windows.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from pitlane.plans.feature_table import feature_table_from_testdata
from pitlane.session import checkpoint_dir
from pitlane.sources import scan


# queries run from several threads may share one session: one writer per table
_WRITE_LOCK = threading.Lock()
_LANDING_LOCK = threading.Lock()
_FIT_LOCK = threading.RLock()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(p))
    except Exception:  # noqa: BLE001 - no JVM gateway: only local paths can be checked
        return os.path.exists(path.removeprefix("file:"))


def _app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", "app")


def _version(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files, so replaced inputs are not served from an old store."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return str(sorted(found))


def store_path(spark: SparkSession, sf_dir: str, name: str = "features") -> str:
    app = _app_id(spark)
    tag = hashlib.sha1(f"{sf_dir.rstrip('/')} {_version(spark, sf_dir)}".encode()).hexdigest()[:10]
    return f"{checkpoint_dir(spark).rstrip('/')}/pitlane-store/{app}/{name}-{tag}"


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of ``sf_dir``, written on first use, then read."""
    path = store_path(spark, sf_dir)
    with _WRITE_LOCK:
        if not _exists(spark, f"{path}/_SUCCESS"):
            scan.write_by_race(feature_table_from_testdata(spark, sf_dir), path, dynamic=False)
    return scan.read_features(spark, path)


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """An ingested table (S10): derived from the testdata once per application,
    written one partition per race, then scanned (S1)."""
    path = store_path(spark, sf_dir, name)
    with _LANDING_LOCK:
        if not _exists(spark, f"{path}/_SUCCESS"):
            scan.write_by_race(build(), path, dynamic=False)
    return spark.read.parquet(path)


def stored_once(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """The folder of something fitted or searched once per application: ``build(path)`` fills it on first use."""
    path = store_path(spark, sf_dir, name)
    with _FIT_LOCK:
        if not _exists(spark, f"{path}/done/_SUCCESS"):
            build(path)
            spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return path


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """``df`` landed bucketed and sorted by ``keys`` under the shared folder, one file a bucket.

    Tables with equal keys and buckets join, deduplicate and aggregate by these keys without an exchange. All keys
    together decide the bucket, so a race with most of all laps spreads over all of them. ``buckets`` is the table's bytes by some 200 MB.
    """
    spark = df.sparkSession
    table = f"pitlane_{name}_{uuid.uuid4().hex[:12]}"
    out = df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    out.option("path", f"{checkpoint_dir(spark).rstrip('/')}/pitlane-buckets/{table}").saveAsTable(table)
    return spark.table(table)
