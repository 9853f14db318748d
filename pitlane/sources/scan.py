"""Sources and sinks: lap/telemetry/feature scans, per-race writes, incremental targets.

Per-race files become one Parquet dataset partitioned by (Year,
RoundNumber), so a race filter prunes partitions and the column list
reaches the reader as ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import constants as K
from pitlane.functions.scalar import existing, nan_to_null

RACE_PARTITIONS = ["Year", "RoundNumber"]


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.parquet(*paths)


def _missing(e: AnalysisException) -> bool:
    msg = str(e)
    return "PATH_NOT_FOUND" in msg or "Path does not exist" in msg or "UNABLE_TO_INFER_SCHEMA" in msg


def read_laps(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
              clean: tuple[str, ...] | bool = False) -> DataFrame:
    """All lap files under ``path``, stacked by name (mergeSchema), NaN -> NULL.

    ``clean`` (True, or a tuple of rule names) applies the lap cleaning rules
    on the raw columns first, so their null and bound tests are pushed into
    the Parquet reader; NaN is normalised after the filter. Raises
    FileNotFoundError when there is no file.
    """
    try:
        df = _read(spark, path, schema)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no lap files at {path}") from e
        raise
    if clean:
        from pitlane.operators.quality import clean_laps
        df = clean_laps(df, None if clean is True else tuple(clean))
    return nan_to_null(df)


def read_telemetry(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame | None:
    """Telemetry files; ``None`` when there are none or no file holds a row (the build goes on without)."""
    try:
        df = nan_to_null(_read(spark, path, schema))
        return None if df.isEmpty() else df
    except AnalysisException as e:
        if _missing(e):
            return None
        raise


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """S3: the feature table; error when absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"feature table not found at {path}") from e
        raise


def explorer_scan(df: DataFrame) -> DataFrame:
    """Only the explorer columns (pruned at the reader)."""
    return df.select(*existing(df, K.EXPLORER_COLS))


def race_scan(df: DataFrame, year: int, round_number: int) -> DataFrame:
    """One race, by partition columns (partition pruning)."""
    return df.where((F.col("Year") == year) & (F.col("RoundNumber") == round_number))


def keep_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """P1."""
    return df.select(*existing(df, cols))


def nan_to_null_all(df: DataFrame) -> DataFrame:
    return nan_to_null(df)


def stack_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union-all by column name; a column missing in a frame becomes null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schedule_races(schedule: DataFrame, rounds: list[int] | None = None,
                   formats: list[str] | None = None) -> DataFrame:
    """P3 + P4: keep race formats (and, if given, rounds); circuit short name =
    OfficialEventName, else EventName, else ""."""
    out = schedule.where(F.col("EventFormat").isin(formats or K.KEPT_EVENT_FORMATS))
    if rounds:
        out = out.where(F.col("RoundNumber").isin(rounds))
    return out.withColumn(
        "CircuitShortName", F.coalesce(F.col("OfficialEventName"), F.col("EventName"), F.lit(""))
    )


def write_by_race(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = True) -> None:
    """One Parquet partition per race; with ``dynamic`` an overwrite
    replaces only the races present in ``df`` (a writer option, the session
    setting is left alone)."""
    w = df.write.mode(mode).partitionBy(*RACE_PARTITIONS)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def written_races(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (Year, RoundNumber) already written; empty when nothing is."""
    try:
        return spark.read.parquet(path).select(*RACE_PARTITIONS).distinct()
    except AnalysisException as e:
        if _missing(e):
            return spark.createDataFrame([], "Year int, RoundNumber int")
        raise


def incremental_targets(wanted: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The wanted sessions whose output does not exist yet."""
    return wanted.join(done, keys or RACE_PARTITIONS, "left_anti")


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, ts_col: str,
                      order: list[str], quarantine: str | None = None, lines: bool = False) -> DataFrame:
    """JSON arrays of records, one a file or (``lines``) one a line -> table; timestamp parsed (UTC), bad -> null,
    rows without a time dropped, sorted within partitions by ``order``. Broken files are left out (see ``json_files``)."""
    from pitlane.sources.json_files import read_documents, timed_records

    docs = read_documents(spark, path, schema, lines, quarantine=quarantine)
    return timed_records(docs, ts_col, order).drop("source_file")


FILE_ORDER = ["__file", "__row"]


def with_file_order(df: DataFrame) -> DataFrame:
    """A Parquet scan with its file and the row's place in it (``FILE_ORDER``), for "first in file order" (D1, J2)."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
