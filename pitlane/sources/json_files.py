"""Landed JSON files with quarantine, session filter and isolated seasons.

``read_documents`` reads a folder of JSON files in one pass: whole-file documents or arrays (an API response a file), or a
document a line. What does not parse, or not as the schema says, does not stop the run: it goes to ``rejected`` with the name of its file, and
everything else goes on. The parsed rows are written once, so the good and the bad side read the files one time only.

A season whose schedule file is missing or broken is a row of a report, not a failure of the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import constants as K
from pitlane.session import land

BAD, FILE = "__rejected", "source_file"


@dataclass
class Documents:
    """Parsed rows (schema columns and ``source_file``) and rejected documents (source_file, document)."""
    rows: DataFrame
    rejected: DataFrame


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False, required: list[str] | None = None,
                   quarantine: str | None = None) -> Documents:
    """All JSON files under ``path``; an absent folder gives no rows.

    ``lines``: one document a line, else one document or array a file. A row without any of the ``required`` columns (all columns, if
    not given) is rejected as well: it is JSON, but another thing. ``quarantine`` names a folder that rejected documents are written to.
    """
    want = _schema(schema)
    wide = T.StructType([*want.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    reader = reader.option("recursiveFileLookup", "true").option("multiLine", str(not lines).lower())
    try:
        raw = reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], wide).withColumn(FILE, F.lit(""))
    else:
        raw = raw.withColumn(FILE, F.col("_metadata.file_path"))
    parsed = land(raw, "json")
    some = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in required or want.names), F.lit(False))
    ok = F.col(BAD).isNull() & some
    own = F.coalesce(F.col(BAD), F.to_json(F.struct(*(F.col(c) for c in want.names))))
    rejected = parsed.where(~ok).select(FILE, own.alias("document"))
    if quarantine:
        rejected.write.mode("append").json(quarantine)
    return Documents(parsed.where(ok).drop(BAD), rejected)


def timed_records(docs: Documents, ts_col: str, order: list[str]) -> DataFrame:
    """Records with a parsed UTC time; rows with none or a bad one are dropped, sorted within partitions."""
    return (
        docs.rows.withColumn(ts_col, F.try_to_timestamp(F.col(ts_col).cast("string")))
        .where(F.col(ts_col).isNotNull())
        .sortWithinPartitions(*order)
    )


API_LAP = "session_key int, driver_number int, lap_number int, date_start string"
API_CAR = "session_key int, driver_number int, date string, throttle double, brake double, speed double, drs int, rpm double"
API_SESSION = "session_key int, year int, session_name string, circuit_short_name string"
SCHEDULE = "Year int, RoundNumber int, EventName string, EventFormat string, Country string, Location string, OfficialEventName string"


def race_sessions(sessions: DataFrame, years: list[int] | None = None, session_name: str = "Race") -> DataFrame:
    """Sessions of this name (and these years): session_key, year, circuit (its short name, else "unknown")."""
    out = sessions.where(F.col("session_name") == session_name)
    if years is not None:
        out = out.where(F.col("year").isin(years))
    return out.groupBy("session_key").agg(F.min("year").alias("year"), F.min("circuit_short_name").alias("circuit")).withColumn(
        "circuit", F.coalesce("circuit", F.lit("unknown")))


def of_sessions(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """The records of these sessions only, before anything is joined or aggregated."""
    return records.join(sessions.select("session_key"), "session_key", "left_semi")


def season_schedules(spark: SparkSession, path: str, seasons: list[int], quarantine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedule rows of readable seasons, report).

    ``path`` holds a folder ``season=Y`` for each season. The report has a row for every wanted season: its status ("ok",
    "unreadable" if any file of it is broken, "missing" without a file) and its number of race weekends (P3's formats).
    """
    docs = read_documents(spark, path, SCHEDULE, required=["RoundNumber"], quarantine=quarantine)
    season = F.regexp_extract(FILE, r"season=(\d+)", 1).cast("int")
    wanted = spark.createDataFrame([(y,) for y in seasons], "season int").distinct()
    broken = docs.rejected.select(season.alias("season")).distinct().withColumn("broken", F.lit(True))
    good = docs.rows.withColumn("season", season).join(broken, "season", "left_anti").join(wanted, "season", "left_semi")
    races = good.groupBy("season").agg(F.count_if(F.col("EventFormat").isin(K.KEPT_EVENT_FORMATS)).alias("n_races"))
    report = wanted.join(broken, "season", "left").join(races, "season", "left").select(
        "season", F.when(F.col("broken"), "unreadable").when(F.col("n_races").isNull(), "missing").otherwise("ok").alias("status"),
        F.coalesce("n_races", F.lit(0)).cast("long").alias("n_races"))
    return good.drop(FILE, "season"), report


def write_arrays(df: DataFrame, path: str, by: list[str], name: str | None = None) -> None:
    """One JSON array of the rows of each ``by`` group: with ``name`` a file each, in folders ``name=value`` of the first group
    column (as an API's responses are landed), else a line each."""
    items = df.groupBy(*by).agg(F.collect_list(F.struct(*df.columns)).alias("items"))
    text = F.to_json("items", {"ignoreNullFields": "false"}).alias("value")
    if name is None:
        items.select(text).write.text(path)
    else:
        items.select(F.col(by[0]).alias(name), text).write.option("maxRecordsPerFile", 1).partitionBy(name).text(path)
