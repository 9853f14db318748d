"""Lap, weather and telemetry tables derived from the ``events`` table.

The mapping is the one written down in FIXTURES.md part B: every day of
events is a race, ``user_id % 10`` is the driver, and each event is one lap.
Everything here is lazy DataFrame code over the parquet scan, so the work
grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.session import prepare

STINT_LEN = 12
LAST_LAP_SPAN_US = 240_000_000  # samples of a driver's last lap spread over 240 s
SAMPLES_MAX = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    d = F.dayofmonth("ts")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        epoch_micros("ts").alias("us"), "ts", d.alias("d"),
        F.when(d <= 8, 2023).when(d <= 14, 2024).otherwise(2025).alias("Year"),
        F.when(d <= 8, d).when(d <= 14, d - 8).otherwise(d - 14).alias("RoundNumber"),
    )


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lap (FIXTURES view ``laps``)."""
    b = base(spark, sf_dir).withColumns({
        "drv": F.col("user_id") % 10,
        "DriverNumber": (F.col("user_id") % 10).cast("string"),
    })
    # partitioned by the (race, driver) keys the lap consumers use, so the
    # driver-level windows downstream need no further exchange
    ln_w = Window.partitionBy("Year", "RoundNumber", "DriverNumber").orderBy("us", "event_id")
    c = b.withColumns({"ln": F.row_number().over(ln_w), "next_us": F.lead("us").over(ln_w)})
    eid = F.col("event_id")
    ln = F.col("ln")
    stint0 = F.floor((ln - 1) / STINT_LEN)
    lap_in_stint = (ln - 1) % STINT_LEN
    dbl = lambda v: F.lit(v).cast("double")
    compound = (
        F.when(((stint0.cast("int") + F.col("user_id")) % 4) == 0, "SOFT")
        .when(((stint0.cast("int") + F.col("user_id")) % 4) == 1, "MEDIUM")
        .when(((stint0.cast("int") + F.col("user_id")) % 4) == 2, "HARD")
        .otherwise(F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).otherwise("INTERMEDIATE"))
    )
    track_status = (
        F.when(eid % 41 == 0, "14").when(eid % 43 == 0, "6").when(eid % 29 == 0, "12")
        .when(eid % 31 == 0, F.lit(None).cast("string")).otherwise("1")
    )
    return c.select(
        "event_id",
        F.col("Year").cast("int").alias("Year"),
        F.col("RoundNumber").cast("int").alias("RoundNumber"),
        F.concat(F.lit("GP"), F.col("RoundNumber").cast("string")).alias("EventName"),
        F.concat(F.lit("D"), F.col("drv").cast("string")).alias("Driver"),
        "DriverNumber",
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("Team"),
        ln.cast("int").alias("LapNumber"),
        F.when(eid % 97 == 0, F.lit(None).cast("int")).otherwise((stint0 + 1).cast("int")).alias("Stint"),
        (lap_in_stint + 1).cast("int").alias("TyreLife"),
        F.when(eid % 37 == 0, F.lit(None).cast("double")).otherwise(dbl(80) + F.col("value") / 4).alias("LapTime"),
        F.when(eid % 67 == 0, F.lit(None).cast("double")).otherwise(dbl(25) + F.col("value") / 16).alias("Sector1Time"),
        (dbl(30) + F.col("value") / 8).alias("Sector2Time"),
        (dbl(25) + F.col("value") / 16).alias("Sector3Time"),
        compound.alias("Compound"),
        track_status.alias("TrackStatus"),
        F.when(eid % 71 == 0, F.lit(None).cast("double"))
        .otherwise((F.col("us") % 86_400_000_000).cast("double") / dbl(1_000_000)).alias("LapStartTime"),
        F.col("us").alias("lap_start_us"),
        F.col("next_us").alias("next_lap_start_us"),
        F.when(lap_in_stint == STINT_LEN - 1, dbl(1)).alias("PitInTime"),
        F.when((lap_in_stint == 0) & (ln > 1), dbl(1)).alias("PitOutTime"),
        F.when(eid % 53 == 0, F.lit(True)).when(eid % 59 == 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False)).alias("Rainfall"),
        F.when(eid % 23 == 0, F.lit(False)).when(eid % 61 == 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias("IsAccurate"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session weather rows (FIXTURES view ``weather``)."""
    b = base(spark, sf_dir).where(F.col("event_id") % 10 == 3)
    return b.select(
        F.col("Year").cast("int").alias("Year"),
        F.col("RoundNumber").cast("int").alias("RoundNumber"),
        ((F.col("us") % 86_400_000_000).cast("double") / F.lit(1_000_000.0)).alias("Time"),
        (F.lit(20.0) + (F.col("event_id") % 100).cast("double") / 10).alias("AirTemp"),
        (F.lit(30.0) + (F.col("event_id") % 200).cast("double") / 10).alias("TrackTemp"),
        (F.col("event_id") % 53 == 0).alias("Rainfall"),
        ((F.col("event_id") % 7).cast("double") / 2).alias("WindSpeed"),
    )


def samples(spark: SparkSession, sf_dir: str, lap_df: DataFrame | None = None) -> DataFrame:
    """Car samples by time (FIXTURES view ``samples``).

    Each lap emits ``4 + event_id % 5`` samples spread over the gap to the
    driver's next lap (240 s for the last). Generated per lap with
    ``explode(sequence)`` - no join.
    """
    lp = lap_df if lap_df is not None else laps(spark, sf_dir)
    n = lp.select(
        "Year", "RoundNumber", "DriverNumber", "event_id",
        F.col("lap_start_us").alias("us0"),
        F.col("next_lap_start_us").alias("us1"),
    ).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3) + F.col("event_id") % 5)))
    eid, i = F.col("event_id"), F.col("i")
    span = F.coalesce(F.col("us1") - F.col("us0"), F.lit(LAST_LAP_SPAN_US).cast("bigint"))
    return n.select(
        "Year", "RoundNumber", "DriverNumber",
        (F.col("us0") + F.floor(span * i / SAMPLES_MAX).cast("bigint")).alias("t_us"),
        (F.lit(100) + (eid * 7 + i * 31) % 220).cast("double").alias("Speed"),
        F.when((eid + i) % 19 == 0, F.lit(None).cast("double"))
        .otherwise(((eid * 13 + i * 17) % 101).cast("double")).alias("Throttle"),
        F.when((eid + i) % 5 == 0, 100).otherwise(0).cast("double").alias("Brake"),
        ((eid + i) % 15).cast("int").alias("DRS"),
        (F.lit(9000) + (eid * 11 + i * 97) % 3500).cast("double").alias("RPM"),
        (F.lit(1) + (eid + i) % 8).cast("int").alias("nGear"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event schedule (FIXTURES A3) derived from the races present in ``events``.

    EventFormat cycles through a testing day and the three race formats;
    OfficialEventName is absent for every third round.
    """
    b = base(spark, sf_dir)
    r = b.groupBy(F.col("Year").cast("int").alias("Year"), F.col("RoundNumber").cast("int").alias("RoundNumber")).agg(
        F.count("*").alias("n_events")
    )
    rn = F.col("RoundNumber")
    fmt = (
        F.when(rn % 5 == 0, "testing").when(rn % 5 == 1, "sprint")
        .when(rn % 5 == 2, "sprint_qualifying").otherwise("conventional")
    )
    return r.select(
        "Year", "RoundNumber",
        F.concat(F.lit("GP"), rn.cast("string")).alias("EventName"),
        fmt.alias("EventFormat"),
        F.concat(F.lit("C"), (rn % 7).cast("string")).alias("Country"),
        F.concat(F.lit("L"), rn.cast("string")).alias("Location"),
        F.when(rn % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Official GP"), rn.cast("string"))).alias("OfficialEventName"),
    )


def api_laps(spark: SparkSession, sf_dir: str, lap_df: DataFrame | None = None) -> DataFrame:
    """Timestamped lap starts as the timing API gives them (FIXTURES A6)."""
    lp = lap_df if lap_df is not None else laps(spark, sf_dir)
    return lp.select(
        (F.col("Year") * 100 + F.col("RoundNumber")).alias("session_key"),
        F.col("Year").alias("year"),
        F.col("DriverNumber").cast("int").alias("driver_number"),
        F.col("LapNumber").alias("lap_number"),
        F.timestamp_micros("lap_start_us").alias("date_start"),
    )


def api_car(spark: SparkSession, sf_dir: str, sample_df: DataFrame | None = None) -> DataFrame:
    """Timestamped car samples (FIXTURES A6) with lower-case API names."""
    s = sample_df if sample_df is not None else samples(spark, sf_dir)
    return s.select(
        (F.col("Year") * 100 + F.col("RoundNumber")).alias("session_key"),
        F.col("DriverNumber").cast("int").alias("driver_number"),
        F.timestamp_micros("t_us").alias("date"),
        F.col("Throttle").alias("throttle"), F.col("Brake").alias("brake"),
        F.col("Speed").alias("speed"), F.col("DRS").alias("drs"), F.col("RPM").alias("rpm"),
    )
