"""Telemetry per lap (A1, A2, P8), dedup (D1), the lap join (J1) and fill rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.functions.scalar import driver_number_str
from pitlane.operators.temporal_joins import assign_intervals, next_start
from pitlane.sources.scan import FILE_ORDER

LAP_KEYS = ["Year", "RoundNumber", "EventName", "Driver", "DriverNumber", "LapNumber", "Stint", "Compound"]
BUCKET_US = 3_600_000_000  # one-hour time buckets for the interval join


def share(cond: Column) -> Column:
    """Fraction of samples meeting ``cond``; a null reading counts as "no" in the
    denominator (pandas ``(s >= x).mean()``), unlike ``avg(cast(cond))``."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def lap_telemetry_aggs(cols: set[str], drs_open_min: int = K.DRS_OPEN_MIN) -> list[Column]:
    """A1 aggregate list; each only if its source column exists."""
    aggs: list[Column] = []
    if "Speed" in cols:
        aggs += [F.avg("Speed").alias("avg_speed_kph"), F.max("Speed").alias("max_speed_kph")]
    if "Throttle" in cols:
        aggs += [F.avg("Throttle").alias("avg_throttle_pct"),
                 share(F.col("Throttle") >= K.FULL_THROTTLE_PCT).alias("full_throttle_pct")]
    if "Brake" in cols:
        brake = F.col("Brake").cast("double")
        aggs += [F.avg(brake).alias("avg_brake"), share(brake > 0).alias("braking_pct")]
    if "DRS" in cols:
        aggs += [share(F.col("DRS") >= drs_open_min).alias("drs_active_pct")]
    if "RPM" in cols:
        aggs += [F.avg("RPM").alias("avg_rpm")]
    if "nGear" in cols:
        aggs += [F.avg("nGear").alias("avg_gear")]
    return aggs


def assign_samples_to_laps(
    samples: DataFrame,
    laps: DataFrame,
    by: tuple[str, ...] = ("Year", "RoundNumber", "DriverNumber"),
    sample_t: str = "t_us",
    lap_start: str = "lap_start_us",
    lap_cols: list[str] | None = None,
    last_span_us: int = K.LAST_LAP_SECONDS * 1_000_000,
) -> DataFrame:
    """J3 + W6 on epoch microseconds: each sample gets the lap it falls in."""
    by = list(by)
    cols = lap_cols if lap_cols is not None else [c for c in LAP_KEYS if c in laps.columns and c not in by]
    lp = next_start(laps.where(F.col(lap_start).isNotNull()), by, lap_start, "LapNumber", F.lit(last_span_us))
    return assign_intervals(samples, lp, by, sample_t, lap_start, "__end", cols, BUCKET_US)


def telemetry_per_lap(assigned: DataFrame, keys: list[str] | None = None,
                      min_samples: int = K.MIN_SAMPLES_PER_LAP) -> DataFrame:
    """A1 + P8: per-lap telemetry aggregates; laps with fewer samples are dropped.

    ``groupBy`` plans a partial (map-side) aggregate, so a hot lap key is
    combined before the shuffle.
    """
    keys = keys or [c for c in LAP_KEYS if c in assigned.columns]
    aggs = lap_telemetry_aggs(set(assigned.columns))
    return (
        assigned.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), *aggs)
        .where(F.col("__n") >= min_samples)
        .drop("__n")
    )


def api_telemetry_per_lap(
    car: DataFrame,
    api_laps: DataFrame,
    sessions: DataFrame | None = None,
    min_samples: int = K.MIN_SAMPLES_PER_LAP,
) -> DataFrame:
    """A2: timing-API samples assigned per driver to [date_start, next start)
    (last lap: + 3 min), then aggregated; session key, year and circuit added
    (circuit defaults to "unknown")."""
    laps = (
        api_laps.where(F.col("date_start").isNotNull())
        .withColumn("__s", F.unix_micros("date_start"))
    )
    samples = car.where(F.col("date").isNotNull()).withColumn("__t", F.unix_micros("date"))
    by = ["session_key", "driver_number"]
    lp = next_start(laps, by, "__s", "lap_number", F.lit(K.LAST_LAP_SECONDS * 1_000_000))
    assigned = assign_intervals(samples, lp, by, "__t", "__s", "__end", ["lap_number"], BUCKET_US)
    have = set(assigned.columns)
    aggs = [
        F.avg("throttle").alias("avg_throttle_pct") if "throttle" in have else F.lit(None).cast("double").alias("avg_throttle_pct"),
        F.avg(F.col("brake").cast("double")).alias("avg_brake") if "brake" in have else F.lit(None).cast("double").alias("avg_brake"),
        F.max("speed").alias("max_speed_kph") if "speed" in have else F.lit(None).cast("double").alias("max_speed_kph"),
        share(F.col("drs") > K.API_DRS_OPEN_ABOVE).alias("drs_laps_pct") if "drs" in have else F.lit(None).cast("double").alias("drs_laps_pct"),
        F.avg("rpm").alias("avg_rpm") if "rpm" in have else F.lit(None).cast("double").alias("avg_rpm"),
    ]
    per_lap = (
        assigned.groupBy("session_key", "driver_number", "lap_number")
        .agg(F.count(F.lit(1)).alias("n_telemetry_samples"), *aggs)
        .where(F.col("n_telemetry_samples") >= min_samples)
    )
    if sessions is None:
        sessions = api_laps.groupBy("session_key").agg(F.first("year", ignorenulls=True).alias("year")) \
            .withColumn("circuit", F.lit(None).cast("string"))
    sess = sessions.select("session_key", "year", F.coalesce(F.col("circuit"), F.lit("unknown")).alias("circuit"))
    return per_lap.join(sess, "session_key", "left")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by an explicit order (``dropDuplicates`` would keep an arbitrary one).
    "The first row of the first file" is the order ``scan.FILE_ORDER`` of a ``scan.with_file_order`` scan."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def normalise_keys(df: DataFrame) -> DataFrame:
    """P5: Year, RoundNumber, LapNumber as int; DriverNumber as string (through int)."""
    out = {c: F.col(c).cast("int") for c in ("Year", "RoundNumber", "LapNumber") if c in df.columns}
    if "DriverNumber" in df.columns:
        numeric = isinstance(df.schema["DriverNumber"].dataType, T.NumericType)
        out["DriverNumber"] = driver_number_str("DriverNumber", numeric)
    return df.withColumns(out)


def join_telemetry(laps: DataFrame, telemetry: DataFrame | None,
                   order: list[Column | str] | None = None, unique_keys: bool = False, normalised: bool = False) -> DataFrame:
    """Laps left-join per-lap telemetry on the lap keys.

    No telemetry source (``None`` or a frame without columns) returns the
    laps unchanged, without telemetry columns. The right side is reduced to
    the keys + telemetry columns and deduplicated first (D1). Null keys never
    match. Join strategy is left to Catalyst/AQE (broadcast when the
    measured side is small, sort-merge otherwise). ``unique_keys`` skips the
    dedup window when the right side is known to be one row per lap. ``normalised`` says that both
    sides hold the keys in their final types already (as tables bucketed by them must, to join without an exchange).
    """
    if telemetry is None or not telemetry.columns:
        return laps
    laps_n, tel_n = (laps, telemetry) if normalised else (normalise_keys(laps), normalise_keys(telemetry))
    tel_cols = K.LAP_JOIN_KEYS + [c for c in K.TELEMETRY_COLS if c in tel_n.columns and c not in laps_n.columns]
    placed = [c for c in FILE_ORDER if c in tel_n.columns]
    # default order: the place in the files if the scan has it, else the value columns (deterministic as well)
    value_cols = placed or [c for c in tel_cols if c not in K.LAP_JOIN_KEYS]
    tel = tel_n.select(*tel_cols, *placed)
    if not unique_keys:  # the per-lap aggregate of this library is already unique per key
        tel = dedup_first(tel, K.LAP_JOIN_KEYS,
                          order or [F.col(c).asc_nulls_last() for c in value_cols] or [F.lit(1)])
    tel = tel.drop(*placed)
    return laps_n.join(tel, K.LAP_JOIN_KEYS, "left")


def fill_rate(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Share of non-null values of the first telemetry column present."""
    cand = cols or K.TELEMETRY_COLS
    first = next((c for c in cand if c in df.columns), None)
    if first is None:
        return df.sparkSession.createDataFrame([], "column string, fill_rate double, n bigint")
    return df.agg(
        F.lit(first).alias("column"),
        F.avg(F.col(first).isNotNull().cast("double")).alias("fill_rate"),
        F.count(F.lit(1)).alias("n"),
    )
