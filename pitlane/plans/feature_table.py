"""The lap feature table (L-1): one lazy plan from the raw tables to the features.

laps --(J2 nearest weather)--> --(Q1 clean)--> --(J1 telemetry per lap)-->
--(A3/F1/F2/W1/W2 fuel + stint target)--> --(W3/W4 rolling)--> --(W5)-->
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitlane import constants as K
from pitlane.functions.scalar import nan_to_null
from pitlane.operators.features import (
    HELPER_COLS,
    add_fuel_correction,
    add_rolling_features,
    add_track_evolution,
)
from pitlane.operators.quality import LAP_RULES, WEATHER_RULES, clean_laps
from pitlane.operators.telemetry import assign_samples_to_laps, join_telemetry, telemetry_per_lap
from pitlane.operators.temporal_joins import asof_nearest
from pitlane.session import land
from pitlane.sources import fixtures as fx

WEATHER_COLS = ["AirTemp", "TrackTemp", "Rainfall", "WindSpeed"]


WEATHER_BUCKET_S = 600.0  # as-of work split into 10-minute slices of session time


def attach_weather(laps: DataFrame, weather: DataFrame | None, bucket: float | None = WEATHER_BUCKET_S) -> DataFrame:
    """J2 as done at ingest: nearest weather row by session time, per race,
    computed per 10-minute slice of the race (exact; see ``asof_nearest``).

    Weather columns the laps already carry are not replaced.
    """
    if weather is None or not weather.columns:
        return laps
    cols = [c for c in WEATHER_COLS if c in weather.columns and c not in laps.columns]
    return asof_nearest(laps, weather, K.RACE_KEYS, "LapStartTime", "Time", cols, bucket=bucket)


def lap_telemetry(laps: DataFrame, samples: DataFrame | None, keys: list[str] | None = None) -> DataFrame | None:
    """A1 over J3: per-lap telemetry of every lap of the session (grouped by
    ``keys``; the lap join keys by default, one row per lap)."""
    if samples is None or not samples.columns:
        return None
    keys = keys or K.LAP_JOIN_KEYS
    return telemetry_per_lap(assign_samples_to_laps(samples, laps, lap_cols=[k for k in keys if k not in (
        "Year", "RoundNumber", "DriverNumber")]), keys=keys)


def build_feature_table(
    laps: DataFrame,
    weather: DataFrame | None = None,
    samples: DataFrame | None = None,
    telemetry: DataFrame | None = None,
    fuel_sign: int = 1,
) -> DataFrame:
    laps, weather, samples = (nan_to_null(x) if x is not None and x.columns else x for x in (laps, weather, samples))
    own = telemetry is None
    tel = telemetry if not own else lap_telemetry(laps, samples)
    # lap-only cleaning rules before the weather join (less data into its
    # shuffle; pushed into the scan when laps are read from files), the
    # weather rule after it; the rules are independent row filters
    df = attach_weather(clean_laps(laps, LAP_RULES), weather)
    df = clean_laps(df, WEATHER_RULES)
    # written once: the race-level aggregates below and the join back share it
    df = land(join_telemetry(df, tel, unique_keys=own), "joined-laps")
    df = add_fuel_correction(df, fuel_sign=fuel_sign)
    df = add_rolling_features(df)
    df = add_track_evolution(df)
    return df.drop(*HELPER_COLS)


def feature_table_from_testdata(spark: SparkSession, sf_dir: str, with_samples: bool = True) -> DataFrame:
    """Ingest (laps and weather landed per race, once per application), then
    the feature build over the landed files: the lap scan takes the
    cleaning predicates, and the car samples are generated from the landed
    laps without another window. Callers that use no telemetry column leave them out."""
    from pitlane.plans.store import landed

    lp = landed(spark, sf_dir, "laps", lambda: fx.laps(spark, sf_dir))
    wx = landed(spark, sf_dir, "weather", lambda: fx.weather(spark, sf_dir))
    return build_feature_table(lp, wx, fx.samples(spark, sf_dir, lp) if with_samples else None)
