"""Fuel correction, stint target and rolling features.

All per-stint columns use one window spec ``ws`` (partition Year,
RoundNumber, Driver, Stint; order LapNumber) so they share one sort and one
exchange on the stint. The race-level columns (A3, W5) are small aggregates
joined back, so a race with a large share of all laps spreads over many tasks.

Null group keys: pandas drops rows with a null key from its groups, so
such laps get null stint results. Spark would put them in one null group;
every stint column is wrapped in ``when(keys not null, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.functions.scalar import corrected_time, fuel_load

HELPER_COLS = ["race_total_laps", "start_fuel_kg", "stint_lap1_corrected", "fuel_time_effect_s"]


BROADCAST_RACES = 500_000  # one row a race; more are joined by shuffle


def _join_races(df: DataFrame, races: DataFrame) -> DataFrame:
    """Race-level columns on every lap; the race table is counted before it is broadcast."""
    few = races.count() <= BROADCAST_RACES
    renamed = races.withColumnsRenamed({k: f"__r_{k}" for k in K.RACE_KEYS})
    cond = F.lit(True)
    for k in K.RACE_KEYS:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(F.broadcast(renamed) if few else renamed, cond, "left").drop(*(f"__r_{k}" for k in K.RACE_KEYS))


def stint_window() -> Window:
    return Window.partitionBy(*K.STINT_KEYS).orderBy(F.col("LapNumber").asc_nulls_last())


def keys_present(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def add_fuel_correction(
    df: DataFrame,
    burn: float = K.FUEL_BURN_RATE_KG_PER_LAP,
    effect: float = K.FUEL_TIME_EFFECT_S_PER_KG,
    fuel_sign: int = 1,
    keep_helpers: bool = False,
) -> DataFrame:
    """A3 + F1 + F2 + W1 + W2.

    race_total_laps = max LapNumber of the (cleaned) race, a partial aggregate
    joined back, so a race is never one task; fuel load and corrected time; the stint reference is the first non-null corrected time
    of the stint; target = corrected - reference; stint_lap_number counts
    laps of the stint from 0.
    """
    ws = stint_window()
    ws_all = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stint_ok = keys_present(K.STINT_KEYS)
    races = df.groupBy(*K.RACE_KEYS).agg(F.max("LapNumber").alias("__race_laps"))
    race_laps = F.col("__race_laps")
    fuel = fuel_load(race_laps, F.col("LapNumber"), burn)
    # stage 1: race length and the per-lap arithmetic on it
    out = _join_races(df, races).withColumns({
        "race_total_laps": race_laps,
        "start_fuel_kg": race_laps * F.lit(burn),
        "fuel_load_kg": fuel,
        "fuel_time_effect_s": fuel * F.lit(effect),
        "lap_time_corrected": corrected_time(F.col("LapTime"), fuel, effect, fuel_sign),
    }).drop("__race_laps")
    # stage 2: the stint windows (one sort on ws)
    lap1 = F.when(stint_ok, F.first("lap_time_corrected", ignorenulls=True).over(ws_all))
    out = out.withColumns({
        "stint_lap1_corrected": lap1,
        K.TARGET: F.col("lap_time_corrected") - lap1,
        "stint_lap_number": F.when(stint_ok, (F.row_number().over(ws) - 1).cast("bigint")),
    })
    return out if keep_helpers else out.drop(*HELPER_COLS)


def add_rolling_features(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """W3 + W4: mean of the target over the current and two previous laps of the
    stint (nulls skipped), and its first difference."""
    ws = stint_window()
    stint_ok = keys_present(K.STINT_KEYS)
    rate = F.avg(target).over(ws.rowsBetween(-2, Window.currentRow))
    return (
        df.withColumn("deg_rate_last_3", F.when(stint_ok, rate))
        .withColumn("deg_acceleration", F.when(stint_ok, F.col("deg_rate_last_3") - F.lag("deg_rate_last_3").over(ws)))
    )


def add_track_evolution(df: DataFrame) -> DataFrame:
    """Running count of laps in the race ordered by (LapNumber, Driver), from 1.

    Laps are counted per (race, LapNumber); offsets run over those counts, and the driver ranks
    laps inside one lap number. No window holds a race's rows.
    """
    keys = [*K.RACE_KEYS, "LapNumber"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*K.RACE_KEYS).orderBy(F.col("LapNumber").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("Driver").asc_nulls_last()))
    out = df.join(offsets, cond, "left").withColumn("track_evolution", (F.col("__off") + inside).cast("bigint"))
    return out.drop("__off", *(f"__r_{k}" for k in keys))


def add_causal_rolling(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """The rolling features as scoring sees them, from earlier laps only.

    rate = mean of the previous three targets; acceleration = rate - mean of
    the targets 4..2 laps back when at least two laps precede, else rate - 0;
    at the first lap of a stint both are 0.
    """
    ws = stint_window()
    stint_ok = keys_present(K.STINT_KEYS)
    pos = F.row_number().over(ws) - 1
    rate = F.avg(target).over(ws.rowsBetween(-3, -1))
    prev = F.avg(target).over(ws.rowsBetween(-4, -2))
    rate_c = F.when(pos == 0, F.lit(0.0)).otherwise(rate)
    acc_c = F.when(pos == 0, F.lit(0.0)).when(pos >= 2, rate - prev).otherwise(rate)
    return df.withColumns({
        "deg_rate_prev_3": F.when(stint_ok, rate_c),
        "deg_acceleration_prev": F.when(stint_ok, acc_c),
    })
