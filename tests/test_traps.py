"""Hand-made frames for the places where the obvious Spark form differs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlane.functions.scalar import driver_number_str, fuel_load
from pitlane.operators import features as feat
from pitlane.operators import quality as qual
from pitlane.operators import telemetry as tel
from pitlane.operators.temporal_joins import asof_nearest, assign_intervals, next_start

LAP_SCHEMA = ("Year int, RoundNumber int, Driver string, DriverNumber string, LapNumber int, Stint int, "
              "LapTime double, PitInTime double, PitOutTime double, TrackStatus string, Rainfall boolean, "
              "IsAccurate boolean")


def lap(lapno, t=90.0, stint=1, status="1", rain=False, acc=True, pin=None, pout=None, drv="D1"):
    return (2023, 1, drv, "1", lapno, stint, t, pin, pout, status, rain, acc)


def test_is_accurate_null_is_kept(spark):
    df = spark.createDataFrame([lap(1, acc=None), lap(2, acc=False), lap(3, acc=True)], LAP_SCHEMA)
    assert sorted(r.LapNumber for r in qual.clean_laps(df).collect()) == [1, 3]


def test_null_status_and_rain_are_kept(spark):
    df = spark.createDataFrame([lap(1, status=None, rain=None), lap(2, status="124"), lap(3, rain=True)], LAP_SCHEMA)
    assert [r.LapNumber for r in qual.clean_laps(df).collect()] == [1]


def test_first_matching_rule_wins(spark):
    df = spark.createDataFrame([lap(1, t=None, status="4"), lap(2, t=200.0, pin=1.0), lap(3, status="64")], LAP_SCHEMA)
    got = {r.LapNumber: r.reason for r in qual.removal_reason(df).collect()}
    assert got == {1: "null_time", 2: "slow", 3: "sc"}


def test_nan_lap_time_counts_as_null(spark):
    df = spark.createDataFrame([lap(1, t=float("nan")), lap(2)], LAP_SCHEMA)
    assert [r.LapNumber for r in qual.clean_laps(df).collect()] == [2]


def test_fuel_clip_keeps_null(spark):
    df = spark.createDataFrame([(None, 3), (10, 3), (2, 3)], "race int, lap int")
    got = [r.f for r in df.select(fuel_load(F.col("race"), F.col("lap")).alias("f")).collect()]
    assert got[0] is None and abs(got[1] - 7 * 1.88) < 1e-9 and got[2] == 0.0


def test_null_stint_gets_null_stint_features(spark):
    rows = [lap(1, stint=None), lap(2, stint=1), lap(3, stint=1, t=91.0)]
    df = feat.add_rolling_features(feat.add_fuel_correction(spark.createDataFrame(rows, LAP_SCHEMA)))
    got = {r.LapNumber: r for r in df.collect()}
    assert got[1].lap_time_delta_fuel_corrected is None and got[1].stint_lap_number is None
    assert got[1].deg_rate_last_3 is None
    assert got[2].lap_time_delta_fuel_corrected == 0.0 and got[2].stint_lap_number == 0
    assert got[3].stint_lap_number == 1


def test_stint_reference_is_first_non_null(spark):
    rows = [lap(1, t=None), lap(2, t=90.0), lap(3, t=92.0)]
    df = feat.add_fuel_correction(spark.createDataFrame(rows, LAP_SCHEMA), keep_helpers=True)
    got = {r.LapNumber: r for r in df.collect()}
    assert got[1].stint_lap1_corrected == got[2].lap_time_corrected


def test_share_counts_null_readings_as_no(spark):
    df = spark.createDataFrame([(1, None), (1, 100.0), (1, 50.0), (1, 99.0)], "k int, Throttle double")
    r = df.groupBy("k").agg(tel.share(F.col("Throttle") >= 98).alias("s")).collect()[0]
    assert abs(r.s - 0.5) < 1e-12  # 2 of 4, the null is a "no"


def test_driver_number_through_int(spark):
    df = spark.createDataFrame([(1.0,), (44.0,), (None,)], "d double")
    assert [r.s for r in df.select(driver_number_str("d").alias("s")).collect()] == ["1", "44", None]


def test_asof_nearest_tie_goes_to_earlier(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, None), (2, 5.0)], "g int, t double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b"), (1, 30.0, "c")], "g int, Time double, v string")
    got = {(r.g, r.t): r.v for r in asof_nearest(left, right, ["g"], "t", "Time", ["v"]).collect()}
    # 10 is 2 from both 8 and 12 -> earlier; null time dropped (group has weather);
    # group 2 has no weather -> kept with null
    assert got == {(1, 10.0): "a", (1, 20.0): "b", (2, 5.0): None}


def test_interval_equal_starts_and_last_lap(spark):
    laps = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 100)], "d int, LapNumber int, s bigint")
    lp = next_start(laps, ["d"], "s", "LapNumber", F.lit(180))
    samples = spark.createDataFrame([(1, 0), (1, 99), (1, 100), (1, 279), (1, 280)], "d int, t bigint")
    got = {r.t: r.LapNumber for r in assign_intervals(samples, lp, ["d"], "t", "s", "__end", ["LapNumber"], 60).collect()}
    assert got == {0: 2, 99: 2, 100: 3, 279: 3}


def test_bucketed_asof_crosses_buckets_and_matches_single_level(spark):
    left = spark.createDataFrame(
        [(1, 10.0), (1, 20.0), (1, None), (2, 5.0), (1, 95.0), (1, 250.0), (3, None)], "g int, t double")
    right = spark.createDataFrame(
        [(1, 8.0, "a"), (1, 12.0, "b"), (1, 30.0, "c"), (1, 230.0, "d"), (1, 230.0, "e")], "g int, Time double, v string")
    single = asof_nearest(left, right, ["g"], "t", "Time", ["v"])
    for width in (5.0, 50.0, 1000.0):
        b = asof_nearest(left, right, ["g"], "t", "Time", ["v"], bucket=width)
        assert sorted(map(tuple, b.collect()), key=str) == sorted(map(tuple, single.collect()), key=str)
    got = {(r.g, r.t): r.v for r in single.collect()}
    # 95 -> 30 (65 back) beats 230 (135 ahead); duplicate time 230 keeps the greatest row
    assert got[(1, 95.0)] == "c" and got[(1, 250.0)] == "e" and (3, None) in got


def test_empty_request_is_an_error_row(spark):
    from pitlane.operators.sequences import request_matrix

    df = spark.createDataFrame(
        [(1, []), (2, [(0.0, 30.0)])],
        "id int, laps array<struct<stint_lap_number:double,TrackTemp:double>>")
    got = {r.id: r for r in request_matrix(df, "laps", ["stint_lap_number", "TrackTemp", "AirTemp"]).collect()}
    assert got[1].X is None and got[1].error
    assert got[2].error is None and list(got[2].X[0]) == [0.0, 30.0, 0.0]  # absent feature -> 0.0


def test_explore_limit_above_max_is_an_error(spark):
    import pytest

    from pitlane.operators.metrics import explore

    df = spark.createDataFrame([(1, 0, 0.1, "D1", 1, 2023, 1, 1)],
                               "Stint int, stint_lap_number bigint, lap_time_delta_fuel_corrected double, Driver string, "
                               "LapNumber int, Year int, RoundNumber int, x int")
    with pytest.raises(ValueError):
        explore(df, limit=5001)
    assert explore(df, driver="", compound=None, limit=10).count() == 1  # falsy filters mean no filter
