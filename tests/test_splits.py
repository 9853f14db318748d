"""E1 fallbacks on hand-made tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlane.operators import encode as enc

SCHEMA = "Year int, RoundNumber int, LapNumber int, Driver string, v double"


def counts(df):
    return {r.split: r["count"] for r in df.groupBy("split").count().collect()}


def test_one_race_smoke_split_falls_back_to_rows(spark):
    rows = [(2023, 1, lap, f"D{d}", 1.0) for lap in range(1, 6) for d in range(2)]  # 10 rows, 1 race
    out = enc.temporal_split(spark.createDataFrame(rows, SCHEMA), smoke_test=True)
    assert counts(out) == {"train": 6, "val": 2, "test": 2}
    # the row order is (Year, RoundNumber, LapNumber, Driver): the last laps are test
    assert {r.LapNumber for r in out.where(F.col("split") == "test").collect()} == {5}


def test_five_races_split_by_race(spark):
    rows = [(2023, r, 1, "D1", 1.0) for r in range(1, 6)]
    out = enc.temporal_split(spark.createDataFrame(rows, SCHEMA), smoke_test=True)
    got = {r.RoundNumber: r.split for r in out.collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "val", 5: "test"}


def test_empty_test_takes_last_30_percent_of_val(spark):
    rows = [(2024, 1, 1, "D1", 1.0)] + [(2025, 2, lap, "D1", 1.0) for lap in range(1, 11)]
    out = enc.temporal_split(spark.createDataFrame(rows, SCHEMA))
    assert counts(out) == {"train": 1, "val": 7, "test": 3}
    assert {r.LapNumber for r in out.where(F.col("split") == "test").collect()} == {8, 9, 10}


def test_global_row_index_is_a_permutation(spark):
    rows = [(2023, r, lap, f"D{d}", 0.0) for r in (2, 1) for lap in (3, 1, 2) for d in (1, 0)]
    idx = enc.global_row_index(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["__idx"], r.RoundNumber, r.LapNumber, r.Driver) for r in idx.collect())
    assert [g[0] for g in got] == list(range(12))
    assert got[0][1:] == (1, 1, "D0") and got[-1][1:] == (2, 3, "D1")
