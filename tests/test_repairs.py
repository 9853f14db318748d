"""Results that were once wrong, and methods that must not depend on size."""

from __future__ import annotations

import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_compare import SF_SMALL
from pitlane import constants as K
from pitlane.functions import scalar as S
from pitlane.operators import encode as enc
from pitlane.operators import features as feat
from pitlane.operators import metrics as M
from pitlane.operators import quality as qual
from pitlane.operators import telemetry as tel
from pitlane.operators.quantiles import exact_quantiles
from pitlane.operators.temporal_joins import asof_nearest, next_start
from pitlane.plans import models as ML
from pitlane.plans import store
from pitlane.session import checkpoint_dir, require_local


def scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 60_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.4, np.round(rng.normal(0, 3, n)), rng.lognormal(2, 3, n))
    df = spark.createDataFrame([(("a", "b", None)[i % 3], float(v), float(v) if i % 5 else None) for i, v in enumerate(x)], "g string, x double, y double")
    for by in (None, "g"):
        for r in exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.999, 1.0], by).collect():
            mine = [float(v) for i, v in enumerate(x) if (by is None or ("a", "b", None)[i % 3] == r["group"]) and (r["name"] == "x" or i % 5)]
            assert r["n"] == len(mine) and np.allclose(r["q"], np.quantile(mine, [0, 0.25, 0.5, 0.999, 1.0]))


def test_median_fill_of_empty_and_all_null(spark):
    df = spark.createDataFrame([("train", None, 1.0), ("val", None, None)], "split string, a double, b double")
    rows = {r["split"]: r for r in enc.median_fill_per_split(df, ["a", "b"]).collect()}
    assert rows["train"].b == 1.0 and rows["val"].b is None and rows["train"].a is None
    assert enc.median_fill_per_split(df.limit(0), ["a", "b"]).count() == 0


def test_vocabulary_is_a_lookup_of_any_size(spark):
    train = spark.range(20_000).select(F.format_string("c%05d", "id").alias("Compound"))
    vocab = enc.fit_compound_vocab(train)
    assert vocab.count() == 20_001
    got = {r["Compound"]: r["compound_encoded"] for r in enc.compound_code(spark.createDataFrame([("c00007",), (None,), ("new",)], "Compound string"), vocab).collect()}
    unknown = got[None]
    assert got == {"c00007": 8, None: unknown, "new": unknown} and unknown == 0  # UNKNOWN sorts before c00000


def test_file_profile_counts_what_is_there(spark):
    df = spark.createDataFrame([(2024, 1, 1, "HYPERSOFT"), (2024, 1, 1, "SOFT"), (2024, 1, 2, None)], "Year int, RoundNumber int, Stint int, Compound string")
    got = {(r.Compound, r.n, r.n_laps, r.n_stints) for r in qual.file_profile(df).collect()}
    assert got == {("HYPERSOFT", 1, 3, 2), ("SOFT", 1, 3, 2), ("UNKNOWN", 1, 3, 2)}


def test_store_follows_replaced_input(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="pitlane-store-")
    shutil.copy(f"{SF_SMALL}/events.parquet", f"{d}/events.parquet")
    first = store.store_path(spark, d)
    assert store.store_path(spark, d) == first
    shutil.copy("/root/testdata/sf0.01/events.parquet", f"{d}/events.parquet")
    assert os.path.getsize(f"{d}/events.parquet") and store.store_path(spark, d) != first


def test_metrics_of_a_retrain_replace_the_old_ones(spark):
    path = scratch(spark, "metrics")
    row = lambda model, mae: spark.createDataFrame([(model, "test", mae, 0.5)], "model string, split string, mae double, r2 double")
    for model, mae in (("boosted", 0.9), ("sequence", 0.4), ("boosted", 0.2)):
        ML.write_metrics(row(model, mae), path)
    h = ML.health(ML.read_metrics(spark, path), "boosted", 3, 10).first()
    assert (h.test_mae, h.sequence_test_mae) == (0.2, 0.4)


def test_curve_lengths_per_request(spark):
    model = ML.LinearCurveModel(0.1, 0.01, 0.0, 0.0)
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", None), ("d", 99), ("e", -2)], "scenario string, laps int")
    n = {r["scenario"]: r["count"] for r in ML.curve_linear(model, df, n_laps=2, n_col="laps").groupBy("scenario").count().collect()}
    assert n == {"b": 3, "c": 2, "d": K.CURVE_MAX_LAPS}
    assert ML.curve_linear(model, df, n_laps=0).count() == 0


def test_telemetry_files_without_rows_count_as_none(spark):
    from pitlane.sources import scan

    path = scratch(spark, "tel")
    spark.createDataFrame([], "Year int, RoundNumber int, DriverNumber string, LapNumber int, avg_speed_kph double").write.parquet(path)
    assert scan.read_telemetry(spark, path) is None


def test_numbers_that_do_not_fit(spark):
    texts = ["3000000000", "7", "7.0", "x", None, "9007199254740993", "7.5", " 8 ", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.number_or("t", 0, "int")).collect()] == [0, 7, 7, 0, 0, 0, 0, 8, 1000]
    assert [r[0] for r in df.select(S.number_or("t", 0, "bigint")).collect()][5] == 9007199254740993
    assert [r[0] for r in df.select(S.number_or("t", 0.0)).collect()][6] == 7.5


def test_car_numbers(spark):
    text = spark.createDataFrame([("01",), ("1",)], "DriverNumber string")
    assert [r[0] for r in tel.normalise_keys(text).collect()] == ["01", "1"]
    assert tel.normalise_keys(spark.createDataFrame([(1.0,)], "DriverNumber double")).first()[0] == "1"


def test_nan_readings_are_missing(spark):
    from pitlane.plans.feature_table import build_feature_table

    lap = "Year int, RoundNumber int, EventName string, Driver string, DriverNumber string, LapNumber int, Stint int, Compound string, LapTime double, lap_start_us long, PitOutTime double, PitInTime double, TrackStatus string, IsAccurate boolean"
    laps = spark.createDataFrame([(2024, 1, "E", "A", "1", 1, 1, "SOFT", 90.0, 0, None, None, "1", True)], lap)
    samples = spark.createDataFrame([(2024, 1, "1", t * 1_000_000, float("nan") if t % 2 else 100.0) for t in range(20)], "Year int, RoundNumber int, DriverNumber string, t_us long, Throttle double")
    row = build_feature_table(laps, None, samples).first()
    assert row.avg_throttle_pct == 100.0 and row.full_throttle_pct == 0.5


def test_a_model_without_mae_does_not_win(spark):
    df = spark.createDataFrame([("a", "test", None), ("b", "test", 0.5), ("c", "test", float("nan"))], "model string, split string, mae double")
    assert M.best_model(df).first().best_model == "b"


def test_duplicate_weather_times_follow_the_order(spark):
    left = spark.createDataFrame([(1, 10.0)], "race int, t double")
    right = spark.createDataFrame([(1, 9.0, 30.0, 1), (1, 9.0, 20.0, 2)], "race int, t double, temp double, line int")
    for bucket in (None, 5.0):
        assert asof_nearest(left, right, ["race"], "t", "t", ["temp"], bucket=bucket, right_order=["line"]).first().temp == 20.0
        assert asof_nearest(left, right, ["race"], "t", "t", ["temp"], bucket=bucket).first().temp == 30.0


def test_next_start_does_not_depend_on_the_slice(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(s), i) for i, (c, s) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 5000, 300), strict=True))] + [(None, 7, 900), (None, 9, 901)]
    df = spark.createDataFrame(rows, "car int, s long, lap int")
    results = [{(r.car, r.lap): r["__end"] for r in next_start(df, ["car"], "s", "lap", F.lit(100), slice_width=w).collect()} for w in (1, 50, 10**9)]
    assert results[0] == results[1] == results[2]


def test_a_race_with_most_laps_spreads_over_tasks(spark):
    rows = [(2024, 1 if i % 10 else 2, f"D{i % 20}", i % 6, 1 + i // 60, 90.0 + i % 7, "E", "SOFT") for i in range(6000)]
    df = spark.createDataFrame(rows, "Year int, RoundNumber int, Driver string, Stint int, LapNumber int, LapTime double, EventName string, Compound string")
    out = feat.add_track_evolution(feat.add_rolling_features(feat.add_fuel_correction(df)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = out.where("RoundNumber = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 0.6 * 5400
    order = [r.track_evolution for r in out.where("RoundNumber = 1").orderBy("LapNumber", "Driver", "track_evolution").collect()]
    assert order == list(range(1, 5401))


def test_global_row_index_with_nulls(spark):
    rows = [(2024, None, 1, "a"), (2024, 1, None, "b"), (None, 1, 1, "c"), (2023, 2, 5, None), (2023, 2, 5, "d"), (2024, 1, 3, "e")]
    df = spark.createDataFrame(rows, "Year int, RoundNumber int, LapNumber int, Driver string")
    got = [tuple(r)[:4] for r in enc.global_row_index(df).orderBy("__idx").collect()]
    assert got == sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3]) + ((r[3] is None, r[3] or ""),))


def test_shared_folder_is_required_off_local():
    require_local("local[4]")
    with pytest.raises(ValueError):
        require_local("spark://host:7077")


def test_permutation_importance_uses_all_rows(spark):
    rows = [(2024, 1, f"D{i}", i, float(i % 10), float(i % 3), float(i % 10)) for i in range(300)]
    df = spark.createDataFrame(rows, f"Year int, RoundNumber int, Driver string, LapNumber int, a double, b double, {K.TARGET} double")
    got = {r.feature: r.mae_increase for r in ML.permutation_importance(lambda d: d.withColumn("pred", F.col("a")), df, ["a", "b"]).collect()}
    assert got["a"] > 1 and abs(got["b"]) < 1e-9
