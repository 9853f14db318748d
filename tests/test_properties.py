"""Properties over the testdata (sf0.001)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracle_compare import SF_SMALL
from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.operators import sequences as S
from pitlane.operators import telemetry as tel
from pitlane.plans.store import feature_store
from pitlane.sources import fixtures as fx


def test_each_sample_has_at_most_one_lap(spark):
    lp = fx.laps(spark, SF_SMALL)
    a = tel.assign_samples_to_laps(fx.samples(spark, SF_SMALL, lp), lp)
    dup = a.groupBy("Year", "RoundNumber", "DriverNumber", "t_us").count().where("count > 1").count()
    assert dup == 0


def test_delta_is_zero_at_first_lap_of_stint(spark):
    df = feature_store(spark, SF_SMALL)
    first = df.where((F.col("stint_lap_number") == 0) & F.col(K.TARGET).isNotNull())
    assert first.where(F.abs(F.col(K.TARGET)) > 1e-9).count() == 0


def test_splits_are_disjoint_and_cover(spark):
    df = enc.temporal_split(feature_store(spark, SF_SMALL))
    n = df.count()
    per = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(per.values()) == n and set(per) <= {"train", "val", "test", None}


def test_prefix_count_is_sum_of_l_minus_one(spark):
    df = feature_store(spark, SF_SMALL)
    seqs = S.stint_sequences(df, K.SEQUENCE_FEATURES)
    want = seqs.agg(F.sum(F.col("L") - 1)).collect()[0][0]
    assert S.prefix_augment(seqs).count() == want


def test_row_order_does_not_matter(spark):
    lp = fx.laps(spark, SF_SMALL)
    shuffled = lp.orderBy(F.rand(7)).repartition(5)
    a = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, SF_SMALL, lp), lp))
    b = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, SF_SMALL, lp), shuffled))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_encoders_fit_on_train_only(spark):
    df = enc.temporal_split(feature_store(spark, SF_SMALL))
    train = df.where(F.col("split") == "train")
    m1 = enc.fit_medians(train, ["fuel_load_kg", "TrackTemp"])
    changed = df.withColumn("TrackTemp", F.when(F.col("split") != "train", F.lit(999.0)).otherwise(F.col("TrackTemp")))
    m2 = enc.fit_medians(changed.where(F.col("split") == "train"), ["fuel_load_kg", "TrackTemp"])
    assert m1 == m2
