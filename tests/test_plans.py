"""Physical plans: no cartesian or nested-loop joins in the temporal joins; pruning reaches the scan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from oracle_compare import SF_SMALL
from pitlane.operators import telemetry as tel
from pitlane.plans.feature_table import attach_weather, feature_table_from_testdata
from pitlane.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_has_no_nested_loop(spark):
    p = plan(attach_weather(fx.laps(spark, SF_SMALL), fx.weather(spark, SF_SMALL)))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_interval_join_is_an_equi_join(spark):
    lp = fx.laps(spark, SF_SMALL)
    p = plan(tel.assign_samples_to_laps(fx.samples(spark, SF_SMALL, lp), lp))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "SortMergeJoin" in p and "ShuffledHashJoin" not in p


def test_feature_table_plan_prunes_columns(spark):
    p = plan(feature_table_from_testdata(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "ReadSchema" in p
    assert all("props" not in part.split("\n")[0] for part in p.split("ReadSchema")[1:])


def test_race_scan_prunes_partitions_and_columns(spark):
    from pitlane.plans.store import feature_store
    from pitlane.sources import scan

    df = scan.race_scan(feature_store(spark, SF_SMALL), 2024, 3).select("Driver", "LapNumber")
    p = plan(df)
    filters = re.search(r"PartitionFilters: \[(.*?)\]", p)[1]
    assert "Year" in filters and "2024" in filters and "RoundNumber" in filters and "= 3" in filters
    assert re.search(r"ReadSchema: struct<(.*?)>", p)[1] == "LapNumber:int,Driver:string"


def test_no_window_is_partitioned_by_the_race_alone(spark):
    """Windows of the feature build hold a stint, a lap number, or one row a lap number of a race."""
    from pitlane.operators import features as feat

    lp = fx.laps(spark, SF_SMALL)
    out = feat.add_track_evolution(feat.add_rolling_features(feat.add_fuel_correction(lp)))
    p = plan(out)
    for line in p.split("\n"):
        if "Window" in line and "windowspecdefinition" in line:
            spec = line.split("windowspecdefinition(")[1]
            by = re.findall(r"(\w+)#", spec.split(" ASC")[0])
            assert "Stint" in by or "LapNumber" in by or "DriverNumber" in by, line[:300]


def test_cleaning_filter_reaches_the_scan(spark):
    import uuid

    from pitlane.operators.quality import clean_laps
    from pitlane.session import checkpoint_dir
    from pitlane.sources import fixtures as fx
    from pitlane.sources import scan

    path = f"{checkpoint_dir(spark)}/laps-{uuid.uuid4().hex}"
    scan.write_by_race(fx.laps(spark, SF_SMALL), path)
    p = plan(scan.read_laps(spark, path, clean=True).select("LapNumber"))
    assert "IsNotNull(LapTime)" in p and "LessThanOrEqual(LapTime,150.0)" in p
    # the same rows as cleaning after the scan
    a = scan.read_laps(spark, path, clean=True)
    b = clean_laps(fx.laps(spark, SF_SMALL)).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bucketed_join_has_no_exchange(spark):
    from pitlane.plans.q_laps import bucketed_join

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bucketed_join(spark, SF_SMALL)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        # one race holds all rows of a second table: its laps are in every bucket
        laps = joined.select("Year", "RoundNumber", "DriverNumber", "LapNumber").withColumns({"Year": F.lit(2024), "RoundNumber": F.lit(1)}).distinct()
        from pitlane import constants as K
        from pitlane.plans import store

        one = store.bucketed(laps, "hot", K.LAP_JOIN_KEYS, 4).groupBy(F.spark_partition_id()).count().collect()
        assert len(one) == 4 and max(r["count"] for r in one) < 2 * min(r["count"] for r in one)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
