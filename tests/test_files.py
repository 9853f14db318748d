"""JSON files with quarantine, sessions, seasons, and first-in-file order."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pitlane.operators.telemetry import dedup_first, join_telemetry
from pitlane.operators.temporal_joins import asof_nearest
from pitlane.session import checkpoint_dir
from pitlane.sources import json_files as J
from pitlane.sources import nested, scan


def folder(spark, files):
    path = f"{checkpoint_dir(spark).removeprefix('file:')}/json-{uuid.uuid4().hex}"
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    return path


def test_broken_files_are_set_aside_and_the_rest_is_read(spark):
    path = folder(spark, {
        "a/1.json": '[{"session_key": 1, "driver_number": 7, "lap_number": 1, "date_start": "2024-01-01T00:00:00Z"},\n {"session_key": 1, "driver_number": 7, "lap_number": 2, "date_start": null}]',
        "a/2.json": '[{"session_key": 2, "driver',  # cut off
        "b/3.json": '{"session_key": 3, "driver_number": 9, "lap_number": 1, "date_start": "2024-01-01T00:00:01.5Z", "more": [1]}',
        "b/4.json": '{"detail": "Too many requests"}',  # JSON, but no record
        "b/5.json": '[]',
        "b/6.json": '[{"session_key": "x", "driver_number": 1, "lap_number": 1, "date_start": "2024-01-01T00:00:00Z"}]',  # wrong type
    })
    bad = f"{path}-rejected"
    docs = J.read_documents(spark, path, J.API_LAP, quarantine=bad)
    rows = docs.rows.orderBy("session_key", "lap_number").collect()
    assert [(r.session_key, r.lap_number) for r in rows] == [(1, 1), (1, 2), (3, 1)]
    names = {os.path.basename(r.source_file) for r in docs.rejected.collect()}
    assert names == {"2.json", "4.json", "6.json"}
    assert {os.path.basename(r.source_file) for r in spark.read.json(bad).collect()} == names
    laps = scan.read_json_records(spark, path, J.API_LAP, "date_start", ["driver_number", "date_start"])
    assert sorted((r.session_key, r.date_start.microsecond) for r in laps.collect()) == [(1, 0), (3, 500_000)]
    assert J.read_documents(spark, f"{path}/none", J.API_LAP).rows.count() == 0


def test_a_race_on_two_pages_and_a_broken_page(spark):
    page = lambda results: '{"MRData": {"RaceTable": {"season": "2023", "Races": [{"round": "5", "Circuit": {"circuitId": "c"}, "Results": [%s]}]}}}' % results
    one = '{"Driver": {"driverId": "%s"}, "Constructor": {"constructorId": "k"}, "grid": "%s", "position": "1", "points": "%s", "status": "ok"}'
    path = folder(spark, {"p1.json": page(one % ("a", "1", "25")), "p2.json": page(one % ("b", "x", "")), "p3.json": "{", "p4.json": '{"MRData": null}'})
    rows = nested.flatten_results(nested.read_pages(spark, path, nested.RESULTS_PAGE)).orderBy("driver_id").collect()
    assert [(r.year, r.round, r.driver_id, r.grid, r.points) for r in rows] == [(2023, 5, "a", 1, 25.0), (2023, 5, "b", 0, 0.0)]


def test_sessions_by_name_and_year(spark):
    s = spark.createDataFrame([(1, 2023, "Race", "spa"), (2, 2023, "Qualifying", "spa"), (3, 2024, "Race", None), (4, None, "Race", "x"), (5, 2023, None, "y")], J.API_SESSION)
    assert {(r.session_key, r.circuit) for r in J.race_sessions(s).collect()} == {(1, "spa"), (3, "unknown"), (4, "x")}
    assert {r.session_key for r in J.race_sessions(s, [2023]).collect()} == {1}
    laps = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "session_key int, x string")
    assert [r.x for r in J.of_sessions(laps, J.race_sessions(s)).collect()] == ["a"]


def test_seasons_fail_alone(spark):
    row = '{"Year": %d, "RoundNumber": %d, "EventName": "G", "EventFormat": "%s"}'
    path = folder(spark, {
        "season=2022/a.json": f"[{row % (2022, 1, 'conventional')}, {row % (2022, 2, 'testing')}]",
        "season=2023/a.json": f"[{row % (2023, 1, 'sprint')}]", "season=2023/b.json": "[{",  # half of it is broken
        "season=2024/a.json": "oops", "season=2030/a.json": f"[{row % (2030, 1, 'sprint')}]",
    })
    rows, report = J.season_schedules(spark, path, [2022, 2023, 2024, 2025])
    assert {(r.season, r.status, r.n_races) for r in report.collect()} == {(2022, "ok", 1), (2023, "unreadable", 0), (2024, "unreadable", 0), (2025, "missing", 0)}
    assert sorted((r.Year, r.RoundNumber) for r in rows.collect()) == [(2022, 1), (2022, 2)]


def test_the_first_row_of_the_first_file_is_kept(spark):
    import pandas as pd

    path = f"{checkpoint_dir(spark).removeprefix('file:')}/order-{uuid.uuid4().hex}"
    os.makedirs(path)
    parts = [
        [(2024, 1, "7", 1, 5.0), (2024, 1, "7", 1, 1.0), (2024, 1, "7", 2, 9.0)],
        [(2024, 1, "7", 2, 2.0), (2024, 1, "7", 3, 3.0), (2024, 1, "7", 1, 0.0)],
    ]
    cols = ["Year", "RoundNumber", "DriverNumber", "LapNumber", "avg_speed_kph"]
    frames = [pd.DataFrame(p, columns=cols) for p in parts]
    for i, f in enumerate(frames):
        f.to_parquet(f"{path}/part-{i}.parquet")
    keys = cols[:4]
    want = pd.concat(frames).drop_duplicates(keys, keep="first").set_index("LapNumber")["avg_speed_kph"].to_dict()
    files = scan.with_file_order(spark.read.parquet(path))
    assert {r.LapNumber: r.avg_speed_kph for r in dedup_first(files, keys, scan.FILE_ORDER).collect()} == want
    laps = spark.createDataFrame([(2024, 1, "7", i) for i in (1, 2, 3, 4)], "Year int, RoundNumber int, DriverNumber string, LapNumber int")
    joined = join_telemetry(laps, files)
    assert {r.LapNumber: r.avg_speed_kph for r in joined.collect()} == {**want, 4: None} and not set(scan.FILE_ORDER) & set(joined.columns)


def test_equal_weather_times_keep_the_last_in_file_order(spark):
    path = f"{checkpoint_dir(spark)}/wx-{uuid.uuid4().hex}"
    for i, rows in enumerate([[(1, 10.0, 3.0), (1, 10.0, 9.0)], [(1, 10.0, 1.0)]]):
        spark.createDataFrame(rows, "r int, Time double, AirTemp double").coalesce(1).write.parquet(f"{path}/batch={i}")
    wx = scan.with_file_order(spark.read.parquet(path))
    laps = spark.createDataFrame([(1, 12.0)], "r int, LapStartTime double")
    for bucket in (None, 5.0):
        got = asof_nearest(laps, wx, ["r"], "LapStartTime", "Time", ["AirTemp"], bucket=bucket, right_order=scan.FILE_ORDER)
        assert [r.AirTemp for r in got.collect()] == [1.0]
    assert F is not None
