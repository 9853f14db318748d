"""Registered queries: landed JSON and Parquet files read with quarantine, session filter, season report and file order."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlane.operators import telemetry as tel
from pitlane.plans.q_laps import API_SQL, TEL_OUT
from pitlane.plans.q_sources import scratch
from pitlane.plans.registry import ORACLE, register
from pitlane.sources import fixtures as fx
from pitlane.sources import json_files as J
from pitlane.sources import nested, scan


def _broken(spark, path: str, text: str) -> None:
    """A landed file that is no JSON document (cut off in the middle, as a failed download leaves it)."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)


SESSIONS_SQL = """
select session_key, year, case when session_key % 5 = 0 then 'Qualifying' when session_key % 7 = 0 then 'Sprint' else 'Race' end as session_name,
  case when session_key % 4 = 0 then null else concat('circuit', cast(session_key % 100 as varchar)) end as circuit
from (select Year * 100 + RoundNumber as session_key, min(Year) as year from laps group by 1)"""


@register(
    "api_files_telemetry",
    oracle=API_SQL.replace("lap_start_us as s from laps)", "lap_start_us as s from laps where event_id % 17 <> 0)").split("sess as (")[0]
    + f"""sess as (select session_key, year, coalesce(circuit, 'unknown') as circuit from ({SESSIONS_SQL}) x where session_name = 'Race' and year in (2023, 2024))
select a.*, s.year, s.circuit from agg a join sess s on a.session_key = s.session_key""",
    doubles=("avg_throttle_pct", "avg_brake", "max_speed_kph", "drs_laps_pct", "avg_rpm"),
)
def q_api_files_telemetry(spark, sf):
    """Laps and sessions landed as files of JSON arrays, car samples as an array a line (one of each broken), the sessions
    named "Race" of two seasons kept, then the per-lap aggregate."""
    at, lp = scratch(spark, "api"), fx.laps(spark, sf)
    iso = lambda us: F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    key = (F.col("Year") * 100 + F.col("RoundNumber")).alias("session_key")
    laps = lp.select(key, F.col("DriverNumber").cast("int").alias("driver_number"), F.col("LapNumber").alias("lap_number"),
                     F.when(F.col("event_id") % 17 == 0, F.lit("not-a-date")).otherwise(iso("lap_start_us")).alias("date_start"))
    car = fx.samples(spark, sf, lp).select(
        key, F.col("DriverNumber").cast("int").alias("driver_number"), iso("t_us").alias("date"), F.col("Throttle").alias("throttle"),
        F.col("Brake").alias("brake"), F.col("Speed").alias("speed"), F.col("DRS").alias("drs"), F.col("RPM").alias("rpm"))
    sessions = lp.groupBy(key).agg(F.min("Year").alias("year"))
    k = F.col("session_key")
    sessions = sessions.select(
        "session_key", "year", F.when(k % 5 == 0, "Qualifying").when(k % 7 == 0, "Sprint").otherwise("Race").alias("session_name"),
        F.when(k % 4 != 0, F.concat(F.lit("circuit"), (k % 100).cast("string"))).alias("circuit_short_name"))
    J.write_arrays(laps, f"{at}/laps", ["session_key", "driver_number"], "session")
    J.write_arrays(car.withColumn("__hour", F.substring("date", 1, 13)), f"{at}/car", ["session_key", "driver_number", "__hour"])
    J.write_arrays(sessions, f"{at}/sessions", ["year"], "season")
    for name in ("laps", "car", "sessions"):
        _broken(spark, f"{at}/{name}", '[{"session_key": 202301, "driver_number"')
    races = J.race_sessions(J.read_documents(spark, f"{at}/sessions", J.API_SESSION, quarantine=f"{at}/rejected").rows, [2023, 2024])
    read = lambda name, schema, ts: J.of_sessions(scan.read_json_records(
        spark, f"{at}/{name}", schema, ts, ["driver_number", ts], f"{at}/rejected", lines=name == "car"), races)
    out = tel.api_telemetry_per_lap(read("car", J.API_CAR, "date"), read("laps", J.API_LAP, "date_start"), races)
    return out.select("session_key", "driver_number", "lap_number", "n_telemetry_samples", "avg_throttle_pct", "avg_brake",
                      "max_speed_kph", "drs_laps_pct", "avg_rpm", "year", "circuit")


def _pages(spark, pages, name: str, schema, lines: bool):
    """Pages landed as files (with a broken one) and read back."""
    at = scratch(spark, name)
    pages.select("json").write.text(at)
    _broken(spark, at, '{"MRData": {"total": "30", "RaceTa')
    return nested.read_pages(spark, at, schema, lines, f"{at}-rejected")


@register("circuits_files", oracle=ORACLE["circuits_flat"])
def q_circuits_files(spark, sf):
    """S6 from landed page files, a document a file; a broken file is set aside."""
    pages = nested.circuit_pages(fx.table(spark, sf, "nation"), fx.table(spark, sf, "region"))
    return nested.flatten_circuits(_pages(spark, pages.coalesce(1), "circuit-pages", nested.CIRCUIT_PAGE, False))


@register("drivers_files", oracle=ORACLE["drivers_first_season"])
def q_drivers_files(spark, sf):
    """S7/D2 from landed page files, a document a line; a broken line is set aside."""
    pages = nested.driver_pages(fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer"))
    return nested.flatten_drivers(_pages(spark, pages, "driver-pages", nested.DRIVER_PAGE, True))


@register("race_results_files", oracle=ORACLE["race_results_flat"])
def q_race_results_files(spark, sf):
    """S8 from landed page files: every race with more than three results is split over two pages."""
    pages = nested.result_pages(fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem"), split=3)
    return nested.flatten_results(_pages(spark, pages, "result-pages", nested.RESULTS_PAGE, True))


def _season_files(spark, sf) -> str:
    """Schedules landed as a JSON array a season; the one of 2024 is broken."""
    at = scratch(spark, "schedules")
    races = fx.schedule(spark, sf)
    J.write_arrays(races.where(F.col("Year") != 2024).withColumnRenamed("Year", "season").withColumn("Year", F.col("season")), at, ["season"], "season")
    _broken(spark, f"{at}/season=2024", '[{"Year": 2024, "RoundNumber": 1, "EventName": "GP')
    return at


@register(
    "season_report",
    oracle="""
select cast(y as int) as season, case when y = 2024 then 'unreadable' when n is null then 'missing' else 'ok' end as status,
  case when y = 2024 then 0 else coalesce(n, 0) end::bigint as n_races
from range(2022, 2027) t(y) left join (
  select Year, count(*) filter (EventFormat in ('conventional', 'sprint', 'sprint_qualifying')) as n from schedule group by 1) s on s.Year = y""",
)
def q_season_report(spark, sf):
    """What became of every wanted season; a broken or absent schedule is a row, not a failure."""
    return J.season_schedules(spark, _season_files(spark, sf), list(range(2022, 2027)))[1]


@register(
    "season_targets",
    oracle="""
select Year, RoundNumber, EventName from schedule
where Year <> 2024 and EventFormat in ('conventional', 'sprint', 'sprint_qualifying') and RoundNumber > 4""",
)
def q_season_targets(spark, sf):
    """Races to ingest over all readable seasons, without those already written."""
    schedules, _ = J.season_schedules(spark, _season_files(spark, sf), list(range(2022, 2027)))
    out = scratch(spark, "ingested")
    scan.write_by_race(fx.laps(spark, sf).where(F.col("RoundNumber") <= 4).select("Year", "RoundNumber", "LapNumber"), out)
    todo = scan.incremental_targets(scan.schedule_races(schedules), scan.written_races(spark, out))
    return todo.select("Year", "RoundNumber", "EventName")


@register(
    "dedup_file_order",
    oracle=f"""
select {', '.join(TEL_OUT[:8])}, case when LapNumber % 3 <> 0 then avg_speed_kph else avg_speed_kph + 1000 end as avg_speed_kph
from tel""",
    doubles=("avg_speed_kph",),
)
def q_dedup_file_order(spark, sf):
    """D1 in file order: a later telemetry file repeats every lap with other values; laps of the first file keep its row."""
    at, lp = scratch(spark, "telemetry"), fx.laps(spark, sf)
    first = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, sf, lp), lp)).select(*TEL_OUT)
    first.where(F.col("LapNumber") % 3 != 0).write.parquet(f"{at}/batch=1")
    first.withColumn("avg_speed_kph", F.col("avg_speed_kph") + 1000).write.parquet(f"{at}/batch=2")
    files = scan.with_file_order(spark.read.parquet(at))
    return tel.dedup_first(files, ["Year", "RoundNumber", "DriverNumber", "LapNumber"], scan.FILE_ORDER).select(*TEL_OUT[:8], "avg_speed_kph")
