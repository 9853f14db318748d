"""Registered queries: scans, cleaning, joins, telemetry, lap features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitlane import constants as K
from pitlane.functions.scalar import file_key, td_seconds
from pitlane.operators import features as feat
from pitlane.operators import quality as qual
from pitlane.operators import telemetry as tel
from pitlane.operators.temporal_joins import asof_nearest
from pitlane.plans import store
from pitlane.plans.feature_table import attach_weather, feature_table_from_testdata
from pitlane.plans.registry import ORACLE, register
from pitlane.session import checkpoint_dir
from pitlane.sources import fixtures as fx
from pitlane.sources import scan

LAP_OUT = [
    "event_id", "Year", "RoundNumber", "EventName", "Driver", "DriverNumber", "Team", "LapNumber", "Stint",
    "TyreLife", "LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "Compound", "TrackStatus",
    "LapStartTime", "PitInTime", "PitOutTime", "Rainfall", "IsAccurate",
]
LAP_DBL = ("LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "LapStartTime", "PitInTime", "PitOutTime")


# --- step 1: scans and projections ------------------------------------------

@register("scan_laps", oracle=f"select {', '.join(LAP_OUT)} from laps", doubles=LAP_DBL)
def q_scan_laps(spark, sf):
    """Lap scan, NaN -> NULL, the listed lap columns that exist."""
    return scan.keep_existing(scan.nan_to_null_all(fx.laps(spark, sf)), LAP_OUT)


@register(
    "union_by_name",
    oracle="""
select event_id, Year, RoundNumber, Driver, LapNumber, LapTime, Sector1Time, Compound from laps where Year = 2023
union all by name
select event_id, Year, RoundNumber, Driver, LapNumber, LapTime, cast(null as double) as Sector1Time, cast(null as varchar) as Compound
from laps where Year > 2023""",
    doubles=("LapTime", "Sector1Time"),
)
def q_union_by_name(spark, sf):
    """Files with different columns stacked by name, missing -> null."""
    lp = fx.laps(spark, sf)
    a = lp.where(F.col("Year") == 2023).select("event_id", "Year", "RoundNumber", "Driver", "LapNumber", "LapTime", "Sector1Time", "Compound")
    b = lp.where(F.col("Year") > 2023).select("event_id", "Year", "RoundNumber", "Driver", "LapNumber", "LapTime")
    return scan.stack_by_name([a, b])


@register(
    "schedule_filter",
    oracle="""
select Year, RoundNumber, EventName, EventFormat, coalesce(OfficialEventName, EventName, '') as CircuitShortName,
  Country, Location, printf('%d_R%02d', Year, RoundNumber) as file_key
from schedule
where EventFormat in ('conventional', 'sprint', 'sprint_qualifying') and RoundNumber in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12)""",
)
def q_schedule_filter(spark, sf):
    """Race formats kept, optional round list, circuit name fallback."""
    s = scan.schedule_races(fx.schedule(spark, sf), rounds=[1, 2, 3, 4, 6, 7, 8, 9, 11, 12])
    return s.select(
        "Year", "RoundNumber", "EventName", "EventFormat", "CircuitShortName", "Country", "Location",
        file_key("Year", "RoundNumber").alias("file_key"),
    )


@register(
    "td_seconds",
    oracle="""
select event_id, cast(lap_start_us * 1000 as double) / 1e9 as lap_start_s,
  try_cast(TrackStatus as double) as status_num,
  try_cast(case when event_id % 7 = 0 then 'n/a' else cast(LapTime as varchar) end as double) as lap_time_s
from laps""",
    doubles=("lap_start_s", "status_num", "lap_time_s"),
)
def q_td_seconds(spark, sf):
    """Durations in ns -> seconds; other values parsed as numbers, bad -> null."""
    lp = fx.laps(spark, sf).select(
        "event_id", (F.col("lap_start_us") * 1000).alias("lap_start_ns"), "TrackStatus",
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("LapTime").cast("string")).alias("lap_time_txt"),
    )
    types = {f.name: f.dataType for f in lp.schema.fields}
    return lp.select(
        "event_id",
        td_seconds("lap_start_ns", types["lap_start_ns"]).alias("lap_start_s"),
        td_seconds("TrackStatus", types["TrackStatus"]).alias("status_num"),
        td_seconds("lap_time_txt", types["lap_time_txt"]).alias("lap_time_s"),
    )


@register(
    "normalise_keys",
    oracle="""
select event_id, cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, cast(LapNumber as int) as LapNumber,
  cast(cast(cast(DriverNumber as double) as bigint) as varchar) as DriverNumber
from laps""",
)
def q_normalise_keys(spark, sf):
    """P5: keys as int / string; a float driver number 1.0 becomes "1"."""
    lp = fx.laps(spark, sf).select(
        "event_id", F.col("Year").cast("bigint").alias("Year"), F.col("RoundNumber").cast("double").alias("RoundNumber"),
        F.col("LapNumber").cast("double").alias("LapNumber"), F.col("DriverNumber").cast("double").alias("DriverNumber"),
    )
    return tel.normalise_keys(lp)


# --- step 2: cleaning -------------------------------------------------------

@register("clean_laps", oracle=f"select {', '.join(LAP_OUT)} from clean", doubles=LAP_DBL)
def q_clean_laps(spark, sf):
    """Q1: the nine cleaning rules as one filter."""
    return qual.clean_laps(fx.laps(spark, sf)).select(*LAP_OUT)


REASON_SQL = """
case when LapTime is null then 'null_time' when LapTime > 150 then 'slow'
  when PitOutTime is not null then 'out' when PitInTime is not null then 'in'
  when contains(coalesce(TrackStatus, ''), '4') then 'sc' when contains(coalesce(TrackStatus, ''), '6') then 'vsc'
  when contains(coalesce(TrackStatus, ''), '2') then 'yellow' when coalesce(Rainfall, false) then 'wet'
  when IsAccurate is not distinct from false then 'inaccurate' else 'keep' end"""


@register(
    "removal_audit",
    oracle=f"""
with r as (select {REASON_SQL} as reason from laps),
spine as (select * from (values ('null_time', 0), ('slow', 1), ('out', 2), ('in', 3), ('sc', 4), ('vsc', 5),
  ('yellow', 6), ('wet', 7), ('inaccurate', 8), ('keep', 9)) t(reason, rule_order)),
c as (select s.reason, s.rule_order, cast(count(r.reason) as bigint) as n from spine s left join r on r.reason = s.reason
      group by s.reason, s.rule_order)
select reason, n, cast(sum(n) over () as bigint) as before,
  cast(sum(case when reason = 'keep' then n else 0 end) over () as bigint) as after,
  case when sum(n) over () > 0 then round((sum(n) over () - sum(case when reason = 'keep' then n else 0 end) over ()) * 100.0
    / sum(n) over (), 6) else 0.0 end as pct_removed,
  cast(rule_order as int) as rule_order
from c""",
    doubles=("pct_removed",),
)
def q_removal_audit(spark, sf):
    """Q2: laps removed per rule, first matching rule wins."""
    return qual.removal_audit(fx.laps(spark, sf))


@register(
    "file_profile",
    oracle="""
with r as (select Year, RoundNumber, count(*) as n_laps, count(distinct Stint) as n_stints from laps group by 1, 2)
select Year, RoundNumber, coalesce(Compound, 'UNKNOWN') as Compound, count(*) as n, any_value(n_laps) as n_laps, any_value(n_stints) as n_stints
from laps join r using (Year, RoundNumber) group by 1, 2, 3""",
)
def q_file_profile(spark, sf):
    """Per race and compound: laps, with the race's laps and distinct stints."""
    return qual.file_profile(fx.laps(spark, sf))


# --- step 3: fuel correction and stint features ------------------------------

FUEL_OUT = ["Year", "RoundNumber", "Driver", "LapNumber", "Stint", "fuel_load_kg", "lap_time_corrected"]


@register(
    "fuel_correction",
    oracle=f"""select {', '.join(FUEL_OUT)} from tgt_clean""",
    doubles=("fuel_load_kg", "lap_time_corrected"),
)
def q_fuel_correction(spark, sf):
    """A3/F1/F2 on cleaned laps: race length, fuel load, corrected time."""
    return feat.add_fuel_correction(qual.clean_laps(fx.laps(spark, sf))).select(*FUEL_OUT)


@register(
    "stint_delta",
    oracle="""select Year, RoundNumber, Driver, LapNumber, Stint, lap_time_delta_fuel_corrected,
  stint_lap_number from tgt_clean""",
    doubles=("lap_time_delta_fuel_corrected",),
)
def q_stint_delta(spark, sf):
    """Delta to the stint's first clean lap, position in stint."""
    return feat.add_fuel_correction(qual.clean_laps(fx.laps(spark, sf))).select(
        "Year", "RoundNumber", "Driver", "LapNumber", "Stint", K.TARGET, "stint_lap_number")


@register(
    "rolling_deg",
    oracle="""select Year, RoundNumber, Driver, LapNumber, Stint, rate as deg_rate_last_3, deg_acceleration from roll_clean""",
    doubles=("deg_rate_last_3", "deg_acceleration"),
)
def q_rolling_deg(spark, sf):
    """3-lap rolling mean of the delta and its first difference."""
    df = feat.add_rolling_features(feat.add_fuel_correction(qual.clean_laps(fx.laps(spark, sf))))
    return df.select("Year", "RoundNumber", "Driver", "LapNumber", "Stint", "deg_rate_last_3", "deg_acceleration")


@register(
    "track_evolution",
    oracle="""select Year, RoundNumber, Driver, LapNumber,
  row_number() over (partition by Year, RoundNumber order by LapNumber, Driver) as track_evolution from clean""",
)
def q_track_evolution(spark, sf):
    """Running lap count of the race."""
    return feat.add_track_evolution(qual.clean_laps(fx.laps(spark, sf))).select(
        "Year", "RoundNumber", "Driver", "LapNumber", "track_evolution")


FEAT_OUT = [
    "Year", "RoundNumber", "EventName", "Driver", "DriverNumber", "LapNumber", "Stint", "Compound", "LapTime",
    "AirTemp", "TrackTemp", "WindSpeed", "avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct",
    "max_speed_kph", "avg_speed_kph", "drs_active_pct", "avg_rpm", "fuel_load_kg", "lap_time_corrected",
    "lap_time_delta_fuel_corrected", "stint_lap_number", "deg_rate_last_3", "deg_acceleration", "track_evolution",
]
FEAT_DBL = tuple(c for c in FEAT_OUT if c not in (
    "Year", "RoundNumber", "EventName", "Driver", "DriverNumber", "LapNumber", "Stint", "Compound",
    "stint_lap_number", "track_evolution"))


@register(
    "feature_table",
    oracle=f"select {', '.join(FEAT_OUT)} from feat",
    doubles=FEAT_DBL,
)
def q_feature_table(spark, sf):
    """L-1: the whole feature table (J2 -> Q1 -> J3/A1/J1 -> fuel -> windows)."""
    return feature_table_from_testdata(spark, sf).select(*FEAT_OUT)


# --- step 4: temporal joins and telemetry ------------------------------------

@register(
    "asof_weather",
    oracle="select event_id, Year, RoundNumber, LapStartTime, AirTemp, TrackTemp, WindSpeed from lapsw",
    doubles=("LapStartTime", "AirTemp", "TrackTemp", "WindSpeed"),
)
def q_asof_weather(spark, sf):
    """Nearest weather row per lap (ties to the earlier row)."""
    lp = fx.laps(spark, sf).select("event_id", "Year", "RoundNumber", "LapStartTime")
    return asof_nearest(lp, fx.weather(spark, sf), K.RACE_KEYS, "LapStartTime", "Time",
                        ["AirTemp", "TrackTemp", "WindSpeed"], bucket=600.0)


@register(
    "interval_assign",
    oracle="select Year, RoundNumber, DriverNumber, t_us, LapNumber from assigned",
)
def q_interval_assign(spark, sf):
    """Each sample to the lap interval [start, next start) (+180 s for the last)."""
    lp = fx.laps(spark, sf)
    s = fx.samples(spark, sf, lp)
    return tel.assign_samples_to_laps(s, lp, lap_cols=["LapNumber"]).select(
        "Year", "RoundNumber", "DriverNumber", "t_us", "LapNumber")


TEL_OUT = ["Year", "RoundNumber", "EventName", "Driver", "DriverNumber", "LapNumber", "Stint", "Compound",
           "avg_speed_kph", "max_speed_kph", "avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct",
           "drs_active_pct", "avg_rpm", "avg_gear"]


@register("telemetry_per_lap", oracle=f"select {', '.join(TEL_OUT)} from tel", doubles=tuple(TEL_OUT[8:]))
def q_telemetry_per_lap(spark, sf):
    """Per-lap telemetry means, maxima and shares; >= 5 samples."""
    lp = fx.laps(spark, sf)
    return tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, sf, lp), lp)).select(*TEL_OUT)


@register("telemetry_files", oracle=f"select {', '.join(TEL_OUT)} from tel", doubles=tuple(TEL_OUT[8:]))
def q_telemetry_files(spark, sf):
    """Per-lap telemetry landed per race and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/telemetry-{uuid.uuid4().hex[:12]}"
    scan.write_by_race(q_telemetry_per_lap(spark, sf), path)
    return scan.read_telemetry(spark, path).select(*TEL_OUT)


API_SQL = """
with al as (select Year * 100 + RoundNumber as session_key, Year as year, cast(DriverNumber as int) as driver_number,
              LapNumber as lap_number, lap_start_us as s from laps),
ale as (select *, coalesce(lead(s) over (partition by session_key, driver_number order by s, lap_number), s + 180000000) as e from al),
ac as (select Year * 100 + RoundNumber as session_key, cast(DriverNumber as int) as driver_number, t_us,
         Throttle as throttle, Brake as brake, Speed as speed, DRS as drs, RPM as rpm from samples),
agg as (select c.session_key, c.driver_number, l.lap_number, count(*) as n_telemetry_samples,
          avg(throttle) as avg_throttle_pct, avg(brake) as avg_brake, max(speed) as max_speed_kph,
          avg(case when drs > 0 then cast(1 as double) else cast(0 as double) end) as drs_laps_pct, avg(rpm) as avg_rpm
        from ac c join ale l on c.session_key = l.session_key and c.driver_number = l.driver_number
          and c.t_us >= l.s and c.t_us < l.e
        group by c.session_key, c.driver_number, l.lap_number having count(*) >= 5),
sess as (select session_key, min(year) as year, coalesce(case when session_key % 4 = 0 then null
           else concat('circuit', cast(session_key % 100 as varchar)) end, 'unknown') as circuit from al group by session_key)
select a.*, s.year, s.circuit from agg a left join sess s on a.session_key = s.session_key"""


@register("api_telemetry_per_lap", oracle=API_SQL,
          doubles=("avg_throttle_pct", "avg_brake", "max_speed_kph", "drs_laps_pct", "avg_rpm"))
def q_api_telemetry_per_lap(spark, sf):
    """Timestamped API samples per lap, DRS > 0 share, session columns."""
    lp = fx.laps(spark, sf)
    al = fx.api_laps(spark, sf, lp)
    car = fx.api_car(spark, sf, fx.samples(spark, sf, lp))
    sessions = al.groupBy("session_key").agg(F.min("year").alias("year")).withColumn(
        "circuit",
        F.when(F.col("session_key") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("circuit"), (F.col("session_key") % 100).cast("string"))),
    )
    return tel.api_telemetry_per_lap(car, al, sessions).select(
        "session_key", "driver_number", "lap_number", "n_telemetry_samples", "avg_throttle_pct", "avg_brake",
        "max_speed_kph", "drs_laps_pct", "avg_rpm", "year", "circuit")


@register(
    "join_telemetry",
    oracle="""select event_id, Year, RoundNumber, DriverNumber, LapNumber, avg_throttle_pct, full_throttle_pct, avg_brake,
  braking_pct, max_speed_kph, avg_speed_kph, drs_active_pct, avg_rpm from joined""",
    doubles=("avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct", "max_speed_kph", "avg_speed_kph",
             "drs_active_pct", "avg_rpm"),
)
def q_join_telemetry(spark, sf):
    """J1 (+D1, P5): cleaned laps left-join per-lap telemetry."""
    lp = fx.laps(spark, sf)
    t = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, sf, lp), lp))
    j = tel.join_telemetry(qual.clean_laps(attach_weather(lp, fx.weather(spark, sf))), t)
    return j.select("event_id", "Year", "RoundNumber", "DriverNumber", "LapNumber", *K.TELEMETRY_COLS)


def bucketed_join(spark, sf, buckets: int = 8):
    """J1 on laps and per-lap telemetry landed bucketed by the lap keys: no exchange on either side."""
    lp = fx.laps(spark, sf)
    t = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, sf, lp), lp))
    cleaned = qual.clean_laps(attach_weather(lp, fx.weather(spark, sf)))
    laps, telemetry = (store.bucketed(tel.normalise_keys(d), name, K.LAP_JOIN_KEYS, buckets) for d, name in ((cleaned, "laps"), (t, "telemetry")))
    return tel.join_telemetry(laps, telemetry, normalised=True)


@register("join_telemetry_bucketed", oracle=ORACLE["join_telemetry"])
def q_join_telemetry_bucketed(spark, sf):
    """J1 (+D1, P5) over the bucketed layout."""
    return bucketed_join(spark, sf).select("event_id", "Year", "RoundNumber", "DriverNumber", "LapNumber", *K.TELEMETRY_COLS)


@register(
    "dedup_first",
    oracle="""
select l_orderkey, l_linenumber, l_partkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) as rn
  from lineitem) q where rn = 1""",
    doubles=("l_quantity",),
)
def q_dedup_first(spark, sf):
    """One row per duplicated join key, the first by an explicit order."""
    li = fx.table(spark, sf, "lineitem")
    return tel.dedup_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register(
    "telemetry_fill_rate",
    oracle="""select 'avg_throttle_pct' as "column", avg(case when avg_throttle_pct is not null then 1.0 else 0.0 end)::double
  as fill_rate, count(*) as n from joined""",
    doubles=("fill_rate",),
)
def q_telemetry_fill_rate(spark, sf):
    """Fill rate of the first telemetry column after the join."""
    lp = fx.laps(spark, sf)
    t = tel.telemetry_per_lap(tel.assign_samples_to_laps(fx.samples(spark, sf, lp), lp))
    return tel.fill_rate(tel.join_telemetry(qual.clean_laps(attach_weather(lp, fx.weather(spark, sf))), t))



# --- flagship ------------------------------------------------------------------

@register(
    "degradation_by_compound",
    oracle=f"""select coalesce(Compound, 'UNKNOWN') as Compound, stint_lap_number, count(*) as n_laps,
  avg({K.TARGET}) as mean_delta, max({K.TARGET}) as max_delta
from feat where stint_lap_number is not null group by 1, 2""",
    doubles=("mean_delta", "max_delta"),
)
def q_degradation_by_compound(spark, sf):
    """Flagship: the whole feature build, then mean/max fuel-corrected delta per
    compound and stint lap."""
    df = feature_table_from_testdata(spark, sf, with_samples=False).where(F.col("stint_lap_number").isNotNull())
    return df.groupBy(F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("Compound"), "stint_lap_number").agg(
        F.count(F.lit(1)).alias("n_laps"), F.avg(K.TARGET).alias("mean_delta"), F.max(K.TARGET).alias("max_delta"))
