"""Registered queries: the streaming jobs, run to completion with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitlane.plans.registry import register
from pitlane.session import checkpoint_dir
from pitlane.sources import fixtures as fx
from pitlane.streaming import asof_stream as AS
from pitlane.streaming import telemetry_stream as ST

SLICE_US = 6 * AS.SLICE_US  # a race of the test data lasts a day


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _src(sf):
    return sf.rstrip("/")


@register(
    "stream_telemetry",
    oracle="""
with b as (select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, cast(user_id % 10 as varchar) as DriverNumber, value,
             (epoch_us(ts) // 90000000) * 90000000 as lap_start_us from base),
wm as (select epoch_us(max(ts)) - 180000000 as w from events)
select Year, RoundNumber, DriverNumber, lap_start_us, count(*) as n_samples, avg(value) as avg_value,
  max(value) as max_value, avg(case when value >= 40 then 1.0 else 0.0 end)::double as share_high
from b group by Year, RoundNumber, DriverNumber, lap_start_us
having lap_start_us + 90000000 <= (select w from wm)""",
    doubles=("avg_value", "max_value", "share_high"),
)
def q_stream_telemetry(spark, sf):
    """ST1: windowed per-lap telemetry with a 3-minute watermark, append mode;
    laps still open at the end (watermark not past) are not emitted yet."""
    out, ck = _scratch(spark, "st1-out"), _scratch(spark, "st1-ck")
    ST.run_to_table(ST.lap_telemetry_stream(ST.read_events_stream(spark, _src(sf))), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_ingest",
    oracle="""select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, count(*) as n_events,
  sum(value) as sum_value from base group by Year, RoundNumber""",
    doubles=("sum_value",),
)
def q_stream_ingest(spark, sf):
    """ST2: incremental file ingest into per-race partitions via foreachBatch."""
    out, ck = _scratch(spark, "st2-out"), _scratch(spark, "st2-ck")
    ST.stream_ingest(spark, _src(sf), out, ck)
    t = spark.read.parquet(out)
    return t.groupBy("Year", "RoundNumber").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value"))


@register(
    "stream_latest_weather",
    oracle="""
with l as (select event_id, cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, ts from base),
w as (select Year, RoundNumber, ts, cast(20 as double) + cast(event_id % 100 as double) / 10 as AirTemp,
        cast(30 as double) + cast(event_id % 200 as double) / 10 as TrackTemp, cast(event_id % 7 as double) / 2 as WindSpeed
      from base where event_id % 10 = 3),
j as (select l.event_id, l.Year, l.RoundNumber, l.ts, arg_max(struct_pack(AirTemp := w.AirTemp, TrackTemp := w.TrackTemp,
        WindSpeed := w.WindSpeed), w.ts) as wx
      from l left join w on l.Year = w.Year and l.RoundNumber = w.RoundNumber and w.ts <= l.ts
        and w.ts >= l.ts - interval 10 minutes
      group by l.event_id, l.Year, l.RoundNumber, l.ts),
wm as (select max(ts) - interval 3 minutes as w from w)
select event_id, Year, RoundNumber, epoch_us(ts) as lap_us, wx.AirTemp as AirTemp, wx.TrackTemp as TrackTemp,
  wx.WindSpeed as WindSpeed
from j where (wx is not null and ts < (select w from wm))
   or (wx is null and ts < (select w from wm) - interval 10 minutes)""",
    doubles=("AirTemp", "TrackTemp", "WindSpeed"),
)
def q_stream_latest_weather(spark, sf):
    """ST3: latest weather at or before each lap start within 10 minutes,
    appended once final: the global watermark is the slower input's (weather) latest time minus 3
    minutes; a lap with a reading is final once the watermark passes it, a
    lap without one once the watermark passes it plus the look-back."""
    own = AS.state_session(spark)
    ev = ST.read_events_stream(own, _src(sf))
    laps = ST.read_events_stream(own, _src(sf)).select("event_id", "Year", "RoundNumber", F.col("ts").alias("lap_ts"))
    out, ck = _scratch(spark, "st3-out"), _scratch(spark, "st3-ck")
    ST.run_to_table(ST.latest_weather_stream(laps, ST.weather_stream(ev), slice_us=SLICE_US), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_weather_asof",
    oracle="""
with l as (select event_id, cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, us from base),
w as (select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, us, max(event_id) as id from base where event_id % 10 = 3 group by 1, 2, 3),
wm as (select (least((select max(us) from l), (select max(us) from w)) // 1000 - 180000) * 1000 as passed)
select l.event_id, l.Year, l.RoundNumber, l.us as lap_us, cast(20 as double) + cast(w.id % 100 as double) / 10 as AirTemp,
  cast(30 as double) + cast(w.id % 200 as double) / 10 as TrackTemp, cast(w.id % 7 as double) / 2 as WindSpeed
from l asof left join w on l.Year = w.Year and l.RoundNumber = w.RoundNumber and l.us >= w.us
where l.us <= (select passed from wm)""",
    doubles=("AirTemp", "TrackTemp", "WindSpeed"),
)
def q_stream_weather_asof(spark, sf):
    """ST3 without a look-back limit: every lap that the watermark (slower input's latest time minus 3 minutes) has passed
    takes the latest weather at or before it, however old."""
    own = AS.state_session(spark)
    events = lambda: ST.read_events_stream(own, _src(sf))
    laps = events().select("event_id", "Year", "RoundNumber", "ts")
    weather = ST.weather_stream(events(), "w_id").select(F.col("wYear").alias("Year"), F.col("wRound").alias("RoundNumber"), F.col("w_ts").alias("ts"), "w_id", "AirTemp", "TrackTemp", "WindSpeed")
    out, ck = _scratch(spark, "st3-asof-out"), _scratch(spark, "st3-asof-ck")
    ST.run_to_table(AS.weather_asof_stream(laps, weather, slice_us=SLICE_US), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_lap_telemetry",
    oracle="""
with nx as (select Year, RoundNumber, DriverNumber, LapNumber, lap_start_us,
    lead(lap_start_us) over (partition by Year, RoundNumber, DriverNumber order by LapNumber) as next_us from laps),
wm as (select (least((select max(lap_start_us) from laps), (select max(t_us) from samples)) // 1000 - 180000) * 1000 as passed),
closed as (select * from nx where next_us - 1 <= (select passed from wm))
select c.Year, c.RoundNumber, c.DriverNumber, c.LapNumber, count(*) as n_samples, avg(Speed) as avg_speed_kph, max(Speed) as max_speed_kph,
  avg(Throttle) as avg_throttle_pct, avg(case when Throttle >= 98 then 1.0 else 0.0 end)::double as full_throttle_pct, avg(Brake) as avg_brake,
  avg(case when Brake > 0 then 1.0 else 0.0 end)::double as braking_pct, avg(case when DRS >= 8 then 1.0 else 0.0 end)::double as drs_active_pct,
  avg(RPM) as avg_rpm, avg(nGear)::double as avg_gear
from closed c join samples s on s.Year = c.Year and s.RoundNumber = c.RoundNumber and s.DriverNumber = c.DriverNumber
  and s.t_us >= c.lap_start_us and s.t_us < c.next_us
group by 1, 2, 3, 4 having count(*) >= 5""",
    doubles=AS.LAP_TELEMETRY,
)
def q_stream_lap_telemetry(spark, sf):
    """ST1 by real lap: landed samples and lap starts as two streams; a lap's nine aggregates come out when the watermark
    has passed the next start of its car."""
    own, paths = AS.state_session(spark), {}
    starts = fx.laps(spark, sf).select("Year", "RoundNumber", "DriverNumber", F.timestamp_micros("lap_start_us").alias("ts"), "LapNumber")
    samples = fx.samples(spark, sf).withColumn("ts", F.timestamp_micros("t_us")).drop("t_us")
    for name, df in (("starts", starts), ("samples", samples)):
        paths[name] = _scratch(spark, f"st1-{name}")
        df.write.parquet(paths[name])
    read = lambda name, df: own.readStream.schema(df.schema).parquet(paths[name])
    out, ck = _scratch(spark, "st1-lap-out"), _scratch(spark, "st1-lap-ck")
    ST.run_to_table(AS.lap_telemetry(read("samples", samples), read("starts", starts), slice_us=SLICE_US), out, ck)
    return spark.read.parquet(out)
