"""Registered queries: nested JSON sources, JSON records, writes and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.operators import quality as qual
from pitlane.plans.registry import register
from pitlane.session import checkpoint_dir
from pitlane.sources import fixtures as fx
from pitlane.sources import nested, scan


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register(
    "circuits_flat",
    oracle="""
select lower(n_name) as circuit_id, n_name || ' circuit' as circuit_name,
  case when n_nationkey % 6 = 0 then null else r_name end as locality,
  case when n_nationkey % 6 = 0 then null else n_name end as country,
  case when n_nationkey % 6 = 0 or n_nationkey % 4 = 0 then cast(0 as double) else cast(n_nationkey * 1.5 as double) end as lat,
  case when n_nationkey % 6 = 0 then cast(0 as double) else cast(n_regionkey * -2.25 as double) end as lon
from nation left join region on n_regionkey = r_regionkey""",
    doubles=("lat", "lon"),
)
def q_circuits_flat(spark, sf):
    """Nested circuit pages -> flat rows, lat/lon parsed with default 0."""
    pages = nested.circuit_pages(fx.table(spark, sf, "nation"), fx.table(spark, sf, "region"))
    return nested.flatten_circuits(nested.parse_pages(pages, "json", nested.CIRCUIT_PAGE))


@register(
    "drivers_first_season",
    oracle="""
with cy as (select distinct o_custkey, year(o_orderdate) as season from orders),
f as (select o_custkey, min(season) as first_season from cy group by o_custkey)
select 'cust' || cast(c_custkey as varchar) as driver_id, upper(right(c_name, 3)) as driver_code, c_name as given_name,
  c_mktsegment as family_name, cast(c_nationkey as varchar) as nationality,
  case when c_custkey % 5 = 0 then null else cast(c_custkey % 100 + first_season % 10 as varchar) end as permanent_number,
  cast(first_season as int) as first_season
from f join customer on c_custkey = o_custkey""",
)
def q_drivers_first_season(spark, sf):
    """Season driver pages flattened; first season wins per driver."""
    pages = nested.driver_pages(fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer"))
    return nested.flatten_drivers(nested.parse_pages(pages, "json", nested.DRIVER_PAGE))


@register(
    "race_results_flat",
    oracle="""
select cast(year(o_orderdate) as int) as year,
  case when o_orderkey % 13 = 0 then 0 else cast(o_orderkey as int) end as round,
  o_orderstatus as circuit_id, 'd' || cast(l_suppkey as varchar) as driver_id,
  'c' || cast(l_partkey % 10 as varchar) as constructor_id, l_linenumber as grid,
  case when l_linenumber % 3 = 0 then null else cast(l_linenumber as varchar) end as position,
  case when l_linenumber % 4 = 0 then cast(0 as double) else l_quantity end as points,
  l_returnflag as status
from orders join lineitem on l_orderkey = o_orderkey""",
    doubles=("points",),
)
def q_race_results_flat(spark, sf):
    """Races[] -> Results[] pages flattened; int/double parsed with default 0."""
    pages = nested.result_pages(fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem"))
    return nested.flatten_results(nested.parse_pages(pages, "json", nested.RESULTS_PAGE))


@register(
    "json_scalar",
    oracle="select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) as k from events",
)
def q_json_scalar(spark, sf):
    """scalar from a JSON string column with a default."""
    ev = fx.table(spark, sf, "events")
    return ev.select("event_id", nested.json_scalar("props", "$.k", -1).alias("k"))


API_LAP_SCHEMA = T.StructType([
    T.StructField("session_key", T.IntegerType()), T.StructField("driver_number", T.IntegerType()),
    T.StructField("lap_number", T.IntegerType()), T.StructField("date_start", T.StringType()),
])


@register(
    "api_laps_records",
    oracle="""
select Year * 100 + RoundNumber as session_key, cast(DriverNumber as int) as driver_number, LapNumber as lap_number,
  lap_start_us as date_start_us
from laps where event_id % 17 <> 0""",
)
def q_api_laps_records(spark, sf):
    """JSON lap records; ISO UTC timestamps parsed, bad ones dropped."""
    lp = fx.laps(spark, sf)
    iso = F.concat(F.date_format(F.timestamp_micros("lap_start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    text = lp.select(F.to_json(F.struct(
        (F.col("Year") * 100 + F.col("RoundNumber")).alias("session_key"),
        F.col("DriverNumber").cast("int").alias("driver_number"),
        F.col("LapNumber").alias("lap_number"),
        F.when(F.col("event_id") % 17 == 0, F.lit("not-a-date")).otherwise(iso).alias("date_start"),
    )).alias("json"))
    rec = text.select(F.from_json("json", API_LAP_SCHEMA).alias("r")).select("r.*")
    rec = rec.withColumn("date_start", F.try_to_timestamp(F.col("date_start"))).where(F.col("date_start").isNotNull())
    return rec.select("session_key", "driver_number", "lap_number", F.unix_micros("date_start").alias("date_start_us"))


@register(
    "race_files_roundtrip",
    oracle="""select event_id, Year, RoundNumber, Driver, LapNumber, LapTime from clean""",
    doubles=("LapTime",),
)
def q_race_files_roundtrip(spark, sf):
    """Cleaned laps written one partition per race, then read back."""
    out = scratch(spark, "laps-by-race")
    scan.write_by_race(qual.clean_laps(fx.laps(spark, sf)).select(
        "event_id", "Year", "RoundNumber", "Driver", "LapNumber", "LapTime"), out)
    return scan.read_laps(spark, out).select("event_id", "Year", "RoundNumber", "Driver", "LapNumber", "LapTime")


@register(
    "incremental_targets",
    oracle="""
select Year, RoundNumber, EventName, printf('%d_R%02d', Year, RoundNumber) as file_key from schedule
where EventFormat in ('conventional', 'sprint', 'sprint_qualifying')
  and (Year, RoundNumber) not in (select distinct Year, RoundNumber from laps where RoundNumber <= 4)""",
)
def q_incremental_targets(spark, sf):
    """Races to ingest = kept schedule minus races already written."""
    from pitlane.functions.scalar import file_key

    out = scratch(spark, "ingested")
    lp = fx.laps(spark, sf)
    scan.write_by_race(lp.where(F.col("RoundNumber") <= 4).select("Year", "RoundNumber", "LapNumber"), out)
    wanted = scan.schedule_races(fx.schedule(spark, sf))
    todo = scan.incremental_targets(wanted, scan.written_races(spark, out))
    return todo.select("Year", "RoundNumber", "EventName", file_key("Year", "RoundNumber").alias("file_key"))
