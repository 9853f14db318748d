"""DuckDB text of the fixture views, for the oracle queries.

These are the FIXTURES.md part B views in DuckDB dialect. ``with_views``
puts the views a query needs (and what they depend on) in front of it as a
``WITH`` prefix, since only the parquet tables are registered in the oracle.
"""

from __future__ import annotations

import re

# view name -> (dependencies, DuckDB SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql.strip())


view("idx", (), "select range as i from range(8)")

view("base", (), """
select event_id, user_id, event_type, value, epoch_us(ts) as us, ts, day(ts) as d,
  case when day(ts) <= 8 then 2023 when day(ts) <= 14 then 2024 else 2025 end as Year,
  case when day(ts) <= 8 then day(ts) when day(ts) <= 14 then day(ts) - 8 else day(ts) - 14 end as RoundNumber
from events""")

view("laps", ("base",), """
select event_id, cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber,
  concat('GP', cast(RoundNumber as varchar)) as EventName, Driver, DriverNumber,
  concat('T', cast(user_id % 5 as varchar)) as Team,
  cast(ln as int) as LapNumber,
  case when event_id % 97 = 0 then null else cast(floor((ln - 1) / 12) + 1 as int) end as Stint,
  cast((ln - 1) % 12 + 1 as int) as TyreLife,
  case when event_id % 37 = 0 then null else cast(80 as double) + value / 4 end as LapTime,
  case when event_id % 67 = 0 then null else cast(25 as double) + value / 16 end as Sector1Time,
  cast(30 as double) + value / 8 as Sector2Time, cast(25 as double) + value / 16 as Sector3Time,
  case (cast(floor((ln - 1) / 12) as int) + user_id) % 4 when 0 then 'SOFT' when 1 then 'MEDIUM' when 2 then 'HARD'
    else case when user_id % 3 = 0 then null else 'INTERMEDIATE' end end as Compound,
  case when event_id % 41 = 0 then '14' when event_id % 43 = 0 then '6' when event_id % 29 = 0 then '12'
    when event_id % 31 = 0 then null else '1' end as TrackStatus,
  case when event_id % 71 = 0 then null else cast(us % 86400000000 as double) / cast(1000000 as double) end as LapStartTime,
  us as lap_start_us,
  case when (ln - 1) % 12 = 11 then cast(1 as double) end as PitInTime,
  case when (ln - 1) % 12 = 0 and ln > 1 then cast(1 as double) end as PitOutTime,
  case when event_id % 53 = 0 then true when event_id % 59 = 0 then null else false end as Rainfall,
  case when event_id % 23 = 0 then false when event_id % 61 = 0 then null else true end as IsAccurate
from (
  select *, cast(user_id % 10 as varchar) as DriverNumber, concat('D', cast(user_id % 10 as varchar)) as Driver,
    row_number() over (partition by Year, RoundNumber, user_id % 10 order by us, event_id) as ln
  from base) c""")

view("weather", ("base",), """
select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber,
  cast(us % 86400000000 as double) / cast(1000000 as double) as Time,
  cast(20 as double) + cast(event_id % 100 as double) / 10 as AirTemp,
  cast(30 as double) + cast(event_id % 200 as double) / 10 as TrackTemp,
  event_id % 53 = 0 as Rainfall, cast(event_id % 7 as double) / 2 as WindSpeed
from base where event_id % 10 = 3""")

view("samples", ("laps", "idx"), """
select Year, RoundNumber, DriverNumber,
  us0 + cast(floor(coalesce(us1 - us0, 240000000) * i / 8) as bigint) as t_us,
  cast(100 + (event_id * 7 + i * 31) % 220 as double) as Speed,
  case when (event_id + i) % 19 = 0 then null else cast((event_id * 13 + i * 17) % 101 as double) end as Throttle,
  cast(case when (event_id + i) % 5 = 0 then 100 else 0 end as double) as Brake,
  cast((event_id + i) % 15 as int) as DRS,
  cast(9000 + (event_id * 11 + i * 97) % 3500 as double) as RPM,
  cast(1 + (event_id + i) % 8 as int) as nGear
from (
  select l.Year, l.RoundNumber, l.DriverNumber, l.event_id, l.lap_start_us as us0, idx.i,
    lead(l.lap_start_us) over (partition by l.Year, l.RoundNumber, l.DriverNumber, idx.i order by l.LapNumber) as us1
  from laps l cross join idx) n
where i < 4 + event_id % 5""")

view("schedule", ("base",), """
select Year, RoundNumber, concat('GP', cast(RoundNumber as varchar)) as EventName,
  case when RoundNumber % 5 = 0 then 'testing' when RoundNumber % 5 = 1 then 'sprint'
       when RoundNumber % 5 = 2 then 'sprint_qualifying' else 'conventional' end as EventFormat,
  concat('C', cast(RoundNumber % 7 as varchar)) as Country,
  concat('L', cast(RoundNumber as varchar)) as Location,
  case when RoundNumber % 3 = 0 then null else concat('Official GP', cast(RoundNumber as varchar)) end as OfficialEventName
from (select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber from base group by 1, 2) r""")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    """``WITH`` prefix of the named views (and their dependencies) + ``body``.

    ``names`` may be omitted: the views referenced as whole words in ``body``
    are found by name.
    """
    if not names:
        names = tuple(n for n in VIEWS if re.search(rf"\b{n}\b", body))
    order = _order(list(names))
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} as (\n{VIEWS[n][1]}\n)" for n in order)
    b = body.strip()
    if b[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{b[15:]}"
    if b[:5].lower() == "with ":
        return f"with {ctes},\n{b[5:]}"
    return f"with {ctes}\n{b}"


# --- derived views (the library's operators, in DuckDB) ---------------------

view("clean", ("laps",), """
select * from laps
where LapTime is not null and not coalesce(LapTime > 150, false)
  and PitOutTime is null and PitInTime is null
  and not contains(coalesce(TrackStatus, ''), '4') and not contains(coalesce(TrackStatus, ''), '6')
  and not contains(coalesce(TrackStatus, ''), '2')
  and not coalesce(Rainfall, false) and IsAccurate is distinct from false""")

view("lapsw", ("laps", "weather"), """
select l.*,
  case when b.Time is null then f.AirTemp when f.Time is null then b.AirTemp
       when l.LapStartTime - b.Time <= f.Time - l.LapStartTime then b.AirTemp else f.AirTemp end as AirTemp,
  case when b.Time is null then f.TrackTemp when f.Time is null then b.TrackTemp
       when l.LapStartTime - b.Time <= f.Time - l.LapStartTime then b.TrackTemp else f.TrackTemp end as TrackTemp,
  case when b.Time is null then f.WindSpeed when f.Time is null then b.WindSpeed
       when l.LapStartTime - b.Time <= f.Time - l.LapStartTime then b.WindSpeed else f.WindSpeed end as WindSpeed
from laps l
asof left join weather b on l.Year = b.Year and l.RoundNumber = b.RoundNumber and l.LapStartTime >= b.Time
asof left join weather f on l.Year = f.Year and l.RoundNumber = f.RoundNumber and l.LapStartTime <= f.Time
where l.LapStartTime is not null
   or not exists (select 1 from weather w where w.Year = l.Year and w.RoundNumber = l.RoundNumber)""")

view("cleanw", ("lapsw",), """
select * from lapsw
where LapTime is not null and not coalesce(LapTime > 150, false)
  and PitOutTime is null and PitInTime is null
  and not contains(coalesce(TrackStatus, ''), '4') and not contains(coalesce(TrackStatus, ''), '6')
  and not contains(coalesce(TrackStatus, ''), '2')
  and not coalesce(Rainfall, false) and IsAccurate is distinct from false""")

view("lapx", ("laps",), """
select Year, RoundNumber, DriverNumber, LapNumber, EventName, Driver, Stint, Compound, lap_start_us as s,
  coalesce(lead(lap_start_us) over (partition by Year, RoundNumber, DriverNumber order by lap_start_us, LapNumber),
           lap_start_us + 180000000) as e
from laps where lap_start_us is not null""")

view("assigned", ("samples", "lapx"), """
select s.*, l.LapNumber, l.EventName, l.Driver, l.Stint, l.Compound
from samples s join lapx l
  on s.Year = l.Year and s.RoundNumber = l.RoundNumber and s.DriverNumber = l.DriverNumber
 and s.t_us >= l.s and s.t_us < l.e""")

view("tel", ("assigned",), """
select Year, RoundNumber, EventName, Driver, DriverNumber, LapNumber, Stint, Compound,
  avg(Speed) as avg_speed_kph, max(Speed) as max_speed_kph, avg(Throttle) as avg_throttle_pct,
  avg(case when Throttle >= 98 then cast(1 as double) else cast(0 as double) end) as full_throttle_pct,
  avg(Brake) as avg_brake,
  avg(case when Brake > 0 then cast(1 as double) else cast(0 as double) end) as braking_pct,
  avg(case when DRS >= 8 then cast(1 as double) else cast(0 as double) end) as drs_active_pct,
  avg(RPM) as avg_rpm, avg(nGear) as avg_gear
from assigned
group by Year, RoundNumber, EventName, Driver, DriverNumber, LapNumber, Stint, Compound
having count(*) >= 5""")

view("joined", ("cleanw", "tel"), """
select c.*, t.avg_throttle_pct, t.full_throttle_pct, t.avg_brake, t.braking_pct, t.max_speed_kph,
  t.avg_speed_kph, t.drs_active_pct, t.avg_rpm
from cleanw c left join tel t
  on c.Year = t.Year and c.RoundNumber = t.RoundNumber and c.DriverNumber = t.DriverNumber and c.LapNumber = t.LapNumber""")

FUEL_SQL = """
select *, case when x < 0 then cast(0 as double) else x end as fuel_load_kg
from (select *, max(LapNumber) over (partition by Year, RoundNumber) * cast(1.88 as double)
                - LapNumber * cast(1.88 as double) as x from {src}) q"""

TARGET_SQL = """
select * exclude (x, lap1), lap_time_corrected - lap1 as lap_time_delta_fuel_corrected,
  case when Stint is not null and Driver is not null then
    row_number() over (partition by Year, RoundNumber, Driver, Stint order by LapNumber) - 1 end as stint_lap_number
from (select *, case when Stint is not null and Driver is not null then
        first(lap_time_corrected ignore nulls) over (partition by Year, RoundNumber, Driver, Stint order by LapNumber
          rows between unbounded preceding and unbounded following) end as lap1
      from (select *, LapTime + fuel_load_kg * cast(0.035 as double) as lap_time_corrected from fuel_{src}) a) b"""

ROLL_SQL = """
select *, case when Stint is not null and Driver is not null then
    rate - lag(rate) over (partition by Year, RoundNumber, Driver, Stint order by LapNumber) end as deg_acceleration
from (select *, case when Stint is not null and Driver is not null then
        avg(lap_time_delta_fuel_corrected) over (partition by Year, RoundNumber, Driver, Stint order by LapNumber
          rows between 2 preceding and current row) end as rate
      from tgt_{src}) r"""

EVO_SQL = """
select * exclude (rate), rate as deg_rate_last_3,
  row_number() over (partition by Year, RoundNumber order by LapNumber, Driver) as track_evolution
from roll_{src}"""

for _src, _dep in (("clean", "clean"), ("joined", "joined")):
    view(f"fuel_{_src}", (_dep,), FUEL_SQL.format(src=_src))
    view(f"tgt_{_src}", (f"fuel_{_src}",), TARGET_SQL.format(src=_src))
    view(f"roll_{_src}", (f"tgt_{_src}",), ROLL_SQL.format(src=_src))
    view(f"evo_{_src}", (f"roll_{_src}",), EVO_SQL.format(src=_src))

# the full feature table
view("feat", ("evo_joined",), "select * from evo_joined")

# --- splits and encoders -------------------------------------------------------

view("featsplit", ("feat",), """
select *, case when Year <= 2024 then 'train' when Year = 2025 and RoundNumber <= 10 then 'val'
  when Year = 2025 and RoundNumber > 10 then 'test' end as split
from feat""")

view("vocab", ("featsplit",), """
select c, cast(row_number() over (order by c) - 1 as int) as code
from (select distinct Compound as c from featsplit where split = 'train' and Compound is not null
      union select 'UNKNOWN') x""")

view("tdf", ("featsplit", "vocab"), """
select f.*, Sector1Time / nullif(LapTime, 0) as sector_1_pct, Sector2Time / nullif(LapTime, 0) as sector_2_pct,
  Sector3Time / nullif(LapTime, 0) as sector_3_pct,
  coalesce(v.code, (select code from vocab where c = 'UNKNOWN')) as compound_encoded
from featsplit f
left join vocab v on v.c = coalesce(f.Compound, 'UNKNOWN')""")

view("tlf", ("featsplit",), """
select f.*, Sector1Time / nullif(LapTime, 0) as sector_1_pct, Sector2Time / nullif(LapTime, 0) as sector_2_pct,
  Sector3Time / nullif(LapTime, 0) as sector_3_pct,
  cast(case upper(coalesce(Compound, 'UNKNOWN')) when 'HARD' then 0 when 'INTERMEDIATE' then 1 when 'MEDIUM' then 2
    when 'SOFT' then 3 when 'WET' then 4 when 'UNKNOWN' then 2 else 2 end as int) as compound_encoded
from featsplit f""")

# --- predictions for the metric checks ----------------------------------------------

view("fit", ("featsplit",), """
select regr_intercept(lap_time_delta_fuel_corrected, stint_lap_number) as a,
  regr_slope(lap_time_delta_fuel_corrected, stint_lap_number) as b,
  avg(lap_time_delta_fuel_corrected) as ybar
from featsplit where split = 'train'""")

view("pred", ("featsplit", "fit"), """
select f.*, fit.a + fit.b * f.stint_lap_number as pred, fit.ybar as pred_mean
from featsplit f, fit
where f.lap_time_delta_fuel_corrected is not null and f.stint_lap_number is not null""")
