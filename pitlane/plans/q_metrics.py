"""Registered queries: audits, exploration, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.operators import metrics as M
from pitlane.plans.store import feature_store
from pitlane.plans.q_laps import FEAT_OUT
from pitlane.plans.registry import register
from pitlane.sources import scan

T = K.TARGET


def scored(spark, sf):
    """Feature table with split, the train-fitted line as ``pred`` and the train
    mean as ``pred_mean``; rows with a null target or position dropped (P6)."""
    df = enc.temporal_split(feature_store(spark, sf)).na.drop(subset=[T, "stint_lap_number"])
    fit = M.fit_line(df.where(F.col("split") == "train"))
    return M.predict_line(df, fit).withColumn("pred_mean", F.lit(fit["ybar"]).cast("double"))


@register(
    "target_stats",
    oracle=f"select count({T}) as n, avg({T}) as mean, stddev_samp({T}) as std, max({T}) as max from feat",
    doubles=("mean", "std", "max"),
)
def q_target_stats(spark, sf):
    """A4: target mean, sample std, max."""
    return M.target_stats(feature_store(spark, sf))


_NULL_COLS = FEAT_OUT


@register(
    "null_rates",
    oracle="select \"column\", null_rate from (unpivot (select "
    + ", ".join(f"avg(case when {c} is null then 1.0 else 0.0 end)::double as {c}" for c in _NULL_COLS)
    + " from feat) on " + ", ".join(_NULL_COLS) + " into name \"column\" value null_rate) "
    + "order by null_rate desc, \"column\" limit 10",
    doubles=("null_rate",),
)
def q_null_rates(spark, sf):
    """A5/L3: top-10 null rates of the feature table."""
    return M.null_rates(feature_store(spark, sf).select(*_NULL_COLS), 10)


@register(
    "filters",
    oracle="""
select field, cast(row_number() over (partition by field order by k) as int) as position, value from (
  select distinct 'Year' as field, cast(Year as varchar) as value, Year as k from feat where Year is not null) a
union all select field, cast(row_number() over (partition by field order by value) as int), value from (
  select distinct 'EventName' as field, EventName as value from feat where EventName is not null) b
union all select field, cast(row_number() over (partition by field order by value) as int), value from (
  select distinct 'Driver' as field, Driver as value from feat where Driver is not null) c
union all select field, cast(row_number() over (partition by field order by value) as int), value from (
  select distinct 'Compound' as field, Compound as value from feat where Compound is not null) d""",
)
def q_filters(spark, sf):
    """Sorted distinct Year, EventName, Driver, Compound (long form)."""
    return M.filter_values(feature_store(spark, sf))


@register(
    "filters_summary",
    oracle="""
select min(Year) as year_min, max(Year) as year_max, cast(count(distinct Year) as int) as n_years,
  cast(count(distinct EventName) as int) as n_circuits, min(EventName) as first_circuit,
  cast(count(distinct Driver) as int) as n_drivers,
  (select string_agg(c, ' ' order by c) from (select distinct Compound as c from feat where Compound is not null) x) as compounds
from feat""",
)
def q_filters_summary(spark, sf):
    """Summary of the filter lists."""
    return M.filters_summary(feature_store(spark, sf))


EXPLORE_SQL = f"""
select {', '.join(K.EXPLORER_COLS)} from feat
where Year = 2024 and Compound = 'MEDIUM' and stint_lap_number is not null and {T} is not null
order by Driver, Stint, stint_lap_number, Year, RoundNumber, LapNumber limit 2000"""
EXPLORE_DBL = ("lap_time_delta_fuel_corrected", "TrackTemp", "AirTemp")


@register("explore", oracle=EXPLORE_SQL, doubles=EXPLORE_DBL)
def q_explore(spark, sf):
    """Explorer columns, year + compound filter, sorted, first 2000."""
    df = scan.explorer_scan(feature_store(spark, sf))
    return M.explore(df, year=2024, compound="MEDIUM", limit=2000)


@register(
    "slice_summary",
    oracle=f"""
with e as (select *, row_number() over (order by Driver, Stint, stint_lap_number, Year, RoundNumber, LapNumber) as pos
           from feat where Driver = 'D3' and stint_lap_number is not null and {T} is not null)
select count(*) as n_rows, avg({T}) as avg_delta, max({T}) as max_delta,
  (select string_agg(EventName, ', ' order by EventName) from (select distinct EventName from e where pos <= 8) x) as sample_events
from (select * from e where pos <= 2000) q""",
    doubles=("avg_delta", "max_delta"),
)
def q_slice_summary(spark, sf):
    """A10: summary of an explorer slice (driver D3)."""
    rows = M.explore(feature_store(spark, sf), driver="D3", limit=2000)
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ("Driver", "Stint", "stint_lap_number", "Year", "RoundNumber", "LapNumber")])
    return M.slice_summary(rows.withColumn("__pos", F.row_number().over(w)))


METRIC_SQL = """
select split, count(*) as n, avg(abs({p} - {y})) as mae, sqrt(avg(({p} - {y}) * ({p} - {y}))) as rmse,
  1 - sum(({p} - {y}) * ({p} - {y})) / (var_pop({y}) * count({y})) as r2
from pred group by split"""


@register("regression_metrics", oracle=METRIC_SQL.format(p="pred", y=T), doubles=("mae", "rmse", "r2"))
def q_regression_metrics(spark, sf):
    """MAE, RMSE, R^2 per split of the train-fitted line."""
    return M.regression_metrics(scored(spark, sf), by=["split"])


@register(
    "tolerance_bias",
    oracle=f"""
with per as (select split, avg(abs(pred - {T})) as mae, sqrt(avg((pred - {T}) * (pred - {T}))) as rmse,
  avg(case when abs(pred - {T}) < 0.3 then 1.0 else 0.0 end)::double as within_tight,
  avg(case when abs(pred - {T}) < 0.5 then 1.0 else 0.0 end)::double as within_loose,
  avg(case when pred - {T} > 0 then 1.0 else 0.0 end)::double as over,
  avg(case when pred - {T} < 0 then 1.0 else 0.0 end)::double as under
  from pred group by split)
select *, mae - (select mae from per where split = 'train') as gap_mae from per""",
    doubles=("mae", "rmse", "within_tight", "within_loose", "over", "under", "gap_mae"),
)
def q_tolerance_bias(spark, sf):
    """Tolerance shares, bias shares and the val - train MAE gap."""
    return M.tolerance_bias(scored(spark, sf))


@register(
    "gain",
    oracle=f"""
select avg(abs(pred_mean - {T})) as baseline_mae, avg(abs(pred - {T})) as model_mae,
  (avg(abs(pred_mean - {T})) - avg(abs(pred - {T}))) / avg(abs(pred_mean - {T})) * 100 as gain_pct,
  (avg(abs(pred_mean - {T})) - avg(abs(pred - {T}))) / avg(abs(pred_mean - {T})) * 100 < 15 as below_bar
from pred where split = 'test'""",
    doubles=("baseline_mae", "model_mae", "gain_pct"),
)
def q_gain(spark, sf):
    """Gain of the line over the train-mean baseline, both on test."""
    t = scored(spark, sf).where(F.col("split") == "test")
    m = t.agg(F.avg(F.abs(F.col("pred_mean") - F.col(T))).alias("baseline_mae"),
              F.avg(F.abs(F.col("pred") - F.col(T))).alias("model_mae"))
    pct, flag = M.gain(F.col("baseline_mae"), F.col("model_mae"))
    return m.select("baseline_mae", "model_mae", pct.alias("gain_pct"), flag.alias("below_bar"))


@register(
    "best_model",
    oracle=f"""
with m as (select split, 'line' as model, avg(abs(pred - {T})) as mae from pred group by split
           union all select split, 'mean' as model, avg(abs(pred_mean - {T})) as mae from pred group by split)
select split, arg_min(model, (mae, model)) as best_model, min(mae) as best_mae from m group by split""",
    doubles=("best_mae",),
)
def q_best_model(spark, sf):
    """Lower MAE wins, per split."""
    s = scored(spark, sf)
    a = s.groupBy("split").agg(F.avg(F.abs(F.col("pred") - F.col(T))).alias("mae")).withColumn("model", F.lit("line"))
    b = s.groupBy("split").agg(F.avg(F.abs(F.col("pred_mean") - F.col(T))).alias("mae")).withColumn("model", F.lit("mean"))
    return M.best_model(a.unionByName(b))


@register(
    "residual_box",
    oracle=f"""
with r as (select coalesce(Compound, 'UNKNOWN') as Compound, pred - {T} as r from pred where split = 'test'),
q as (select Compound, quantile_cont(r, 0.25) as q1, quantile_cont(r, 0.5) as median, quantile_cont(r, 0.75) as q3
      from r group by Compound)
select r.Compound, q1, median, q3, count(*) as n,
  min(case when r >= q1 - 1.5 * (q3 - q1) then r end) as whisker_low,
  max(case when r <= q3 + 1.5 * (q3 - q1) then r end) as whisker_high
from r join q on r.Compound = q.Compound group by r.Compound, q1, median, q3""",
    doubles=("q1", "median", "q3", "whisker_low", "whisker_high"),
)
def q_residual_box(spark, sf):
    """Residual box statistics per compound on test."""
    return M.residual_box(scored(spark, sf).where(F.col("split") == "test"))


@register(
    "residual_hist",
    oracle=f"""
with r as (select pred - {T} as r from pred where split = 'test'),
mm as (select min(r) as lo, max(r) as hi from r)
select cast(least(79, floor((r - lo) / (hi - lo) * 80)) as int) as bin,
  lo + least(79, floor((r - lo) / (hi - lo) * 80)) * ((hi - lo) / 80) as lo,
  lo + (least(79, floor((r - lo) / (hi - lo) * 80)) + 1) * ((hi - lo) / 80) as hi, count(*) as n
from r, mm group by 1, 2, 3""",
    doubles=("lo", "hi"),
)
def q_residual_hist(spark, sf):
    """80-bin residual histogram on test."""
    return M.residual_hist(scored(spark, sf).where(F.col("split") == "test"))


@register(
    "pred_actual_limits",
    oracle=f"""select least(min({T}), min(pred)) as lim_low, greatest(max({T}), max(pred)) as lim_high,
  count(*) as n_points from pred where split = 'test'""",
    doubles=("lim_low", "lim_high"),
)
def q_pred_actual_limits(spark, sf):
    """Predicted-vs-actual axis limits on test."""
    return M.axis_limits(scored(spark, sf).where(F.col("split") == "test"))


@register(
    "pred_actual_points",
    oracle=f"select coalesce(Compound, 'UNKNOWN') as Compound, {T} as actual, pred as predicted from pred where split = 'test'",
    doubles=("actual", "predicted"),
)
def q_pred_actual_points(spark, sf):
    """The points of the predicted-vs-actual chart on test."""
    return M.pred_actual_points(scored(spark, sf).where(F.col("split") == "test"))


@register(
    "split_counts",
    oracle=f"select split, count(*) as n_rows, {len(K.MODEL_FEATURES)} as n_features from featsplit group by split",
)
def q_split_counts(spark, sf):
    """Rows per split and matrix width."""
    return M.split_counts(enc.temporal_split(feature_store(spark, sf)), len(K.MODEL_FEATURES))


@register(
    "risk_band",
    oracle="""select Year, RoundNumber, Driver, LapNumber, round(pred, 4) as predicted_delta,
  case when round(pred, 4) < 0.1 then 'NOMINAL' when round(pred, 4) < 0.3 then 'DEGRADING' else 'CLIFF RISK' end as band
from pred where split = 'test'""",
    doubles=("predicted_delta",),
)
def q_risk_band(spark, sf):
    """Risk band of each rounded predicted delta on test."""
    from pitlane.functions.scalar import risk_band, round4
    t = scored(spark, sf).where(F.col("split") == "test").withColumn("predicted_delta", round4("pred"))
    return t.select("Year", "RoundNumber", "Driver", "LapNumber", "predicted_delta", risk_band("predicted_delta").alias("band"))


@register(
    "sample_rows",
    oracle=f"""select event_id, Year, RoundNumber, Driver, LapNumber, {T} from pred where split = 'test'
order by (event_id * 7919 + 42) % 10007, event_id limit 2000""",
    doubles=(T,),
)
def q_sample_rows(spark, sf):
    """L4: seeded sample of min(2000, n) test rows (modular hash key, repeatable in SQL)."""
    t = scored(spark, sf).where(F.col("split") == "test")
    key = (F.col("event_id") * 7919 + 42) % 10007
    return M.seeded_sample(t.select("event_id", "Year", "RoundNumber", "Driver", "LapNumber", T), 2000, key)
