"""Registered queries: models, search, importance, scoring, curves, metric files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.operators import metrics as M
from pitlane.plans import models as ML
from pitlane.plans.registry import register
from pitlane.plans.store import feature_store, stored_once
from pitlane.session import checkpoint_dir

T = K.TARGET


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def frame(spark, sf):
    df, feats = ML.training_frame(feature_store(spark, sf))
    return df, feats


def _metric_rows(pred_df, model_name):
    return M.regression_metrics(pred_df, by=["split"]).withColumn("model", F.lit(model_name))


@register("huber_baseline")
def q_huber_baseline(spark, sf):
    """Huber baseline fit on train, saved, loaded, scored per split."""
    df, _ = frame(spark, sf)
    model, feats = ML.huber_baseline(df.where(F.col("split") == "train"))
    path = _scratch(spark, "huber-baseline")
    ML.save_linear(model, path)
    loaded = ML.load_linear(path)
    return _metric_rows(loaded.transform(ML.assemble(df, feats)), "huber_baseline")


def fitted(spark, sf):
    """The boosted model of a data folder: fitted once per application with the default parameters (early stopping on
    val, metrics every 5 rounds), saved, and loaded by every query that needs it (S15). Returns (model, its folder)."""

    def fit(path):
        df, feats = frame(spark, sf)
        train, val = (df.where(F.col("split") == s) for s in ("train", "val"))
        m = ML.boosted_huber(train, val, feats, ML.BoostParams(), log_every=5, monitor=val)
        ML.save_boosted(m, f"{path}/model")
        spark.createDataFrame([tuple(r[c] for c in STAGED) for r in m.staged], STAGED_SCHEMA).write.mode("overwrite").parquet(f"{path}/staged")

    path = stored_once(spark, sf, "boosted", fit)
    return ML.load_boosted(f"{path}/model"), path


STAGED = ["round", "split", "mae", "rmse", "within_tight", "within_loose", "over", "under"]
STAGED_SCHEMA = "round int, split string, " + ", ".join(f"{c} double" for c in STAGED[2:])


@register("boosted_huber")
def q_boosted_huber(spark, sf):
    """M2: boosted trees on the Huber loss, early stopping on val, metrics per split."""
    df, feats = frame(spark, sf)
    m, _ = fitted(spark, sf)
    return _metric_rows(m.predict(ML.assemble(df, feats)), "boosted_huber").withColumn(
        "n_trees", F.lit(len(m.trees)))


def searched(spark, sf):
    """The trials of the full search (50 trials, nine ranges, up to 100 rounds), run once per application."""

    def search(path):
        df, feats = frame(spark, sf)
        ML.param_search(df.where(F.col("split") == "train"), df.where(F.col("split") == "val"), feats).write.mode("overwrite").parquet(f"{path}/trials")

    return spark.read.parquet(f"{stored_once(spark, sf, 'search', search)}/trials")


@register("param_search")
def q_param_search(spark, sf):
    """M3: the default search over the nine ranges, validation MAE per trial."""
    return searched(spark, sf)


@register("train_pipeline")
def q_train_pipeline(spark, sf):
    """Search, final fit on train + val, baseline and model on the same test rows, gain, saved model and metrics."""
    df, feats = frame(spark, sf)
    return ML.train_pipeline(df, feats, _scratch(spark, "metrics"), _scratch(spark, "boosted"), trials=searched(spark, sf))


@register("staged_metrics")
def q_staged_metrics(spark, sf):
    """Train and val tolerance/bias metrics every 5 boosting rounds."""
    out = spark.read.parquet(f"{fitted(spark, sf)[1]}/staged").withColumn("split", F.when(F.col("split") == "monitor", "val").otherwise(F.col("split")))
    tr = out.where(F.col("split") == "train").select("round", F.col("mae").alias("__tr"))
    return out.join(tr, "round").withColumn("gap_mae", F.col("mae") - F.col("__tr")).drop("__tr")


@register("importance")
def q_importance(spark, sf):
    """Top-3 features of the boosted model (split importance)."""
    return ML.tree_importance(fitted(spark, sf)[0], top=3)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """MAE increase per permuted feature of the baseline on all test rows."""
    df, _ = frame(spark, sf)
    model, feats = ML.huber_baseline(df.where(F.col("split") == "train"))
    return ML.permutation_importance(lambda d: model.transform(ML.assemble(d, feats)),
                                     df.where(F.col("split") == "test"), feats)


@register("linear_attribution")
def q_linear_attribution(spark, sf):
    """A24 (linear): mean |coef * (x - mean x)| per baseline feature on test."""
    df, _ = frame(spark, sf)
    model, feats = ML.huber_baseline(df.where(F.col("split") == "train"))
    return ML.linear_attribution(model, df.where(F.col("split") == "test"), feats)


@register(
    "linear_attribution_line",
    oracle=f"""
with tr as (select * from featsplit where split = 'train' and {T} is not null and stint_lap_number is not null),
f1 as (select regr_intercept({T}, stint_lap_number) as a, regr_slope({T}, stint_lap_number) as b from tr),
e1 as (select tr.*, {T} - (a + b * stint_lap_number) as e1 from tr, f1),
f2 as (select coalesce(regr_slope(e1, deg_rate_last_3), 0) as br from e1),
e2 as (select e1.*, e1 - br * deg_rate_last_3 as e2 from e1, f2),
f3 as (select coalesce(regr_slope(e2, deg_acceleration), 0) as ba from e2),
te as (select coalesce(stint_lap_number, 0)::double as x1, coalesce(deg_rate_last_3, 0)::double as x2, coalesce(deg_acceleration, 0)::double as x3
       from featsplit where split = 'test'),
mn as (select avg(x1) as m1, avg(x2) as m2, avg(x3) as m3 from te)
select 'stint_lap_number' as feature, avg(abs(b * (x1 - m1))) as mean_abs_attribution from te, mn, f1
union all select 'deg_rate_last_3', avg(abs(br * (x2 - m2))) from te, mn, f2
union all select 'deg_acceleration', avg(abs(ba * (x3 - m3))) from te, mn, f3""",
    doubles=("mean_abs_attribution",),
)
def q_linear_attribution_line(spark, sf):
    """A24 (linear) with the closed-form line of three features: mean |coef * (x - mean x)| on test."""
    df = enc.temporal_split(feature_store(spark, sf))
    model = ML.fit_linear_curve(df.where(F.col("split") == "train"))
    return ML.linear_attribution(model, df.where(F.col("split") == "test"), model.features)


def scenarios(df):
    """One scenario per compound: the mean test-split features (P11 fills the rest)."""
    feats = [c for c in K.MODEL_FEATURES if c in df.columns and c not in ("compound_encoded",)]
    t = df.where(F.col("split") == "test")
    return t.groupBy(F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("scenario")).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in feats if c not in ("fuel_load_kg",)]
    ).withColumn("Compound", F.col("scenario"))


@register("score")
def q_score(spark, sf):
    """Batch scoring of per-compound scenarios with the baseline."""
    from pitlane.functions.scalar import risk_band
    df, _ = frame(spark, sf)
    model, feats = ML.huber_baseline(df.where(F.col("split") == "train"))
    out = ML.score(model.transform, scenarios(df), feats)
    return out.select("scenario", "predicted_delta", risk_band("predicted_delta").alias("band"))


@register("score_curve")
def q_score_curve(spark, sf):
    """C2 (tree): 30-lap recursive curves per compound scenario; the model has the rolling features as well, taken from
    its own predictions, and scores each lap of all scenarios of an Arrow batch side by side."""
    df, _ = frame(spark, sf)
    feats = [c for c in K.MODEL_FEATURES if c in df.columns]
    m = ML.boosted_huber(df.where(F.col("split") == "train"), None, feats, ML.BoostParams(early_stopping=0))
    return ML.curve_boosted(m, scenarios(df), n_laps=30)


CURVE_SQL = f"""
with recursive tr as (select * from featsplit where split = 'train' and {T} is not null and stint_lap_number is not null),
f1 as (select regr_intercept({T}, stint_lap_number) as a, regr_slope({T}, stint_lap_number) as b from tr),
e1 as (select tr.*, {T} - (a + b * stint_lap_number) as e1 from tr, f1),
f2 as (select coalesce(regr_slope(e1, deg_rate_last_3), 0) as br from e1),
e2 as (select e1.*, e1 - br * deg_rate_last_3 as e2 from e1, f2),
f3 as (select coalesce(regr_slope(e2, deg_acceleration), 0) as ba from e2),
m as (select a, b, br, ba from f1, f2, f3),
sc as (select distinct coalesce(Compound, 'UNKNOWN') as scenario from featsplit where split = 'test'),
rec as (
  select scenario, 0 as t, cast([] as double[]) as hist from sc
  union all
  select scenario, t + 1, list_append(hist, a + b * t + br * rate + ba * acc) from (
    select rec.*, m.*, rate, case when len(hist) = 0 then 0 when len(hist) >= 2
        then rate - list_avg(list_slice(hist, greatest(1, len(hist) - 3), len(hist) - 1)) else rate end as acc
    from rec, m, lateral (select case when len(hist) = 0 then 0
        else list_avg(list_slice(hist, greatest(1, len(hist) - 2), len(hist))) end as rate) r
  ) q where t < 30)
select scenario, cast(unnest(range(len(hist))) as int) as lap, round(unnest(hist), 4) as predicted_delta
from rec where t = 30"""


ANSWERS_SQL = CURVE_SQL.split("sc as (select")[0] + """rq as (
  select cast(Year as int) as Year, cast(RoundNumber as int) as RoundNumber, Driver, Stint, list(stint_lap_number::double order by stint_lap_number) as x
  from featsplit where split = 'val' and Stint is not null group by 1, 2, 3, 4),
rec as (
  select rq.*, 0 as t, cast([] as double[]) as hist from rq
  union all
  select Year, RoundNumber, Driver, Stint, x, t + 1, list_append(hist, a + b * x[t + 1] + br * rate + ba * acc) from (
    select rec.*, m.*, rate, case when len(hist) = 0 then 0 when len(hist) >= 2
        then rate - list_avg(list_slice(hist, greatest(1, len(hist) - 3), len(hist) - 1)) else rate end as acc
    from rec, m, lateral (select case when len(hist) = 0 then 0
        else list_avg(list_slice(hist, greatest(1, len(hist) - 2), len(hist))) end as rate) r
  ) q where t < len(x))
select Year, RoundNumber, Driver, Stint, cast(unnest(range(len(hist))) as int) as lap, round(unnest(hist), 4) as answer, cast(null as varchar) as error
from rec where t = len(x)
union all
select distinct Year, RoundNumber, 'none', 0, cast(null as int), cast(null as double), 'the request holds no lap' from rq"""


@register("request_answers", oracle=ANSWERS_SQL, doubles=("answer",))
def q_request_answers(spark, sf):
    """B5 + C3: each val stint sent as a request, an answer per lap in request order with the state of the earlier answers;
    one empty request a race comes back as an error row."""
    from pitlane.operators import sequences as S
    df = enc.temporal_split(feature_store(spark, sf))
    model = ML.fit_linear_curve(df.where(F.col("split") == "train"))
    lap = F.struct(F.col("stint_lap_number").alias("__o"), F.col("stint_lap_number").cast("double").alias("stint_lap_number"))
    val = df.where((F.col("split") == "val") & F.col("Stint").isNotNull())
    requests = val.groupBy(*K.STINT_KEYS).agg(F.array_sort(F.collect_list(lap)).alias("laps"))
    empty = requests.select("Year", "RoundNumber", F.lit("none").alias("Driver"), F.lit(0).alias("Stint"), F.slice("laps", 1, 0).alias("laps")).distinct()
    asked = S.request_matrix(requests.unionByName(empty), "laps", model.features)
    a, b, c, d = model.a, *model.coefficients
    out = ML.lap_answers(asked, lambda x: a + b * x[:, 0] + c * x[:, 1] + d * x[:, 2], 3, rate_at=1, acc_at=2)
    return out.select(*K.STINT_KEYS, F.posexplode_outer("answers").alias("lap", "p"), "error").select(
        *K.STINT_KEYS, "lap", F.round("p", 4).alias("answer"), "error")


@register("curve_linear", oracle=CURVE_SQL, doubles=("predicted_delta",))
def q_curve_linear(spark, sf):
    """C2 (linear): 30-lap curves per compound, one aggregate() per scenario."""
    df = enc.temporal_split(feature_store(spark, sf))
    model = ML.fit_linear_curve(df.where(F.col("split") == "train"))
    sc = df.where(F.col("split") == "test").select(
        F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("scenario")).distinct()
    return ML.curve_linear(model, sc, n_laps=30)


@register(
    "causal_features",
    oracle=f"""
select Year, RoundNumber, Driver, LapNumber,
  case when Stint is not null and Driver is not null then lag({T}) over w end as prev_delta,
  case when Stint is not null and Driver is not null then avg({T}) over (w rows between unbounded preceding and 1 preceding) end as mean_prev_delta,
  case when Stint is not null and Driver is not null then
    case when row_number() over w = 1 then 0.0 else avg({T}) over (w rows between 3 preceding and 1 preceding) end end as deg_rate_prev_3,
  case when Stint is not null and Driver is not null then
    case when row_number() over w = 1 then 0.0
         when row_number() over w >= 3 then avg({T}) over (w rows between 3 preceding and 1 preceding)
              - avg({T}) over (w rows between 4 preceding and 2 preceding)
         else avg({T}) over (w rows between 3 preceding and 1 preceding) end end as deg_acceleration_prev
from feat window w as (partition by Year, RoundNumber, Driver, Stint order by LapNumber)""",
    doubles=("prev_delta", "mean_prev_delta", "deg_rate_prev_3", "deg_acceleration_prev"),
)
def q_causal_features(spark, sf):
    """Per-lap inputs from earlier laps of the stint only."""
    return ML.causal_features(feature_store(spark, sf)).select(
        "Year", "RoundNumber", "Driver", "LapNumber", "prev_delta", "mean_prev_delta", "deg_rate_prev_3",
        "deg_acceleration_prev")


@register("sequence_model")
def q_sequence_model(spark, sf):
    """Per-lap model from the 16 non-leaking inputs + causal features, scored
    per lap and regrouped into per-stint prediction arrays (B1); metrics per split."""
    from pitlane.operators import sequences as S
    base = ML.causal_features(enc.sequence_frame(enc.temporal_split(feature_store(spark, sf))))
    feats = K.SEQUENCE_FEATURES + ["prev_delta", "mean_prev_delta", "deg_rate_prev_3", "deg_acceleration_prev"]
    train = base.where(F.col("split") == "train")
    meds = enc.fit_medians(train, feats)
    filled = enc.apply_fill(base, meds).where(F.col(T).isNotNull())
    sc = enc.fit_scaler(filled.where(F.col("split") == "train"), feats)
    x = ML.assemble(enc.apply_scaler(filled, sc), feats)
    from pyspark.ml.regression import LinearRegression
    lr = LinearRegression(featuresCol=ML.VEC, labelCol=T, predictionCol="pred", maxIter=50, regParam=1e-3)
    pred = lr.fit(x.where(F.col("split") == "train")).transform(x)
    seqs = S.stint_sequences(pred.withColumn("__yp", F.col("pred")), ["pred"], T, keys=K.STINT_KEYS + ["split"])
    steps = seqs.select("split", F.explode(F.arrays_zip(F.transform("X", lambda r: r[0]), "y")).alias("z"))
    return M.regression_metrics(steps.select("split", F.col("z.0").alias("pred"), F.col("z.y").alias(T)),
                                by=["split"]).withColumn("model", F.lit("sequence"))


@register(
    "metrics_roundtrip",
    oracle=f"""
with m as (select 'line' as model, split, avg(abs(pred - {T})) as mae, 1 - sum((pred - {T}) * (pred - {T})) /
             (var_pop({T}) * count({T})) as r2 from pred group by split)
select (select mae from m where split = 'test') as test_mae, (select r2 from m where split = 'test') as test_r2,
  cast(null as double) as sequence_test_mae, 1 as n_features,
  (select count(*) from pred where split = 'train') as train_rows""",
    doubles=("test_mae", "test_r2", "sequence_test_mae"),
)
def q_metrics_roundtrip(spark, sf):
    """Metric rows written as JSON, read back, health subset."""
    df = enc.temporal_split(feature_store(spark, sf)).na.drop(subset=[T, "stint_lap_number"])
    fit = M.fit_line(df.where(F.col("split") == "train"))
    pred = M.predict_line(df, fit)
    rows = M.regression_metrics(pred, by=["split"]).withColumn("model", F.lit("line"))
    path = _scratch(spark, "metrics")
    ML.write_metrics(rows, path)
    back = ML.read_metrics(spark, path)
    n_train = df.where(F.col("split") == "train").count()
    return ML.health(back, "line", 1, n_train).select(
        "test_mae", "test_r2", F.col("sequence_test_mae").cast("double").alias("sequence_test_mae"),
        "n_features", "train_rows")


@register("explore_records")
def q_explore_records(spark, sf):
    """Explorer rows as JSON records."""
    from pitlane.sources import scan
    return ML.records(M.explore(scan.explorer_scan(feature_store(spark, sf)), year=2024, compound="MEDIUM"))


@register(
    "score_linear",
    oracle=f"""
with sc as (select coalesce(Compound, 'UNKNOWN') as scenario, avg(cast(stint_lap_number as double)) as stint_lap_number
            from pred where split = 'test' group by 1),
s as (select scenario, round(fit.a + fit.b * stint_lap_number, 4) as predicted_delta from sc, fit)
select scenario, predicted_delta, case when predicted_delta < 0.1 then 'NOMINAL' when predicted_delta < 0.3 then 'DEGRADING'
  else 'CLIFF RISK' end as band from s""",
    doubles=("predicted_delta",),
)
def q_score_linear(spark, sf):
    """C1/P11/F9/P12 with the closed-form line: per-compound scenarios scored,
    rounded to 4 decimals and banded."""
    from pitlane.functions.scalar import risk_band
    df = enc.temporal_split(feature_store(spark, sf)).na.drop(subset=[T, "stint_lap_number"])
    fit = M.fit_line(df.where(F.col("split") == "train"))
    sc = df.where(F.col("split") == "test").groupBy(
        F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("scenario")).agg(
        F.avg(F.col("stint_lap_number").cast("double")).alias("stint_lap_number"))

    def predict(x):
        return M.predict_line(x, fit)

    out = ML.score(predict, sc, ["stint_lap_number"])
    return out.select("scenario", "predicted_delta", risk_band("predicted_delta").alias("band"))
