"""Models, search and scoring.

Training runs as Spark ML fits on the assembled train split. The boosting
loop and its search (M2, M3) are in ``boosting``.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.functions.scalar import compound_code_fixed, existing, round4
from pitlane.operators import encode as enc
from pitlane.operators import metrics as M
from pitlane.plans import boosting as B
from pitlane.plans.boosting import SEARCH_SPACE, BoostParams, Tree, draw_params, flat_tree, to_boost  # noqa: F401
from pitlane.session import land

T = K.TARGET
VEC = "features"


# --- E2 / P10 / P11 feature matrices --------------------------------------------

def model_columns(df: DataFrame, features: list[str], required: list[str] | None = None) -> list[str]:
    """P10: the listed features that exist; error when none of ``required`` does."""
    cols = existing(df, features)
    if required is not None and not existing(df, required):
        raise ValueError(f"no baseline feature among the columns: {required}")
    return cols


def assemble(df: DataFrame, features: list[str], fill: float | None = 0.0, out: str = VEC) -> DataFrame:
    """Feature vector; remaining nulls (all-null columns) become ``fill``."""
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) if fill is not None else F.col(c).cast("double")
            for c in features}
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df.withColumns(cols))


def scenario_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """P11 + F5: scoring rows; a missing feature is 0.0, a compound name becomes
    its fixed code unless a code is given, extra columns are ignored."""
    out = df
    if "compound_encoded" in features and "Compound" in out.columns:
        given = F.col("compound_encoded") if "compound_encoded" in out.columns else None
        out = out.withColumn("compound_encoded", compound_code_fixed("Compound", given))
    out = out.withColumns({c: F.lit(0.0) for c in features if c not in out.columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def training_frame(features_df: DataFrame, leaky: bool = False) -> tuple[DataFrame, list[str]]:
    """L-2 front half: split, sector shares, compound codes (F4), target
    encodings, per-split median fill (A11). ``leaky=False`` drops the two
    rolling features that contain the current lap's target."""
    df = enc.temporal_split(features_df)
    df, _, _ = enc.encode_features(df)
    feats = [c for c in K.MODEL_FEATURES if leaky or c not in ("deg_rate_last_3", "deg_acceleration")]
    feats = model_columns(df, feats)
    df = enc.median_fill_per_split(df, feats).where(F.col(T).isNotNull())
    return df, feats


# --- M1 robust linear baseline ----------------------------------------------

def huber_baseline(train: DataFrame, features: list[str] | None = None) -> tuple[LinearRegressionModel, list[str]]:
    """M1: Huber regression (epsilon 1.35, 300 iterations) on the baseline
    features, nulls -> 0."""
    feats = model_columns(train, features or K.BASELINE_FEATURES, required=K.BASELINE_FEATURES)
    lr = LinearRegression(featuresCol=VEC, labelCol=T, predictionCol="pred", loss="huber",
                          epsilon=K.HUBER_EPSILON, maxIter=K.HUBER_MAX_ITER, regParam=0.0)
    return lr.fit(assemble(train, feats)), feats


def linear_attribution(model, df: DataFrame, feats: list[str]) -> DataFrame:
    """A24 (linear): exact attribution coef * (x - mean x); mean |attribution| per feature. ``model`` has ``coefficients``."""
    means = df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in feats]).collect()[0]
    coefs = list(model.coefficients)
    parts = [
        F.avg(F.abs(F.lit(float(coefs[i])) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(means[c] or 0.0))))
        .alias(c) for i, c in enumerate(feats)
    ]
    wide = df.agg(*parts)
    return wide.unpivot([], feats, "feature", "mean_abs_attribution").orderBy(F.desc("mean_abs_attribution"), "feature")


# --- M2 / M4 boosted trees with Huber loss --------------------------------------

@dataclass
class BoostedModel:
    """init + learning_rate * sum of the trees. The trees are data: any number of any depth is sent to the
    executors once and scored in Arrow batches, so neither plans nor generated code grow with the model."""
    init: float
    learning_rate: float
    trees: list[Tree]
    features: list[str]
    staged: list[dict]

    def scores(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        total = np.full(len(x), self.init)
        for t in self.trees[:upto] if upto else self.trees:
            total += self.learning_rate * t.predict(x)
        return total

    def predict(self, df: DataFrame, out: str = "pred", upto: int | None = None) -> DataFrame:
        """Score rows (nulls count as 0)."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                yield pd.Series(sent.value.scores(np.column_stack([c.to_numpy(float) for c in cols]), upto))

        return df.withColumn(out, run(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features)))


def _round_metrics(df: DataFrame, score: Column, label: str, rnd: int) -> dict:
    e = score - F.col(B.Y)
    r = df.select(e.alias("e")).agg(
        F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.when(F.abs("e") < K.TIGHT_TOL, 1.0).otherwise(0.0)).alias("within_tight"),
        F.avg(F.when(F.abs("e") < K.LOOSE_TOL, 1.0).otherwise(0.0)).alias("within_loose"),
        F.avg(F.when(F.col("e") > 0, 1.0).otherwise(0.0)).alias("over"),
        F.avg(F.when(F.col("e") < 0, 1.0).otherwise(0.0)).alias("under"),
    ).collect()[0].asDict()
    r.update({"round": rnd, "split": label})
    return r


def boosted_huber(
    train: DataFrame, valid: DataFrame | None, features: list[str], params: BoostParams | None = None,
    log_every: int = 0, monitor: DataFrame | None = None,
) -> BoostedModel:
    """M2 (+M4): gradient boosting of regression trees on the Huber loss (see ``boosting``).

    Early stopping watches the validation MAE. With ``log_every`` the
    tolerance/bias metrics (A16) of the train and ``monitor`` rows are
    recorded every ``log_every`` rounds.
    """
    p = params or BoostParams()
    train, valid, monitor = (B.matrix(d, features) if d is not None else None for d in (train, valid, monitor))
    model = B.Boosting(train, valid, features, p, monitor)
    staged: list[dict] = []

    def log(m: B.Boosting) -> None:
        if log_every and len(m.trees) % log_every == 0:
            staged.extend(_round_metrics(d, m.score(), k, len(m.trees)) for k, d in m.sides.items() if k != "valid")

    model.run(p.n_rounds, log)
    return BoostedModel(model.init, p.learning_rate, model.kept(), features, staged)


def boosted_fast(train: DataFrame, valid: DataFrame, features: list[str], max_iter: int = 100) -> PipelineModel:
    """Fast path: Spark's GBT (absolute loss) with a validation indicator for early stopping."""
    tv = train.withColumn("__is_val", F.lit(False)).unionByName(valid.withColumn("__is_val", F.lit(True)))
    gbt = GBTRegressor(featuresCol=VEC, labelCol=T, predictionCol="pred", lossType="absolute", maxIter=max_iter,
                       validationIndicatorCol="__is_val", seed=42)
    return PipelineModel(stages=[gbt.fit(assemble(tv, features))])


# --- M3 hyper-parameter search ---------------------------------------------

def param_search(train: DataFrame, valid: DataFrame, features: list[str], n_trials: int = 50,
                 n_rounds: int = 100, early_stopping: int = 50, seed: int = 42) -> DataFrame:
    """M3: minimise the validation MAE over seeded draws on the fixed val split (concurrent trials, successive halving);
    the trials come back as a DataFrame (best = min val_mae)."""
    return B.halving_search(B.matrix(train, features), B.matrix(valid, features), features, n_trials, n_rounds, early_stopping, seed)


def train_pipeline(
    df: DataFrame, features: list[str], metrics_path: str, model_path: str, n_trials: int = 50, n_rounds: int = 100,
    early_stopping: int = 50, seed: int = 42, trials: DataFrame | None = None,
) -> DataFrame:
    """The whole training run on a split table: search on train/val (or the ``trials`` of one), the best draw fitted again on train + val with its best
    number of rounds, the model and the Huber baseline held against the same untouched test rows (A15, A17), the model saved (S15) and
    the metrics replaced (S13). Returns (model, split, n, mae, rmse, r2, gain_pct)."""
    train, valid, test = (df.where(F.col("split") == s) for s in ("train", "val", "test"))
    trials = trials if trials is not None else param_search(train, valid, features, n_trials, n_rounds, early_stopping, seed)
    best = trials.orderBy(F.asc_nulls_last("val_mae"), "trial").first()
    draw = {k: int(best[k]) if kind == "int" else best[k] for k, (kind, _, _) in SEARCH_SPACE.items()}
    final = to_boost(draw, max(1, best["n_trees"]), 0)
    both = enc.train_val(df)
    model = boosted_huber(both, None, features, final)
    save_boosted(model, model_path)
    base, base_features = huber_baseline(both)
    rows = M.regression_metrics(model.predict(test), by=["split"]).withColumn("model", F.lit("boosted_huber")).unionByName(
        M.regression_metrics(base.transform(assemble(test, base_features)), by=["split"]).withColumn("model", F.lit("huber_baseline")))
    baseline = F.max(F.when(F.col("model") == "huber_baseline", F.col("mae"))).over(Window.partitionBy("split"))
    rows = rows.withColumn("gain_pct", M.gain(baseline, F.col("mae"))[0])
    write_metrics(rows, metrics_path)
    return read_metrics(df.sparkSession, metrics_path).select("model", "split", "n", "mae", "rmse", "r2", "gain_pct")


# --- A24 importance -----------------------------------------------------------

def tree_importance(model: BoostedModel, top: int | None = 3) -> DataFrame:
    """Split-gain importance summed over the boosted trees, normalised."""
    n = len(model.features)
    tot = [0.0] * n
    for t in model.trees:
        v = t.importance
        for i in range(min(n, len(v))):
            tot[i] += float(v[i])
    s = sum(tot) or 1.0
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(f, tot[i] / s) for i, f in enumerate(model.features)], "feature string, importance double")
    out = df.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


ROWS_A_RANGE = 200_000


def numbered(df: DataFrame, order: Column, key: list[str]) -> tuple[DataFrame, int]:
    """Rows with their number ``__i`` (from 0) in the order of a hash, and how many there are.

    The hash's values are cut into equal ranges of about ``ROWS_A_RANGE`` rows; rows are ranked inside a range, and the ranges' sizes add up.
    """
    n = df.count()
    parts = max(1, -(-n // ROWS_A_RANGE))
    d = df.withColumns({"__p": F.pmod(F.shiftrightunsigned(order, 24), F.lit(parts)), "__h": order})
    sizes = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__h", *key))
    out = d.withColumn("__k", inside).join(base, "__p").withColumn("__i", F.col("__b") + F.col("__k") - 1)
    return out.drop("__p", "__h", "__k", "__b"), n


def permutations(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """``count`` permutations i -> (a * i + b) mod n of 0..n-1 as (a, b); a is below 2^20 and has no factor in common with n."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        a = rng.randrange(1, max(2, min(n, 1 << 20)))
        if math.gcd(a, n) == 1:
            out.append((a, rng.randrange(max(n, 1))))
    return out


def permutation_importance(predict, df: DataFrame, features: list[str], sample: int | None = None,
                           seed: int = K.IMPORTANCE_SEED, key: list[str] | None = None) -> DataFrame:
    """A24 (model-agnostic): MAE increase when one feature column is permuted, on all rows or on a seeded ``sample`` of them (L4).

    Rows are numbered in a seeded random order once. A feature's permutation is arithmetic on these numbers, so every row sends each of its
    values straight to the row that gets it: one join serves all features, and one ``groupBy`` gives all errors.
    """
    key = key or ["Year", "RoundNumber", "Driver", "LapNumber"]
    s = (df if sample is None else df.orderBy(M.hash_key(key, seed), *key).limit(sample)).select(*dict.fromkeys([*key, *features, T]))
    rows, n = numbered(land(s, "permuted"), M.hash_key(key, seed + 1), key)
    rows = land(rows, "numbered")
    maps = permutations(n, len(features), seed)
    # Feature by feature: the value and the row it goes to. Number -1 is the untouched column.
    moves = F.array(*(
        F.struct(F.lit(j).alias("f"), F.pmod(F.lit(a) * F.col("__i") + F.lit(b), F.lit(max(n, 1))).alias("to"), F.col(c).cast("double").alias("v"))
        for j, (c, (a, b)) in enumerate(zip(features, maps, strict=True))))
    sent = rows.select(F.explode(moves).alias("m")).select("m.f", F.col("m.to").alias("__i"), "m.v")
    own = rows.select("__i", F.lit(-1).alias("f"), F.lit(None).cast("double").alias("v"))
    mixed = rows.join(own.unionByName(sent), "__i")
    mixed = mixed.withColumns({c: F.when(F.col("f") == j, F.col("v")).otherwise(F.col(c).cast("double")) for j, c in enumerate(features)})
    errors = M.regression_metrics(predict(mixed), by=["f"]).select("f", "mae")
    base = F.max(F.when(F.col("f") == -1, F.col("mae"))).over(Window.partitionBy(F.lit(1)))  # one row a feature
    names = F.array(*map(F.lit, features))
    out = errors.withColumn("__base", base).where(F.col("f") >= 0)
    return out.select(names[F.col("f")].alias("feature"), (F.col("mae") - F.col("__base")).alias("mae_increase")).orderBy(F.desc("mae_increase"), "feature")


# --- C1 / C2 scoring ------------------------------------------------------------

def score(model_predict, scenarios: DataFrame, features: list[str]) -> DataFrame:
    """Batch scoring of scenario rows (P11, F5), rounded to 4 decimals."""
    x = assemble(scenario_matrix(scenarios, features), features)
    return model_predict(x).withColumn("predicted_delta", round4("pred"))


def _mean_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr)


def curve_state_features(hist: Column) -> tuple[Column, Column]:
    """W7 on the prediction history: rate = mean of the last 3, acceleration =
    rate - mean(history[-4:-1]) with >= 2 predictions, else rate - 0; no
    history: both 0."""
    n = F.size(hist)
    last3 = F.slice(hist, F.greatest(F.lit(1), n - 2), 3)
    prev3 = F.slice(hist, F.greatest(F.lit(1), n - 3), F.least(F.lit(3), n - 1))
    rate = F.when(n == 0, F.lit(0.0)).otherwise(_mean_of(last3))
    acc = F.when(n == 0, F.lit(0.0)).when(n >= 2, rate - _mean_of(prev3)).otherwise(rate)
    return rate, acc


def _laps(n: int, n_col: str | None) -> Column:
    """Laps 0..n-1 of a request: its own number in ``n_col`` (null: ``n``), at most the request limit; none for 0 or less."""
    laps = F.least(F.coalesce(F.col(n_col).cast("int"), F.lit(n)), F.lit(K.CURVE_MAX_LAPS)) if n_col else F.lit(n)
    return F.when(laps > 0, F.sequence(F.lit(0), F.greatest(laps - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def score_curve(model_predict, scenarios: DataFrame, features: list[str], key: str = "scenario",
                n_laps: int = K.CURVE_DEFAULT_LAPS, n_col: str | None = None) -> DataFrame:
    """C2 for any model: laps 0..n-1 (n = min(n_laps, 60)); each step scores all
    scenarios at once with the rolling features taken from the unrounded
    prediction history; the lineage is cut every 10 steps."""
    n = min(int(n_laps), K.CURVE_MAX_LAPS)
    if n_col:  # the loop runs for the longest request
        n = min(max(n, int(scenarios.agg(F.max(F.col(n_col).cast("int"))).first()[0] or 0)), K.CURVE_MAX_LAPS)
    base = scenario_matrix(scenarios, [c for c in features if c not in ("stint_lap_number", "deg_rate_last_3",
                                                                           "deg_acceleration")])
    cur = base.withColumn("__hist", F.array().cast("array<double>"))
    for t in range(n):
        rate, acc = curve_state_features(F.col("__hist"))
        x = cur.withColumns({"stint_lap_number": F.lit(float(t)), "deg_rate_last_3": rate, "deg_acceleration": acc})
        x = model_predict(assemble(x, features)).drop(VEC)
        cur = x.withColumn("__hist", F.concat("__hist", F.array(F.col("pred")))).drop(
            "pred", "stint_lap_number", "deg_rate_last_3", "deg_acceleration")
        if (t + 1) % 10 == 0:
            cur = cur.checkpoint(eager=True)
    hist = F.slice("__hist", F.lit(1), F.size(_laps(n, n_col)))
    return cur.select(key, F.posexplode(hist).alias("lap", "p")).select(
        key, "lap", round4("p").alias("predicted_delta"))


def curve_boosted(model: BoostedModel, scenarios: DataFrame, key: str = "scenario",
                  n_laps: int = K.CURVE_DEFAULT_LAPS, n_col: str | None = None) -> DataFrame:
    """C2 for the boosted trees: laps 0..n-1 of all scenarios of a batch side by side, each lap scored from the
    unrounded prediction history (no per-lap job, no checkpoint)."""
    n = min(int(n_laps), K.CURVE_MAX_LAPS)
    moving = ("stint_lap_number", "deg_rate_last_3", "deg_acceleration")
    static = [c for c in model.features if c not in moving]
    base = scenario_matrix(scenarios, static)
    base = base.select(key, F.size(_laps(n, n_col)).alias("__n"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in static))
    sent = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            hist = np.empty((len(d), 0))
            for t in range(int(d["__n"].max()) if len(d) else 0):
                rate = hist[:, -3:].mean(axis=1) if t else np.zeros(len(d))
                acc = rate - hist[:, -4:-1].mean(axis=1) if t >= 2 else rate
                now = dict(zip(moving, (np.full(len(d), float(t)), rate, acc), strict=True))
                x = np.column_stack([now[c] if c in now else d[c].to_numpy(float) for c in model_features])
                hist = np.column_stack([hist, sent.value.scores(x)])
                live = (d["__n"] > t).to_numpy()
                yield pd.DataFrame({key: d[key][live], "lap": t, "p": hist[live, -1]})

    model_features = list(model.features)
    out = base.mapInPandas(run, f"{key} {base.schema[key].dataType.simpleString()}, lap int, p double")
    return out.select(key, "lap", round4("p").alias("predicted_delta"))


@dataclass
class LinearCurveModel:
    """A closed-form line in (lap, rate, acceleration): intercept + b1*lap fitted
    by least squares, then the residual regressed on rate, then on acceleration
    (stagewise). DuckDB repeats the fit with regr_slope/regr_intercept."""
    a: float
    b_lap: float
    b_rate: float
    b_acc: float
    features = ["stint_lap_number", "deg_rate_last_3", "deg_acceleration"]

    @property
    def coefficients(self) -> list[float]:
        return [self.b_lap, self.b_rate, self.b_acc]


def fit_linear_curve(train: DataFrame) -> LinearCurveModel:
    t = train.where(F.col(T).isNotNull() & F.col("stint_lap_number").isNotNull())
    r1 = t.agg(F.regr_intercept(T, "stint_lap_number").alias("a"), F.regr_slope(T, "stint_lap_number").alias("b")).collect()[0]
    e1 = F.col(T) - (F.lit(r1["a"]) + F.lit(r1["b"]) * F.col("stint_lap_number"))
    t1 = t.withColumn("__e1", e1)
    b_rate = t1.agg(F.regr_slope("__e1", "deg_rate_last_3")).collect()[0][0] or 0.0
    t2 = t1.withColumn("__e2", F.col("__e1") - F.lit(b_rate) * F.col("deg_rate_last_3"))
    b_acc = t2.agg(F.regr_slope("__e2", "deg_acceleration")).collect()[0][0] or 0.0
    return LinearCurveModel(float(r1["a"]), float(r1["b"]), float(b_rate), float(b_acc))


def curve_linear(model: LinearCurveModel, scenarios: DataFrame, key: str = "scenario",
                 n_laps: int = K.CURVE_DEFAULT_LAPS, n_col: str | None = None) -> DataFrame:
    """C2 for the linear model in one JVM expression per scenario: ``aggregate``
    over laps 0..n-1 with the prediction history as the array state."""
    n = min(int(n_laps), K.CURVE_MAX_LAPS)

    def step(hist: Column, t: Column) -> Column:
        rate, acc = curve_state_features(hist)
        pred = F.lit(model.a) + F.lit(model.b_lap) * t.cast("double") + F.lit(model.b_rate) * rate \
            + F.lit(model.b_acc) * acc
        return F.concat(hist, F.array(pred))

    hist = F.aggregate(_laps(n, n_col), F.array().cast("array<double>"), step)
    return scenarios.select(key, F.posexplode(hist).alias("lap", "p")).select(
        key, "lap", round4("p").alias("predicted_delta"))


# --- B5 / C3: an answer for each lap of a request -------------------------------------

def lap_answers(df: DataFrame, predict, width: int, matrix: str = "X", rate_at: int | None = None, acc_at: int | None = None) -> DataFrame:
    """C3 on B5's matrices: ``answers``, one for each lap of the request, in request order.

    ``predict`` (rows x ``width`` numpy matrix -> values) sees one lap of all requests of an Arrow batch at a time. The columns ``rate_at`` and
    ``acc_at`` are W7's rate and acceleration of the request's own earlier answers, whatever the request says. A request
    without a matrix (an empty one) has no answers. Nulls in a lap make its answer null; later laps go on from the answers that are there as 0.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for requests in batches:
            laps = np.array([len(x) if x is not None else 0 for x in requests], int)
            wide = np.zeros((len(laps), laps.max(initial=0), width))
            for i, x in enumerate(requests):
                if laps[i]:
                    wide[i, : laps[i]] = np.array([[np.nan if v is None else v for v in row] for row in x], float)
            hist = np.zeros((len(laps), laps.max(initial=0)))
            for t in range(hist.shape[1]):
                x, past = wide[:, t, :], np.nan_to_num(hist[:, :t])
                rate = past[:, -3:].mean(axis=1) if t else np.zeros(len(laps))
                acc = rate - past[:, -4:-1].mean(axis=1) if t >= 2 else rate
                for at, v in ((rate_at, rate), (acc_at, acc)):
                    if at is not None:
                        x[:, at] = v
                hist[:, t] = predict(x)
            out = [hist[i, : n].tolist() if n else None for i, n in enumerate(laps)]
            yield pd.Series([[None if np.isnan(v) else v for v in x] if x else None for x in out])

    return df.withColumn("answers", run(F.col(matrix)))


# --- C3 causal sequence features and the grouped-map hook ------------------------

def causal_features(df: DataFrame, target: str = T) -> DataFrame:
    """C3 inputs: per stint, from earlier laps only - the previous target, the
    running mean of earlier targets, and the W7 rolling features."""
    from pitlane.operators.features import add_causal_rolling, keys_present, stint_window
    ws = stint_window()
    ok = keys_present(K.STINT_KEYS)
    out = add_causal_rolling(df, target)
    return out.withColumns({
        "prev_delta": F.when(ok, F.lag(target).over(ws)),
        "mean_prev_delta": F.when(ok, F.avg(target).over(ws.rowsBetween(Window.unboundedPreceding, -1))),
    })


def score_sequences(df: DataFrame, fn, schema: str, keys: list[str] | None = None) -> DataFrame:
    """C3 hook: an external per-stint model (pandas in, pandas out) applied to
    each stint with ``applyInPandas``; a stint is a bounded group."""
    return df.groupBy(*(keys or K.STINT_KEYS)).applyInPandas(fn, schema)


# --- S13 / S14 / S15 / S16 ------------------------------------------------------------

def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON, one folder per (model, split); a re-train replaces its own rows, others stay."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "split").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def health(metrics: DataFrame, model: str, n_features: int, train_rows: int) -> DataFrame:
    """The health subset - test MAE and R^2 of a model, width, train rows,
    and the sequence model's test MAE when present."""
    m = metrics.where(F.col("split") == "test")
    return m.agg(
        F.max(F.when(F.col("model") == model, F.col("mae"))).alias("test_mae"),
        F.max(F.when(F.col("model") == model, F.col("r2"))).alias("test_r2"),
        F.max(F.when(F.col("model") == "sequence", F.col("mae"))).alias("sequence_test_mae"),
    ).withColumns({"n_features": F.lit(n_features), "train_rows": F.lit(train_rows).cast("bigint")})


def save_linear(model: LinearRegressionModel, path: str) -> None:
    """S15."""
    model.write().overwrite().save(path)


def load_linear(path: str) -> LinearRegressionModel | None:
    """An absent model is "unavailable" (None), not an error."""
    try:
        return LinearRegressionModel.load(path)
    except Exception:  # noqa: BLE001 - missing or unreadable model
        return None


def save_boosted(model: BoostedModel, path: str) -> None:
    """One row a tree, and the model's own values, as JSON."""
    spark = SparkSession.getActiveSession()
    rows = [(i, *(getattr(t, c).tolist() for c in ("feature", "threshold", "left", "right", "value", "importance"))) for i, t in enumerate(model.trees)]
    schema = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, importance array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/trees")
    meta = json.dumps({"init": model.init, "learning_rate": model.learning_rate, "features": model.features})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_boosted(path: str) -> BoostedModel | None:
    """An absent model is "unavailable" (None), not an error."""
    spark = SparkSession.getActiveSession()
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
    except Exception:  # noqa: BLE001 - missing or unreadable model
        return None
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
    trees = [Tree(*(np.array(r[c], float if c in ("threshold", "value", "importance") else int) for c in ("feature", "threshold", "left", "right", "value", "importance"))) for r in rows]
    return BoostedModel(meta["init"], meta["learning_rate"], trees, meta["features"], [])


def records(df: DataFrame) -> DataFrame:
    """Result rows as JSON records (one string per row; nulls are written)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
