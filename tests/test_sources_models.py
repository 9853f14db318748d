"""Sources with missing inputs, and the model layer on the smallest testdata."""

from __future__ import annotations

import math
import uuid

import pytest
import numpy as np
from pyspark.sql import functions as F

from oracle_compare import SF_SMALL
from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.plans import models as ML
from pitlane.plans.store import feature_store
from pitlane.session import checkpoint_dir
from pitlane.sources import scan


def test_missing_lap_files_raise(spark):
    with pytest.raises(FileNotFoundError):
        scan.read_laps(spark, f"{checkpoint_dir(spark)}/nothing-{uuid.uuid4().hex}")


def test_missing_telemetry_is_none_and_build_goes_on(spark):
    from pitlane.operators.telemetry import join_telemetry
    tel = scan.read_telemetry(spark, f"{checkpoint_dir(spark)}/nothing-{uuid.uuid4().hex}")
    assert tel is None
    laps = spark.createDataFrame([(2023, 1, "1", 1)], "Year int, RoundNumber int, DriverNumber string, LapNumber int")
    assert join_telemetry(laps, tel).columns == laps.columns


def test_absent_model_is_unavailable(spark):
    assert ML.load_linear(f"{checkpoint_dir(spark)}/no-model-{uuid.uuid4().hex}") is None
    assert ML.load_boosted(f"{checkpoint_dir(spark)}/no-model-{uuid.uuid4().hex}") is None


def test_boosting_beats_the_mean_and_round_trips(spark):
    df, feats = ML.training_frame(feature_store(spark, SF_SMALL))
    train = df.where(F.col("split") == "train")
    m = ML.boosted_huber(train, None, feats, ML.BoostParams(n_rounds=4, early_stopping=0))
    assert len(m.trees) == 4
    pred = m.predict(ML.assemble(train, feats))
    mae = pred.agg(F.avg(F.abs(F.col("pred") - F.col(K.TARGET)))).collect()[0][0]
    med = train.agg(F.percentile_approx(K.TARGET, 0.5)).collect()[0][0]
    base = train.agg(F.avg(F.abs(F.lit(med) - F.col(K.TARGET)))).collect()[0][0]
    assert mae <= base + 1e-9
    path = f"{checkpoint_dir(spark)}/boost-{uuid.uuid4().hex}"
    ML.save_boosted(m, path)
    m2 = ML.load_boosted(path)
    a = pred.select("pred").collect()
    b = m2.predict(ML.assemble(train, feats)).select("pred").collect()
    assert all(math.isclose(x[0], y[0], abs_tol=1e-9) for x, y in zip(a, b))


def test_linear_curve_matches_python_recursion(spark):
    df = enc.temporal_split(feature_store(spark, SF_SMALL))
    model = ML.fit_linear_curve(df.where(F.col("split") == "train"))
    sc = spark.createDataFrame([("s",)], "scenario string")
    got = [r.predicted_delta for r in ML.curve_linear(model, sc, n_laps=12).orderBy("lap").collect()]
    hist = []
    for t in range(12):
        if hist:
            rate = sum(hist[-3:]) / len(hist[-3:])
            prev = sum(hist[-4:-1]) / len(hist[-4:-1]) if len(hist) >= 2 else 0.0
            acc = rate - prev
        else:
            rate = acc = 0.0
        hist.append(model.a + model.b_lap * t + model.b_rate * rate + model.b_acc * acc)
    assert got == [round(h, 4) for h in hist]


def test_search_draws_are_seeded_and_in_range():
    a, b = ML.draw_params(5, seed=1), ML.draw_params(5, seed=1)
    assert a == b
    for d in a:
        for k, (kind, lo, hi) in ML.SEARCH_SPACE.items():
            assert lo <= d[k] <= hi


def test_sequence_hook_runs_per_stint(spark):
    import pandas as pd

    df = feature_store(spark, SF_SMALL).where(F.col(K.TARGET).isNotNull()).select(*K.STINT_KEYS, "LapNumber", K.TARGET)

    def persistence(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("LapNumber")
        pdf["pred"] = pdf[K.TARGET].shift(1).fillna(0.0)
        return pdf[[*K.STINT_KEYS, "LapNumber", "pred"]]

    schema = "Year int, RoundNumber int, Driver string, Stint int, LapNumber int, pred double"
    out = ML.score_sequences(df.where(F.col("Stint").isNotNull()), persistence, schema)
    assert out.count() == df.where(F.col("Stint").isNotNull()).count()


def test_flat_trees_equal_spark_ml_transform(spark):
    from pyspark.ml.regression import RandomForestRegressor

    df, feats = ML.training_frame(feature_store(spark, SF_SMALL))
    x = ML.assemble(df, feats).where(F.col(K.TARGET).isNotNull())
    fitted = RandomForestRegressor(featuresCol=ML.VEC, labelCol=K.TARGET, predictionCol="__p", numTrees=1, maxDepth=12, seed=3).fit(x)
    tree = ML.flat_tree(fitted.trees[0])
    assert (tree.feature >= 0).sum() == (tree.feature < 0).sum() - 1
    m = ML.BoostedModel(0.0, 1.0, [tree], feats, [])
    assert m.predict(fitted.transform(x)).agg(F.max(F.abs(F.col("pred") - F.col("__p")))).first()[0] == 0.0


def test_a_model_of_600_deep_trees_scores_saves_loads_and_draws(spark):
    rng = np.random.default_rng(0)
    feats = ["a", "b", "stint_lap_number", "deg_rate_last_3", "deg_acceleration"]

    def tree() -> ML.Tree:  # a full tree of depth 12
        n, leaves = 2**12 - 1, 2**12
        feature = np.concatenate([rng.integers(0, 5, n), np.full(leaves, -1)])
        left = np.concatenate([2 * np.arange(n) + 1, np.full(leaves, -1)])
        return ML.Tree(feature, rng.normal(size=n + leaves), left, left + 1, rng.normal(size=n + leaves), np.ones(5) / 5)

    trees = [tree() for _ in range(20)] * 30
    m = ML.BoostedModel(0.5, 0.01, trees, feats, [])
    path = f"{checkpoint_dir(spark)}/boost-{uuid.uuid4().hex}"
    ML.save_boosted(m, path)
    m = ML.load_boosted(path)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(f"s{i}", *map(float, r)) for i, r in enumerate(x)], "scenario string, " + ", ".join(f"{c} double" for c in feats))
    got = [r.pred for r in m.predict(df).orderBy(F.expr("int(substring(scenario, 2))")).collect()]
    assert len(m.trees) == 600 and np.allclose(got, m.scores(x))
    curve = {(r.scenario, r.lap): r.predicted_delta for r in ML.curve_boosted(m, df, n_laps=5).collect()}
    hist = []
    for t in range(5):
        rate = np.mean(hist[-3:]) if t else 0.0
        acc = rate - np.mean(hist[-4:-1]) if t >= 2 else rate
        hist.append(m.scores(np.array([[x[7, 0], x[7, 1], t, rate, acc]]))[0])
    assert np.allclose([curve["s7", t] for t in range(5)], hist, atol=1e-4) and len(curve) == 200


def test_gbt_fast_path_with_validation_indicator(spark):
    df, feats = ML.training_frame(feature_store(spark, SF_SMALL))
    model = ML.boosted_fast(df.where(F.col("split") == "train"), df.where(F.col("split") == "val"), feats, max_iter=3)
    out = model.transform(ML.assemble(df.where(F.col("split") == "test"), feats))
    assert out.where(F.col("pred").isNull()).count() == 0 and out.count() > 0


def test_train_pipeline_end_to_end(spark):
    df, feats = ML.training_frame(feature_store(spark, SF_SMALL))
    paths = [f"{checkpoint_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("metrics", "model")]
    rows = {r.model: r for r in ML.train_pipeline(df, feats, *paths, n_trials=2, n_rounds=3, early_stopping=2).collect()}
    assert set(rows) == {"boosted_huber", "huber_baseline"} and rows["boosted_huber"].n == rows["huber_baseline"].n > 0
    want = (rows["huber_baseline"].mae - rows["boosted_huber"].mae) / rows["huber_baseline"].mae * 100
    assert math.isclose(rows["boosted_huber"].gain_pct, want, rel_tol=1e-6) and rows["huber_baseline"].gain_pct == 0
    assert len(ML.load_boosted(paths[1]).trees) >= 1
    # a second run replaces its rows
    assert ML.train_pipeline(df, feats, *paths, n_trials=1, n_rounds=2, early_stopping=2).count() == 2


def test_registered_fits_run_the_defaults(spark, monkeypatch):
    """Queries that fit or search use the library's own numbers of rounds and trials."""
    import inspect

    from pitlane.plans import q_models as Q

    trials = inspect.signature(ML.param_search).parameters["n_trials"].default

    class Stop(Exception):
        pass

    def seen(train, valid, features, params=None, **_):
        raise Stop(params.n_rounds)

    def searched(*args, **kw):
        raise Stop(len(args) == 3 and not kw)

    monkeypatch.setattr(Q.ML, "boosted_huber", seen)
    monkeypatch.setattr(Q.ML, "param_search", searched)
    monkeypatch.setattr(Q, "stored_once", lambda spark, sf, name, build: build("nowhere"))
    monkeypatch.setattr(Q, "frame", lambda *_: (spark.createDataFrame([("train",)], "split string"), []))
    for query in (Q.q_boosted_huber, Q.q_staged_metrics, Q.q_importance, Q.q_score_curve):
        with pytest.raises(Stop, match=f"^{Q.ML.BoostParams().n_rounds}$"):
            query(spark, "")
    for query in (Q.q_param_search, Q.q_train_pipeline):
        with pytest.raises(Stop, match="^True$"):
            query(spark, "")
    assert trials == 50
