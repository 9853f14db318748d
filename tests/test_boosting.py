"""Leaf refit, best-first pruning, column and row samples, and the concurrent search (M2, M3)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_compare import SF_SMALL
from pitlane import constants as K
from pitlane.plans import boosting as B
from pitlane.plans import models as ML
from pitlane.plans.store import feature_store


def full_tree(depth, rng, features=3):
    n, leaves = 2**depth - 1, 2**depth
    # preorder, as Spark prints it
    feature, threshold, left, right = [], [], [], []

    def add(d):
        i = len(feature)
        feature.append(int(rng.integers(features)) if d else -1)
        threshold.append(float(rng.normal()) if d else 0.0)
        left.append(-1)
        right.append(-1)
        if d:
            left[i] = add(d - 1)
            right[i] = add(d - 1)
        return i

    add(depth)
    assert len(feature) == n + leaves
    return B.Tree(*(np.array(x) for x in (feature, threshold, left, right)), np.zeros(n + leaves), np.zeros(features))


def best_first(tree, leaf, r, p):
    """Brute force: from one leaf on, split the leaf with the largest gain, computed from the rows themselves."""
    def under(i):
        return {i} if tree.feature[i] < 0 else under(tree.left[i]) | under(tree.right[i])

    rows = lambda i: np.isin(leaf, list(under(i)))
    st = lambda g: np.sign(g) * max(abs(g) - p.reg_alpha, 0)
    worth = lambda i: st(r[rows(i)].sum()) ** 2 / (rows(i).sum() + p.reg_lambda) if rows(i).any() else 0.0
    leaves = [0]
    while len(leaves) < (p.num_leaves or 10**9):
        gains = [(worth(tree.left[i]) + worth(tree.right[i]) - worth(i), i) for i in leaves if tree.feature[i] >= 0]
        if not gains or max(gains)[0] <= 0:
            break
        i = max(gains, key=lambda g: (g[0], -g[1]))[1]
        leaves.remove(i)
        leaves += [tree.left[i], tree.right[i]]
    out = np.zeros(len(r))
    for i in leaves:
        if rows(i).any():
            out[rows(i)] = st(r[rows(i)].sum()) / (rows(i).sum() + p.reg_lambda)
    return out, len(leaves)


@pytest.mark.parametrize("leaves,l1,l2", [(None, 0.0, 0.0), (5, 0.0, 3.0), (9, 2.0, 0.5), (1, 0.3, 1.0), (None, 1e9, 0.0)])
def test_refit_equals_brute_force(leaves, l1, l2):
    rng = np.random.default_rng(7)
    tree = full_tree(5, rng)
    x, r = rng.normal(size=(400, 3)), rng.normal(size=400)
    at = tree.leaf(x)
    p = B.BoostParams(num_leaves=leaves, reg_alpha=l1, reg_lambda=l2)
    n = len(tree.feature)
    got = B.refit(tree, np.bincount(at, r, n), np.bincount(at, minlength=n), p, 3)
    want, count = best_first(tree, at, r, p)
    assert np.allclose(got.predict(x), want) and (got.feature < 0).sum() == count
    values, places = B.full_leaf_values(tree, got), np.flatnonzero(tree.feature < 0).tolist()
    assert np.allclose([values[places.index(i)] for i in at], want)
    assert (got.importance >= 0).all() and (got.importance.sum() > 0) == (count > 1)


def matrices(spark):
    df, feats = ML.training_frame(feature_store(spark, SF_SMALL))
    return [B.matrix(df.where(F.col("split") == s), feats) for s in ("train", "val")], feats


def test_each_parameter_changes_the_model(spark):
    (train, _), feats = matrices(spark)
    base = dict(max_depth=4, min_instances=3, seed=1)

    def signature(**kw):
        m = B.Boosting(train, None, feats, B.BoostParams(**{**base, **kw})).run(2)
        return [(t.feature.tolist(), np.round(t.value, 9).tolist()) for t in m.trees]

    same = signature()
    assert same == signature()
    for kw in (dict(num_leaves=3), dict(reg_alpha=5.0), dict(reg_lambda=20.0), dict(feature_fraction=0.3), dict(bagging_fraction=0.5)):
        assert signature(**kw) != same, kw


def test_scores_follow_the_trees_across_cuts(spark):
    (train, valid), feats = matrices(spark)
    m = B.Boosting(train, valid, feats, B.BoostParams(max_depth=3, min_instances=3, checkpoint_every=2, learning_rate=0.5)).run(5)
    model = ML.BoostedModel(m.init, 0.5, m.trees, feats, [])
    got = m.sides["valid"].withColumn("s", m.score()).join(model.predict(valid).select(B.ROW, "pred"), B.ROW)
    assert got.agg(F.max(F.abs(F.col("s") - F.col("pred")))).first()[0] < 1e-9
    errors = [B.mean_error(ML.BoostedModel(m.init, 0.5, m.trees[:k], feats, []).predict(valid), F.col("pred")) for k in range(1, 6)]
    assert m.pending == 0 and not m.held and m.best == pytest.approx(min(errors)) and m.best_round == 1 + int(np.argmin(errors))


def test_halving_runs_every_trial_and_keeps_the_best(spark):
    (train, valid), feats = matrices(spark)
    got = B.halving_search(train, valid, feats, n_trials=6, n_rounds=4, early_stopping=4, first=1, share=2, workers=3).collect()
    assert sorted(r.trial for r in got) == list(range(6))
    assert sorted(r.n_rounds for r in got) == [1, 1, 1, 2, 4, 4] and sum(r.finished for r in got) == 2
    one = next(r for r in got if r.finished)
    d = B.draw_params(6)[one.trial]
    alone = B.Boosting(train, valid, feats, B.to_boost(d, 4, 4)).run(4)
    assert alone.best == pytest.approx(one.val_mae) and len(alone.kept()) == one.n_trees
    assert B.rungs(100, 6, 4) == [6, 24, 96, 100] and B.rungs(3, 6, 4) == [3]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_space_has_the_nine_ranges():
    assert len(B.SEARCH_SPACE) == 9 and B.to_boost(B.draw_params(1)[0], 5, 2).alpha == K.HUBER_ALPHA


def test_rows_are_drawn_as_by_sparks_hash(spark):
    rows = [0, 1, 7, 2**33 + 5, 2**40 + 123456]
    d = spark.createDataFrame([(r,) for r in rows], f"{B.ROW} long")
    for seed in (1, 42, 47):
        want = [r[0] for r in d.select(F.pmod(F.xxhash64(F.col(B.ROW), F.lit(seed)), F.lit(1 << 20))).collect()]
        assert B.row_luck(np.array(rows), seed).tolist() == want


def test_borders_are_midpoints_of_about_equal_rows():
    assert B.cut_points(np.array([1.0, 1.0, 3.0, np.nan]), 32).tolist() == [2.0] and not len(B.cut_points(np.zeros(5), 32))
    cuts = B.cut_points(np.arange(3200.0), 32)
    sizes = np.bincount(np.searchsorted(cuts, np.arange(3200.0)))
    assert len(cuts) == 31 and sizes.min() >= 99 and sizes.max() <= 101


def test_a_level_of_all_models_is_one_job(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    rows = [(i, float(np.sign(a) + 0.2 * b), float(a), float(b)) for i, (a, b) in enumerate(x)]
    train = spark.createDataFrame(rows, f"{B.ROW} long, {B.Y} double, a double, b double")
    asked, real = [], B.level_splits
    monkeypatch.setattr(B, "level_splits", lambda state, some, models: asked.append(len(some)) or real(state, some, models))
    params = [B.BoostParams(max_depth=d, min_instances=5) for d in (2, 2, 1)]
    side = B.SideBySide({"train": train, "valid": train}, ["a", "b"], params)
    side.run(1)
    assert asked == [3, 2] and [len(m.trees) for m in side.models] == [1, 1, 1]
    assert all(m.trees[0].feature[0] == 0 and abs(m.trees[0].threshold[0]) < 0.2 for m in side.models)
    model = ML.BoostedModel(side.init, 0.1, side.models[1].trees, ["a", "b"], [])
    assert side.models[1].best == pytest.approx(B.mean_error(model.predict(train), F.col("pred")))


def test_a_level_adds_up_without_a_shuffle_and_as_with_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, float(a * a + b), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))]
    train = spark.createDataFrame(rows, f"{B.ROW} long, {B.Y} double, a double, b double").repartition(3)

    def trained(group):
        side = B.SideBySide({"train": train, "valid": train}, ["a", "b"], [B.BoostParams(max_depth=3, min_instances=5, checkpoint_every=9)])
        spark.sparkContext.setJobGroup(group, group)
        side._round([0])
        errors = side.errors()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        t = side.models[0].trees[0]
        return jobs, errors, [x.tolist() for x in (t.feature, t.threshold, t.left, t.right, t.value)]

    few, errors, tree = trained("sums on the driver")
    assert few == 4  # three levels and the errors, a stage each
    monkeypatch.setattr(B, "SUMS_TO_DRIVER", 0)
    more, same_errors, same_tree = trained("sums by a shuffle")
    assert more > few and same_tree[0] == tree[0] and same_errors == pytest.approx(errors)
    assert all(a == pytest.approx(b) for a, b in zip(same_tree, tree, strict=True))  # tasks get their blocks in any order


def test_blocks_stay_small_however_many_models_train(spark):
    """A task reads, writes and scores some hundred KB at a time; what it sums at a time has as many rows as before."""
    train = spark.range(12_000).select(F.col("id").alias(B.ROW), F.rand(1).alias(B.Y), F.rand(2).alias("a"), F.rand(3).alias("b"))
    side = B.SideBySide({"train": train, "valid": train.limit(500)}, ["a", "b"], [B.BoostParams(max_depth=2)] * 50)
    side.run(1)
    got = side.state.select("side", "n", F.octet_length("scores").alias("bytes")).collect()
    assert sum(r.n for r in got if r.side == "train") == 12_000 and sum(r.n for r in got if r.side == "valid") == 500
    assert all(r.bytes == 50 * 8 * r.n for r in got) and max(r.bytes for r in got) <= B.BLOCK_BYTES

    rng = np.random.default_rng(1)
    parts = [("train", np.arange(n), rng.normal(size=n), rng.integers(0, 9, (2, n)), rng.normal(size=(3, n))) for n in (4, 5, 3, 9, 1)]
    found = list(B.joined(iter(parts), 10))
    assert [len(x[0]) for x in found] == [9, 3, 10]
    assert all((np.concatenate([f[i] for f in found], axis=-1) == np.concatenate([p[i + 1] for p in parts], axis=-1)).all() for i in range(4))
