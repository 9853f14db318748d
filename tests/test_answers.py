"""Permutation importance in one pass, answers per lap, and padded batches of all splits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane import constants as K
from pitlane.operators import metrics as M
from pitlane.operators import sequences as S
from pitlane.plans import models as ML


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1024])
def test_permutations_are_permutations(n):
    maps = ML.permutations(n, 6, 3)
    i = np.arange(n)
    for a, b in maps:
        assert sorted(((a * i + b) % n).tolist()) == i.tolist()
    assert maps == ML.permutations(n, 6, 3)


def test_importance_equals_numpy_and_is_one_join(spark, monkeypatch):
    monkeypatch.setattr(ML, "ROWS_A_RANGE", 40)  # several ranges
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] + 0.1 * x[:, 1]
    rows = [(2024, 1, f"D{i % 5}", i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"Year int, RoundNumber int, Driver string, LapNumber int, a double, b double, c double, {K.TARGET} double")
    seen = []

    def predict(d):
        seen.append(d)
        return d.withColumn("pred", 2 * F.col("a") + 0.1 * F.col("b"))

    key = ["Year", "RoundNumber", "Driver", "LapNumber"]
    got = {r.feature: r.mae_increase for r in ML.permutation_importance(predict, df, ["a", "b", "c"], key=key).collect()}
    numbers, n = ML.numbered(df, M.hash_key(key, K.IMPORTANCE_SEED + 1), key)
    order = [r.LapNumber for r in numbers.orderBy("__i").collect()]
    assert n == 300 and sorted(order) == list(range(300))
    xo, yo = x[order], y[order]
    for j, (name, (a, b)) in enumerate(zip("abc", ML.permutations(n, 3, K.IMPORTANCE_SEED))):
        moved = xo.copy()
        moved[(a * np.arange(n) + b) % n, j] = xo[:, j]
        want = np.abs(2 * moved[:, 0] + 0.1 * moved[:, 1] - yo).mean() - np.abs(2 * xo[:, 0] + 0.1 * xo[:, 1] - yo).mean()
        assert got[name] == pytest.approx(want, abs=1e-9)
    assert got["a"] > got["b"] > 0 and got["c"] == pytest.approx(0)
    assert len(seen) == 1  # one plan serves all features


def test_answers_follow_the_request(spark):
    schema = "id int, laps array<struct<stint_lap_number:double, x:double>>"
    requests = spark.createDataFrame([(1, [(3.0, 1.0), (9.0, None), (4.0, 2.0), (5.0, 0.0), (1.0, 1.0)]), (2, []), (3, None), (4, [(2.0, 5.0)])], schema)
    feats = ["stint_lap_number", "x", "deg_rate_last_3", "deg_acceleration"]
    asked = S.request_matrix(requests, "laps", feats)
    line = lambda lap, x, rate, acc: 0.1 * lap + x + 0.5 * rate - 0.2 * acc
    got = {r.id: (r.answers, r.error) for r in ML.lap_answers(asked, lambda m: line(*m.T), 4, rate_at=2, acc_at=3).collect()}
    assert got[2] == got[3] == (None, "the request holds no lap")
    want, hist = [], []
    for lap, x in [(3.0, 1.0), (9.0, None), (4.0, 2.0), (5.0, 0.0), (1.0, 1.0)]:
        rate = sum(hist[-3:]) / len(hist[-3:]) if hist else 0.0
        prev = hist[-4:-1]
        acc = rate - sum(prev) / len(prev) if len(hist) >= 2 else rate
        v = line(lap, x, rate, acc) if x is not None else None
        want.append(v)
        hist.append(v or 0.0)
    assert got[1][1] is None and got[1][0][1] is None
    assert [round(v, 9) for v in got[1][0] if v is not None] == [round(v, 9) for v in want if v is not None]
    assert got[4] == ([pytest.approx(5.2)], None)


def test_batches_of_all_splits_in_one_pass_equal_split_by_split(spark):
    rows = [(2024, r, d, s, sp, n, [[1.0, 2.0]] * n, [0.5] * n) for sp, m in (("test", 40), ("train", 90), ("val", 3))
            for i in range(m) for r, d, s, n in [(i % 4, f"D{i % 7}", i, 2 + i % 5)]]
    df = spark.createDataFrame(rows, "Year int, RoundNumber int, Driver string, Stint int, split string, L int, X array<array<double>>, y array<double>")
    key = lambda r: (r.split, r.RoundNumber, r.Driver, r.Stint)
    got = {key(r): (r.batch, r.maxlen, r.mask) for r in S.pad_batches(df, by="split").collect()}
    want = {key(r): (r.batch, r.maxlen, r.mask) for sp in ("train", "val", "test") for r in S.pad_batches(df.where(F.col("split") == sp)).collect()}
    assert got == want and len(got) == 133
