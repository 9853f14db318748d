"""Quantiles from merged sketches are exact, also where a sketch misses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.operators import quantiles as Q


@pytest.mark.parametrize("slack", [Q.SKETCH_SLACK, 0.0])
def test_merged_sketches_give_exact_quantiles(spark, monkeypatch, slack):
    monkeypatch.setattr(Q, "SKETCH_SLACK", slack)  # without slack most brackets miss and the second ranking runs
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30_000):
        year, rnd = (2023, int(rng.integers(1, 4))) if i % 3 else (2024, 1)  # one race holds a third
        rows.append((year, rnd, None if i % 11 == 0 else float(rng.normal()), float(i % 5), float("nan") if i % 7 else float(i), None))
    df = spark.createDataFrame(rows, "Year int, RoundNumber int, a double, b double, c double, d double").withColumn("g", F.when(F.col("Year") == 2024, "x").otherwise("y"))
    cols, probs = ["a", "b", "c", "d"], [0.0, 0.1, 0.5, 0.9, 1.0]
    sketches = Q.race_sketches(df, cols).withColumn("g", F.when(F.col("Year") == 2024, "x").otherwise("y"))
    assert sketches.select("Year", "RoundNumber").distinct().count() == 4 and sketches.where("name = 'd'").count() == 0
    got = {(r.group, r.name): (r.n, r.q) for r in Q.quantiles_from_sketches(df, sketches, cols, probs, "g").collect()}
    assert set(got) == {(g, c) for g in "xy" for c in "abc"}
    for (g, c), (n, q) in got.items():
        v = np.array([x for x in (r[2 + "abc".index(c)] for r in rows if (r[0] == 2024) == (g == "x")) if x is not None and x == x])
        assert n == len(v) and q == pytest.approx(np.quantile(v, probs).tolist())
    exact = {(r.group, r.name): (r.n, r.q) for r in Q.exact_quantiles(df, cols, probs, "g").collect()}
    assert exact == {k: (n, pytest.approx(q)) for k, (n, q) in got.items()}
