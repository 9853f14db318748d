"""Temporal joins against brute-force Python on small random inputs."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitlane.operators.temporal_joins import asof_nearest, assign_intervals, next_start

times = st.integers(min_value=0, max_value=60).map(float)


def brute_asof(left, right):
    """Nearest right row per group; tie -> earlier; duplicate times -> greatest value;
    null left time dropped when the group has right rows."""
    out = []
    for g, t in left:
        rs = [(rt, v) for rg, rt, v in right if rg == g]
        if t is None:
            if not rs:
                out.append((g, t, None))
            continue
        if not rs:
            out.append((g, t, None))
            continue
        best = {}
        for rt, v in rs:
            best[rt] = max(best.get(rt, v), v)
        back = [rt for rt in best if rt <= t]
        fwd = [rt for rt in best if rt >= t]
        b = max(back) if back else None
        f = min(fwd) if fwd else None
        if b is None:
            pick = f
        elif f is None:
            pick = b
        else:
            pick = b if t - b <= f - t else f
        out.append((g, t, best[pick]))
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), times)), min_size=1, max_size=12),
    right=st.lists(st.tuples(st.integers(0, 2), times, st.integers(0, 9)), max_size=10),
    width=st.sampled_from([None, 4.0, 25.0]),
)
def test_asof_matches_brute_force(spark, left, right, width):
    ldf = spark.createDataFrame(left, "g int, t double")
    rdf = spark.createDataFrame(right, "g int, Time double, v int")
    got = sorted(map(tuple, asof_nearest(ldf, rdf, ["g"], "t", "Time", ["v"], bucket=width).collect()), key=repr)
    assert got == brute_asof(left, right)


def brute_intervals(laps, samples, last_span):
    """Each sample to the lap with start <= t < next start (ordered by start, lap);
    the last lap ends at start + last_span."""
    out = []
    by_driver = {}
    for d, lap, s in laps:
        by_driver.setdefault(d, []).append((s, lap))
    for d, t in samples:
        ls = sorted(by_driver.get(d, []))
        for i, (s, lap) in enumerate(ls):
            e = ls[i + 1][0] if i + 1 < len(ls) else s + last_span
            if s <= t < e:
                out.append((d, t, lap))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    starts=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 300)), min_size=1, max_size=10, unique=True),
    samples=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 500)), max_size=25),
    bucket=st.sampled_from([7, 60, 1000]),
)
def test_intervals_match_brute_force(spark, starts, samples, bucket):
    laps = [(d, i + 1, s) for i, (d, s) in enumerate(starts)]
    ldf = spark.createDataFrame(laps, "d int, LapNumber int, s bigint")
    sdf = spark.createDataFrame(samples, "d int, t bigint")
    lp = next_start(ldf, ["d"], "s", "LapNumber", F.lit(100))
    got = sorted(map(tuple, assign_intervals(sdf, lp, ["d"], "t", "s", "__end", ["LapNumber"], bucket)
                     .select("d", "t", "LapNumber").collect()))
    assert got == brute_intervals(laps, samples, 100)


def test_assign_intervals_many_short_laps_in_one_bucket(spark):
    """Each sample meets its own lap only: a bucket of n laps and n samples gives no n * n pairs on the way."""
    n = 3000
    laps = spark.createDataFrame([(1, 10 * i, i) for i in range(n)] + [(None, 5, 9), (1, 0, -1)], "d long, s long, LapNumber int")
    samples = spark.createDataFrame([(1, 10 * i + i % 10, i) for i in range(n)] + [(1, -1, -5), (None, 6, -6), (2, 6, -7), (1, None, -8)], "d long, t long, want int")
    lp = next_start(laps, ["d"], "s", "LapNumber", 5)
    got = assign_intervals(samples, lp, ["d"], "t", "s", "__end", ["LapNumber"], 1_000_000)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    rows = got.collect()
    assert got.columns == ["d", "t", "want", "LapNumber"] and sorted(r.want for r in rows) == [i for i in range(n) if i < n - 1 or i % 10 < 5]
    assert all(r.want == r.LapNumber for r in rows)


def test_assign_intervals_over_a_long_gap(spark):
    """A lap that lasts until a start of years later costs one row, not one a time bucket."""
    far = 10_000_000_000_000
    lp = next_start(spark.createDataFrame([("a", 0, 1), ("a", far, 2), ("b", 5, 1)], "d string, s long, LapNumber int"), ["d"], "s", "LapNumber", F.lit(50))
    samples = spark.createDataFrame([("a", 3, 1.0), ("a", far // 2, 2.0), ("a", far - 1, 3.0), ("a", far, 4.0), ("a", far + 50, 5.0), ("b", far, 6.0), ("b", 54, 7.0), ("c", 1, 8.0)], "d string, t long, Speed double")
    got = assign_intervals(samples, lp, ["d"], "t", "s", "__end", ["LapNumber"], 7)
    assert sorted((r.d, r.Speed, r.LapNumber) for r in got.collect()) == [("a", 1.0, 1), ("a", 2.0, 1), ("a", 3.0, 1), ("a", 4.0, 2), ("b", 7.0, 1)]
