"""As-of (nearest) join J2 and interval assignment J3.

Spark has no public as-of or range join. Both are written with plain
DataFrame operators so they plan as hash exchanges + sorts, never as a
nested-loop or cartesian join:

* J2 ``asof_nearest``: tag-union of both sides, one window per group key
  ordered by time, a running ``last(..., ignorenulls)`` looking back and
  the same over the reverse order looking forward (one exchange, two sorts).
* J3 ``assign_intervals``: lap intervals ``[start, next start)`` tile each
  driver's time line. A running ``last`` over the (keys, time bucket) in time order
  gives each sample the lap that started last; a bucket with samples also gets the lap that is
  open when it begins, from a summary of one row a bucket. The keys include the time bucket, so one very
  long session of a single driver still spreads over many tasks, and an interval costs
  the same however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_L, _R = "__l", "__r"


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    right_cols: list[str],
    drop_null_left_if_right: bool = True,
    bucket: float | None = None,
    right_order: list[str] | None = None,
) -> DataFrame:
    """Each left row takes the right row nearest in time within its ``by`` group.

    No tolerance. A tie between the earlier and the later right row goes to
    the earlier one; duplicate right times keep the last row by ``right_order``
    columns (without one: the greatest row). Left rows
    with a null time are dropped when their group has right rows (as a
    sorted merge requires) and kept with null right columns otherwise. Right
    rows with a null time are ignored.

    With ``bucket`` (a width on the time scale) the work is split by time
    (see ``_asof_bucketed``), so a group holding a large share of all rows
    is spread over many tasks.
    """
    if bucket is not None:
        return _asof_bucketed(left, right, by, left_on, right_on, right_cols, drop_null_left_if_right, bucket, right_order)
    lcols = left.columns
    rsel = [F.col(c) for c in right_cols]
    # duplicates of a right time: keep one deterministic row (the greatest)
    r = (
        right.where(F.col(right_on).isNotNull())
        .groupBy(*by, F.col(right_on).alias("__t"))
        .agg(_kept(rsel, right_order))
    )
    lt = left.select(
        *[F.col(b) for b in by], F.col(left_on).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in lcols]).alias(_L), F.lit(None).cast(r.schema[_R].dataType).alias(_R),
    )
    rt = r.select(
        *by, "__t", F.lit(0).alias("__side"), F.lit(None).cast(lt.schema[_L].dataType).alias(_L), _R,
    )
    u = lt.unionByName(rt)
    # Backward: running last() in time order, right rows before left rows of
    # equal time (an exact match counts as backward). Forward: the same
    # running last() over the reverse time order. Both frames are
    # "unbounded preceding .. current row", which Spark evaluates
    # incrementally; a "current .. unbounded following" frame would be
    # re-aggregated for every row (quadratic per group).
    back_w = (
        Window.partitionBy(*by).orderBy(F.col("__t").asc_nulls_last(), F.col("__side").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fwd_w = (
        Window.partitionBy(*by).orderBy(F.col("__t").desc_nulls_last(), F.col("__side").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy(*by)
    rv = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col(_R).alias("v")))
    tagged = u.select(
        "__t", "__side", _L,
        F.last(rv, ignorenulls=True).over(back_w).alias("__b"),
        F.last(rv, ignorenulls=True).over(fwd_w).alias("__f"),
        F.max(F.when(F.col("__side") == 0, 1).otherwise(0)).over(whole).alias("__has_r"),
    )
    out = tagged.where(F.col("__side") == 1)
    if drop_null_left_if_right:
        out = out.where(F.col("__t").isNotNull() | (F.col("__has_r") == 0))
    bd = F.col("__t") - F.col("__b.t")
    fd = F.col("__f.t") - F.col("__t")
    pick = (
        F.when(F.col("__t").isNull(), F.lit(None))
        .when(F.col("__b.v").isNull(), F.col("__f.v"))
        .when(F.col("__f.v").isNull(), F.col("__b.v"))
        .when(bd <= fd, F.col("__b.v"))
        .otherwise(F.col("__f.v"))
    )
    return out.select(
        *[F.col(f"{_L}.{c}").alias(c) for c in lcols],
        *[pick.getField(c).alias(c) for c in right_cols],
    )


def _kept(rsel: list[Column], order: list[str] | None) -> Column:
    """The row kept among those of one right time."""
    row = F.struct(*rsel)
    return (F.max_by(row, F.struct(*map(F.col, order))) if order else F.max(row)).alias(_R)


def _pick(t: Column, back: Column, fwd: Column) -> Column:
    """Nearest of the two candidates (structs t, v); a tie goes backward."""
    bd = t - back.getField("t")
    fd = fwd.getField("t") - t
    return (
        F.when(t.isNull(), F.lit(None))
        .when(back.isNull(), fwd.getField("v"))
        .when(fwd.isNull(), back.getField("v"))
        .when(bd <= fd, back.getField("v"))
        .otherwise(fwd.getField("v"))
    )


def _asof_bucketed(left, right, by, left_on, right_on, right_cols, drop_null_left_if_right, bucket, right_order=None):
    """Two-level nearest as-of join.

    1. Both sides get a time bucket; the tag-union is windowed per (keys,
       bucket): the candidates inside the row's own bucket.
    2. A per-bucket summary (for buckets with right rows: their first and
       last right row; for buckets with left rows: a marker) is windowed per
       key to find, for every left bucket, the last right row of an earlier
       bucket and the first of a later one. It has one row per bucket, not
       per data row.
    3. Candidates: the own bucket's first, else the neighbouring buckets'.
    Left rows with a null time are handled apart (dropped when their key has
    right rows).
    """
    lcols = left.columns
    rsel = [F.col(c) for c in right_cols]

    def bkt(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(bucket))

    # struct types from the input schemas (no analysis of intermediate plans)
    lschema, rschema = left.schema, right.schema
    r_type = T.StructType([T.StructField(c, rschema[c].dataType, True) for c in right_cols])
    l_type = T.StructType([T.StructField(c, lschema[c].dataType, True) for c in lcols])
    r = (
        right.where(F.col(right_on).isNotNull())
        .groupBy(*by, F.col(right_on).alias("__t"))
        .agg(_kept(rsel, right_order))
        .withColumn("__k", bkt("__t"))
    )
    rv_type = F.struct(F.col("__t").alias("t"), F.col(_R).alias("v"))
    lt = left.where(F.col(left_on).isNotNull()).select(
        *[F.col(b) for b in by], F.col(left_on).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in lcols]).alias(_L), F.lit(None).cast(r_type).alias(_R),
        bkt(left_on).alias("__k"),
    )
    rt = r.select(*by, "__t", F.lit(0).alias("__side"), F.lit(None).cast(l_type).alias(_L), _R, "__k")
    part = [*by, "__k"]
    back_w = (Window.partitionBy(*part).orderBy(F.col("__t").asc(), F.col("__side").asc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fwd_w = (Window.partitionBy(*part).orderBy(F.col("__t").desc(), F.col("__side").asc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rv = F.when(F.col("__side") == 0, rv_type)
    inner = lt.unionByName(rt).select(
        *by, "__k", "__t", "__side", _L,
        F.last(rv, ignorenulls=True).over(back_w).alias("__b"),
        F.last(rv, ignorenulls=True).over(fwd_w).alias("__f"),
    ).where(F.col("__side") == 1)

    rb = r.groupBy(*by, "__k").agg(
        F.max_by(rv_type, F.col("__t")).alias("__last"), F.min_by(rv_type, F.col("__t")).alias("__first"))
    seed_type = T.StructType([T.StructField("t", rschema[right_on].dataType, True), T.StructField("v", r_type, True)])
    summ = (
        lt.select(*by, "__k").distinct()
        .select(*by, "__k", F.lit(None).cast(seed_type).alias("__last"), F.lit(None).cast(seed_type).alias("__first"),
                F.lit(1).alias("__side"))
        .unionByName(rb.withColumn("__side", F.lit(0)))
    )
    # a left-bucket row sorts before the right summary of its own bucket, so
    # it only sees strictly earlier (resp. later) buckets
    prev_w = (Window.partitionBy(*by).orderBy(F.col("__k").asc(), F.col("__side").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_w = (Window.partitionBy(*by).orderBy(F.col("__k").desc(), F.col("__side").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seeds = summ.select(
        *by, "__k", "__side",
        F.last("__last", ignorenulls=True).over(prev_w).alias("__pb"),
        F.last("__first", ignorenulls=True).over(next_w).alias("__nf"),
    ).where(F.col("__side") == 1).drop("__side")

    j = inner.join(seeds, part, "left")
    pick = _pick(F.col("__t"), F.coalesce(F.col("__b"), F.col("__pb")), F.coalesce(F.col("__f"), F.col("__nf")))
    out = j.select(*[F.col(f"{_L}.{c}").alias(c) for c in lcols], *[pick.getField(c).alias(c) for c in right_cols])

    nulls = left.where(F.col(left_on).isNull())
    if drop_null_left_if_right:
        nulls = nulls.join(r.select(*by).distinct(), by, "left_anti")
    nulls = nulls.select(*lcols, *[F.lit(None).cast(r_type[c].dataType).alias(c) for c in right_cols])
    return out.unionByName(nulls)


def next_start(
    laps: DataFrame,
    by: list[str],
    start: str,
    tie: str,
    last_span,
    end_col: str = "__end",
    slice_width: int = 3_600_000_000,
) -> DataFrame:
    """Interval end = next start in the group, or start + ``last_span``.

    Two levels: the next start inside the row's own time slice, else the first start of the group's next
    slice that has one. The second window holds one row a slice, so one car's laps spread over many tasks.
    """
    slice_ = F.floor(F.col(start) / F.lit(slice_width))
    d = laps.withColumn("__slice", slice_)
    firsts = d.where(F.col(start).isNotNull()).groupBy(*by, "__slice").agg(F.min(start).alias("__first"))
    later = firsts.select(
        *(F.col(k).alias(f"__r_{k}") for k in by), F.col("__slice").alias("__r_slice"),
        F.lead("__first").over(Window.partitionBy(*by).orderBy("__slice")).alias("__later"),
    )
    cond = F.col("__slice").eqNullSafe(F.col("__r_slice"))
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    w = Window.partitionBy(*by, "__slice").orderBy(F.col(start), F.col(tie))
    end = F.coalesce(F.lead(start).over(w), F.col("__later"), F.col(start) + last_span)
    out = d.join(later, cond, "left").withColumn(end_col, end)
    return out.drop("__slice", "__r_slice", "__later", *(f"__r_{k}" for k in by))


def assign_intervals(
    samples: DataFrame,
    laps: DataFrame,
    by: list[str],
    sample_t: str,
    lap_start: str,
    lap_end: str,
    lap_cols: list[str],
    bucket: int,
) -> DataFrame:
    """Attach to every sample the lap whose [start, end) contains it.

    The laps of a ``by`` group do not overlap (``next_start`` gives such ends), so the lap of a sample is the last one that
    started: a running ``last`` inside each time bucket. Two levels: a lap is in the bucket in which it starts, and a bucket with
    samples takes the last lap of the earlier buckets if that is still open. No lap is expanded over the buckets that
    it touches, so a gap of weeks between two starts costs one row.
    ``sample_t``, ``lap_start`` and ``lap_end`` are numeric on one scale
    (e.g. epoch microseconds); ``bucket`` is a width on that scale, many laps
    long. Samples outside every interval are dropped.
    """
    present = F.lit(True)
    for k in by:
        present = present & F.col(k).isNotNull()
    sample_cols = [c for c in samples.columns if c not in by]
    lp = laps.where(present & F.col(lap_start).isNotNull() & (F.col(lap_end) > F.col(lap_start))).select(
        *by, F.floor(F.col(lap_start) / bucket).alias("__b"),
        F.col(lap_start).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(lap_end).alias("__e"), *lap_cols).alias(_R))
    sm = samples.where(present & F.col(sample_t).isNotNull()).select(
        *by, F.floor(F.col(sample_t) / bucket).alias("__b"), F.col(sample_t).alias("__t"), F.lit(1).alias("__side"), F.struct(*sample_cols).alias(_L))
    # one row a bucket: its last lap, and a mark before it if samples ask for the lap of an earlier bucket
    lasts = lp.groupBy(*by, "__b").agg(F.max_by(F.struct("__t", _R), "__t").alias("__last")).withColumn("__side", F.lit(1))
    asked = sm.select(*by, "__b").distinct().withColumn("__side", F.lit(0))
    earlier = Window.partitionBy(*by).orderBy("__b", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = asked.unionByName(lasts, allowMissingColumns=True).withColumn("__last", F.last("__last", ignorenulls=True).over(earlier))
    carried = carried.where((F.col("__side") == 0) & (F.col(f"__last.{_R}.__e") > F.col("__b") * bucket)).select(
        *by, "__b", F.col("__last.__t").alias("__t"), "__side", F.col(f"__last.{_R}").alias(_R))
    started = Window.partitionBy(*by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lp.unionByName(carried).unionByName(sm, allowMissingColumns=True).withColumn(_R, F.last(_R, ignorenulls=True).over(started))
    types = {f.name: f.dataType for f in samples.schema.fields}
    return out.where((F.col("__side") == 1) & (F.col("__t") < F.col(f"{_R}.__e"))).select(
        *(F.col(k).cast(types[k]).alias(k) for k in by), *(F.col(f"{_L}.{c}").alias(c) for c in sample_cols), *(F.col(f"{_R}.{c}").alias(c) for c in lap_cols))
