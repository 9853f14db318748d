"""Audits, exploration and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.operators.quantiles import exact_quantiles


# --- audits on the feature table ------------------------------------------------

def target_stats(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """A4: mean, sample std and max of the target."""
    return df.agg(
        F.count(target).alias("n"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"), F.max(target).alias("max"),
    )


def null_rates(df: DataFrame, top: int | None = 10) -> DataFrame:
    """A5/L3: null rate of every column in one aggregation, unpivoted, highest
    first (ties by column name), top ``top``."""
    from pyspark.sql import types as T
    aggs = []
    for f in df.schema.fields:
        isnull = F.col(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            isnull = isnull | F.isnan(f.name)
        aggs.append(F.avg(isnull.cast("double")).alias(f.name))
    wide = df.agg(*aggs)
    long = wide.unpivot([], [f.name for f in df.schema.fields], "column", "null_rate")
    out = long.orderBy(F.col("null_rate").desc(), F.col("column").asc())
    return out.limit(top) if top else out


def filter_lists(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Sorted distinct non-null values per column, one row of arrays.
    ``collect_set`` deduplicates per partition first; the final row holds only
    distinct values (domain-sized: seasons, events, drivers, compounds)."""
    cols = cols or ["Year", "EventName", "Driver", "Compound"]
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])


def filter_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A8 in long form: (field, position, value) for each sorted distinct value."""
    cols = cols or ["Year", "EventName", "Driver", "Compound"]
    parts = []
    for c in cols:
        d = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value"), F.col(c).alias("__k")).distinct()
        w = Window.partitionBy(F.lit(c)).orderBy("__k")
        parts.append(d.select(F.lit(c).alias("field"), F.row_number().over(w).cast("int").alias("position"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filters_summary(df: DataFrame) -> DataFrame:
    """min/max/size of the years, size and first of events, size of drivers,
    the compound list."""
    lists = filter_lists(df)
    return lists.select(
        F.array_min("Year").alias("year_min"), F.array_max("Year").alias("year_max"),
        F.size("Year").alias("n_years"), F.size("EventName").alias("n_circuits"),
        F.element_at("EventName", 1).alias("first_circuit"), F.size("Driver").alias("n_drivers"),
        F.array_join("Compound", " ").alias("compounds"),
    )


def explore(
    df: DataFrame, year: int | None = None, circuit: str | None = None, driver: str | None = None,
    compound: str | None = None, limit: int = K.EXPLORE_DEFAULT_LIMIT, target: str = K.TARGET,
) -> DataFrame:
    """P9 + P6 + L2: optional equality filters (a falsy value means no filter),
    rows with null stint position or target dropped, sorted by (Driver, Stint,
    stint_lap_number) - plus the race and lap number so ties are decided -
    first ``limit`` rows (at most 5000). Plans as TakeOrderedAndProject."""
    if limit > K.EXPLORE_MAX_LIMIT:
        raise ValueError(f"limit must be <= {K.EXPLORE_MAX_LIMIT}")
    out = df
    for c, v in (("Year", year), ("EventName", circuit), ("Driver", driver), ("Compound", compound)):
        if v:
            out = out.where(F.col(c) == F.lit(v))
    out = out.na.drop(subset=["stint_lap_number", target])
    order = ["Driver", "Stint", "stint_lap_number", "Year", "RoundNumber", "LapNumber"]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order if c in out.columns]).limit(limit)


def slice_summary(rows: DataFrame, target: str = K.TARGET, head: int = 8) -> DataFrame:
    """A10: count, mean and max of the delta over non-null values, and the
    distinct events among the first ``head`` rows (rows carry ``__pos``)."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("avg_delta"), F.max(target).alias("max_delta"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("__pos") <= head, F.col("EventName")))), ", ")
        .alias("sample_events"),
    )


# --- predictions and metrics --------------------------------------------------

def fit_line(train: DataFrame, x: str = "stint_lap_number", y: str = K.TARGET) -> dict[str, float]:
    """Closed-form least-squares line (the reference predictor for metric checks)."""
    r = train.agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.avg(y).alias("ybar")).collect()[0]
    return {"a": r["a"], "b": r["b"], "ybar": r["ybar"]}


def predict_line(df: DataFrame, fit: dict[str, float], x: str = "stint_lap_number", out: str = "pred") -> DataFrame:
    return df.withColumn(out, F.lit(fit["a"]).cast("double") + F.lit(fit["b"]).cast("double") * F.col(x))


def regression_metrics(df: DataFrame, pred: str = "pred", y: str = K.TARGET, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R^2 in one aggregation (SST = var_pop(y) * n, numerically stable)."""
    e = F.col(pred) - F.col(y)
    g = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    g = g.groupBy(*by) if by else g.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def tolerance_bias(df: DataFrame, pred: str = "pred", y: str = K.TARGET, by: str = "split",
                   ref: str = "train") -> DataFrame:
    """Share within 0.3 s and 0.5 s, over- and under-prediction shares per
    group, and the MAE gap to the reference group (val - train)."""
    e = F.col(pred) - F.col(y)
    per = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.abs(e) < K.TIGHT_TOL, 1.0).otherwise(0.0)).alias("within_tight"),
        F.avg(F.when(F.abs(e) < K.LOOSE_TOL, 1.0).otherwise(0.0)).alias("within_loose"),
        F.avg(F.when(e > 0, 1.0).otherwise(0.0)).alias("over"),
        F.avg(F.when(e < 0, 1.0).otherwise(0.0)).alias("under"),
    )
    # the reference MAE over this few-row table (one row per split)
    ref_mae = F.max(F.when(F.col(by) == ref, F.col("mae"))).over(Window.partitionBy())
    return per.withColumn("gap_mae", F.col("mae") - ref_mae)


def gain(baseline_mae: Column, model_mae: Column) -> tuple[Column, Column]:
    """Improvement over the baseline in percent and the < 15 % flag."""
    pct = F.try_divide(baseline_mae - model_mae, baseline_mae) * 100.0
    return pct, pct < K.MIN_GAIN_PCT


def best_model(metrics: DataFrame, by: str = "split") -> DataFrame:
    """Per split, the model with the lowest MAE (ties: smallest name; models without one do not compete)."""
    known = metrics.where(F.col("mae").isNotNull() & ~F.isnan("mae"))
    return known.groupBy(by).agg(
        F.min_by("model", F.struct("mae", "model")).alias("best_model"), F.min("mae").alias("best_mae"))


def residual_box(df: DataFrame, pred: str = "pred", y: str = K.TARGET) -> DataFrame:
    """Per compound (null -> UNKNOWN) box statistics of residual = pred - y:
    quartiles and the whiskers (extreme values within 1.5 IQR), no outliers."""
    r = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).select(
        F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("Compound"),
        (F.col(pred) - F.col(y)).alias("r"),
    )
    q = exact_quantiles(r, ["r"], [0.25, 0.5, 0.75], "Compound").select(
        F.col("group").alias("Compound"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    j = r.join(q, "Compound")
    return j.groupBy("Compound", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("r") >= F.col("q1") - 1.5 * iqr, F.col("r"))).alias("whisker_low"),
        F.max(F.when(F.col("r") <= F.col("q3") + 1.5 * iqr, F.col("r"))).alias("whisker_high"),
    )


def residual_hist(df: DataFrame, pred: str = "pred", y: str = K.TARGET, bins: int = K.RESIDUAL_BINS) -> DataFrame:
    """Residual histogram, ``bins`` equal bins over min..max (the maximum
    goes to the last bin)."""
    r = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull()).select((F.col(pred) - F.col(y)).alias("r"))
    lo, hi = r.agg(F.min("r"), F.max("r")).collect()[0]
    if lo is None:
        return r.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else None
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("r") - F.lit(lo), F.lit(hi - lo)) * bins)).cast("int")
    h = r.groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width or 0.0)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width or 0.0)).alias("hi"),
        "n",
    )


def axis_limits(df: DataFrame, pred: str = "pred", y: str = K.TARGET) -> DataFrame:
    """Common axis limits of predicted vs actual."""
    g = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    return g.agg(
        F.least(F.min(y), F.min(pred)).alias("lim_low"), F.greatest(F.max(y), F.max(pred)).alias("lim_high"),
        F.count(F.lit(1)).alias("n_points"),
    )


def pred_actual_points(df: DataFrame, pred: str = "pred", y: str = K.TARGET) -> DataFrame:
    """The points of the predicted-against-actual chart (null compound -> UNKNOWN)."""
    g = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    return g.select(F.coalesce(F.col("Compound"), F.lit(K.UNKNOWN_COMPOUND)).alias("Compound"), F.col(y).alias("actual"), F.col(pred).alias("predicted"))


def split_counts(df: DataFrame, n_features: int, by: str = "split") -> DataFrame:
    """Rows per split and the feature matrix width."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_features", F.lit(n_features))


def seeded_sample(df: DataFrame, n: int, key: Column) -> DataFrame:
    """L4: a seeded sample of min(n, rows) rows: order by a hash of a key, take n."""
    return df.orderBy(key, *df.columns[:1]).limit(n)


def hash_key(cols: list[str], seed: int = K.IMPORTANCE_SEED) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))
