"""Per-stint sequences (B1-B5) and the masked Huber loss.

A stint is a bounded group (at most one race distance of laps, ~80), so
``collect_list`` per stint holds a bounded array; the aggregation is keyed
by the stint, never by anything coarser. Arrays are built and cut with the
higher-order functions (``transform``, ``slice``, ``sequence``), which run
in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.functions.scalar import existing
from pitlane.operators.encode import global_row_index

SEQ_KEYS = list(K.STINT_KEYS)


def stint_sequences(
    df: DataFrame, feature_cols: list[str], target: str = K.TARGET, order_col: str = "stint_lap_number",
    keys: list[str] | None = None,
) -> DataFrame:
    """B1: one row per stint with ``X`` (L x F), ``y`` (L) and ``L``; laps with a
    null target are dropped, then stints shorter than 2 laps; null keys are
    dropped (as a pandas group-by does)."""
    keys = keys or SEQ_KEYS
    feats = existing(df, feature_cols)
    rows = df.where(F.col(target).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    item = F.struct(
        F.col(order_col).alias("o"),
        F.array(*[F.col(c).cast("double") for c in feats]).alias("x"),
        F.col(target).cast("double").alias("y"),
    )
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    return (
        g.select(
            *keys,
            F.size("__s").alias("L"),
            F.transform("__s", lambda s: s["x"]).alias("X"),
            F.transform("__s", lambda s: s["y"]).alias("y"),
        )
        .where(F.col("L") >= 2)
    )


def prefix_augment(seqs: DataFrame, min_len: int = 2) -> DataFrame:
    """B2: every prefix of length 2..L of each sequence (L - 1 rows per stint)."""
    return (
        seqs.withColumn("end", F.explode(F.sequence(F.lit(min_len), F.col("L"))))
        .withColumn("X", F.slice("X", 1, F.col("end")))
        .withColumn("y", F.slice("y", 1, F.col("end")))
        .withColumn("L", F.col("end"))
        .drop("end")
    )


def pad_batches(seqs: DataFrame, batch_size: int = K.SEQ_BATCH_SIZE, order: list[str] | None = None,
                n_features: int | None = None, by: str | None = None) -> DataFrame:
    """Batches of ``batch_size`` sequences in key order; each sequence padded
    with 0.0 to the longest in its batch, with a boolean step mask. ``by`` (a split) numbers its groups' batches
    apart, in the same pass."""
    order = order or SEQ_KEYS
    if by is None:
        idx = global_row_index(seqs, order, "__i")
    else:  # one order over all groups, less the rows of the groups before
        sizes = seqs.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy(F.col(by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(F.col(by).alias("__by"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
        idx = global_row_index(seqs, [by, *order], "__i").join(starts, F.col(by).eqNullSafe(F.col("__by")), "left")
        idx = idx.withColumn("__i", F.col("__i") - F.col("__first")).drop("__by", "__first")
    b = idx.withColumn("batch", (F.col("__i") / batch_size).cast("bigint")).drop("__i")
    b = b.withColumn("maxlen", F.max("L").over(Window.partitionBy(*([by] if by else []), "batch")))
    pad = F.col("maxlen") - F.col("L")
    zero_row = F.array_repeat(F.lit(0.0), F.size(F.element_at("X", 1))) if n_features is None \
        else F.array_repeat(F.lit(0.0), n_features)
    return b.select(
        *[c for c in seqs.columns if c not in ("X", "y")],
        "batch", "maxlen",
        F.concat("X", F.array_repeat(zero_row, pad)).alias("X_pad"),
        F.concat("y", F.array_repeat(F.lit(0.0), pad)).alias("y_pad"),
        F.transform(F.sequence(F.lit(1), F.col("maxlen")), lambda i: i <= F.col("L")).alias("mask"),
    )


def unpad(df: DataFrame, pred_col: str, target_col: str, len_col: str = "L",
          keys: list[str] | None = None) -> DataFrame:
    """Padded predictions/targets back to one row per real step."""
    keys = keys or SEQ_KEYS
    z = F.arrays_zip(
        F.slice(pred_col, 1, F.col(len_col)).alias("pred"),
        F.slice(target_col, 1, F.col(len_col)).alias("y"),
    )
    return df.select(*keys, F.posexplode(z).alias("pos", "__z")).select(
        *keys, "pos", F.col("__z.pred").alias("pred"), F.col("__z.y").alias("y"))


def huber(e: Column, delta: float = K.HUBER_DELTA) -> Column:
    a = F.abs(e)
    return F.when(a <= delta, 0.5 * e * e).otherwise(delta * (a - 0.5 * delta))


def masked_huber(df: DataFrame, pred_col: str, target_col: str, len_col: str = "L",
                 by: list[str] | None = None, delta: float = K.HUBER_DELTA) -> DataFrame:
    """Mean Huber loss over the real (unpadded) steps only."""
    steps = unpad(df, pred_col, target_col, len_col, keys=by or [])
    g = steps.groupBy(*(by or []))
    return g.agg(F.avg(huber(F.col("pred") - F.col("y"), delta)).alias("loss"), F.count(F.lit(1)).alias("n_steps"))


def request_matrix(df: DataFrame, laps_col: str, features: list[str],
                   scaler: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A request's ordered laps (array of structs) -> feature matrix; a
    missing feature is 0.0, then scaled with the fitted scaler. An empty
    request is an error row (``error`` column set, no matrix)."""
    fields = {f.name for f in df.schema[laps_col].dataType.elementType.fields}

    def row(lap):
        vals = []
        for c in features:
            # an absent feature is 0.0; a present null stays null
            v = lap[c].cast("double") if c in fields else F.lit(0.0)
            if scaler and c in scaler:
                m, s = scaler[c]
                v = (v - F.lit(m if m is not None else 0.0)) / F.lit(s)
            vals.append(v)
        return F.array(*vals)

    n = F.size(laps_col)
    return df.withColumn("X", F.when(n > 0, F.transform(laps_col, row))).withColumn(
        "error", F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("the request holds no lap")))


def round_array(c: Column | str, digits: int = 6, depth: int = 1) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    if depth == 1:
        return F.transform(x, lambda v: F.round(v, digits))
    return F.transform(x, lambda r: F.transform(r, lambda v: F.round(v, digits)))
