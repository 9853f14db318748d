"""Exact quantiles at any size.

A first pass brackets every quantile with ``percentile_approx`` at probabilities a little below and above it
(its rank error is at most n / accuracy, so the bracket holds the wanted rank). A second pass counts the values
below each bracket and, per distinct value, those inside it; only those few values, some 8 / accuracy of the rows, are ranked by a window. No
row count decides the method. ``quantiles_from_sketches`` takes the brackets from sketches that were landed race by race instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.session import land

ACCURACY = 10_000
BROADCAST_GROUPS = 100_000  # brackets (group x column) that are broadcast; more are joined by shuffle


def _long(df: DataFrame, cols: list[str], by: str | None) -> DataFrame:
    """(group, name, v): the non-null, non-NaN values of the columns."""
    group = F.col(by) if by else F.lit(None).cast("string")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols)))
    return df.select(group.alias("group"), pairs.alias("x")).select("group", "x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None) -> DataFrame:
    """(group, name, n, q): interpolated quantiles of the non-null, non-NaN values of each column, per group."""
    long = _long(df, cols, by)
    # up to ACCURACY values are their own bracket; beyond, 4 / accuracy on either side is four ranks or more: the
    # approximation's error, and both neighbours of an interpolated rank
    ends = [min(max(p + s * 4 / ACCURACY, 0.0), 1.0) for p in probs for s in (-1, 1)]
    small = F.col("n") <= ACCURACY
    stats = long.groupBy("group", "name").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = land(stats, "brackets")  # a row a group and column; else counting them would run this pass twice
    wanted = F.explode(F.array(*(F.struct(
        F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("rank"),
        F.when(small | F.lit(ends[2 * i] == 0.0), F.col("lo")).otherwise(F.col("b")[2 * i]).alias("lo"),
        F.when(small | F.lit(ends[2 * i + 1] == 1.0), F.col("hi")).otherwise(F.col("b")[2 * i + 1]).alias("hi"),
    ) for i, p in enumerate(probs))))
    return _rolled(_ranked_inside(long, stats.select("group", "name", "n", wanted.alias("w")).select("group", "name", "n", "w.*")))


def _ranked_inside(long: DataFrame, brackets: DataFrame) -> DataFrame:
    """(group, name, n, i, q) from brackets (group, name, n, i, rank, lo, hi): one pass counts what is below and ranks what is inside.

    ``q`` is null where the wanted rank is not inside its bracket.
    """
    brackets = brackets.withColumnsRenamed({"group": "g", "name": "c"})
    few = brackets.count() <= BROADCAST_GROUPS
    keys = F.col("group").eqNullSafe(F.col("g")) & (F.col("name") == F.col("c"))
    near = long.join(F.broadcast(brackets) if few else brackets, keys).where(F.col("v") <= F.col("hi"))
    below = F.col("v") < F.col("lo")
    # values under the bracket become one row
    counts = near.groupBy("group", "name", "n", "i", "rank", F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("group", "name", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("end", F.sum("m").over(upto))
    inside = F.col("v").isNotNull()
    at = lambda r: F.min(F.when(inside & (F.col("end") > r), F.col("v")))
    lower, upper = F.floor("rank"), F.ceil("rank")
    under = F.coalesce(F.max(F.when(~inside, F.col("end"))), F.lit(0))
    found = placed.groupBy("group", "name", "n", "i", "rank").agg(at(lower).alias("a"), at(upper).alias("z"), under.alias("under"))
    value = F.when(lower == upper, F.col("a")).otherwise((upper - F.col("rank")) * F.col("a") + (F.col("rank") - lower) * F.col("z"))
    return found.select("group", "name", "n", "i", F.when(F.col("under") <= lower, value).alias("q"))


def _rolled(found: DataFrame) -> DataFrame:
    out = found.groupBy("group", "name", "n").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("q"))
    return out.select("group", "name", "n", F.transform("q", lambda x: x["q"]).alias("q"))


# --- mergeable sketches ------------------------------------------------------------

SKETCH_K = 1024
#: Half a bracket's width in normalised rank: several times the sketch's error at SKETCH_K.
SKETCH_SLACK = 0.01


def race_sketches(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ("Year", "RoundNumber")) -> DataFrame:
    """(keys, name, sketch, n, lo, hi): a quantile sketch of each column and race, in one aggregate over the rows.

    A table that is landed race by race keeps them beside it; any set of races is served by merging theirs.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = [F.struct(F.lit(c).alias("name"), F.kll_sketch_agg_double(value(c), SKETCH_K).alias("sketch"), F.count(value(c)).alias("n"),
                     F.min(value(c)).alias("lo"), F.max(value(c)).alias("hi")).alias(f"__{i}") for i, c in enumerate(cols)]
    wide = df.groupBy(*keys).agg(*each)
    return wide.select(*keys, F.explode(F.array(*(f"__{i}" for i in range(len(cols))))).alias("x")).select(*keys, "x.*").where(F.col("n") > 0)


def quantiles_from_sketches(df: DataFrame, sketches: DataFrame, cols: list[str], probs: list[float], by: str) -> DataFrame:
    """``exact_quantiles`` with brackets from the merged ``sketches`` (which have the group ``by``): one pass over the rows.

    A sketch errs with a small probability. Where a wanted rank turns out not to be inside its bracket, that column and group is
    ranked again between its exact smallest and largest value, so the result is exact in any case.
    """
    ends = [min(max(p + s * SKETCH_SLACK, 0.0), 1.0) for p in probs for s in (-1, 1)]
    merged = sketches.where(F.col("name").isin(cols)).groupBy(F.col(by).alias("group"), "name").agg(
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stats = land(merged.select("group", "name", "n", "lo", "hi", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ends))).alias("b")), "brackets")
    wanted = lambda wide: F.explode(F.array(*(F.struct(
        F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("rank"),
        (F.col("lo") if wide or ends[2 * i] == 0.0 else F.col("b")[2 * i]).alias("lo"),
        (F.col("hi") if wide or ends[2 * i + 1] == 1.0 else F.col("b")[2 * i + 1]).alias("hi"),
    ) for i, p in enumerate(probs))))
    brackets = lambda rows, wide: rows.select("group", "name", "n", wanted(wide).alias("w")).select("group", "name", "n", "w.*")
    long = _long(df, cols, by)
    found = land(_ranked_inside(long, brackets(stats, False)), "quantiles")
    missed = stats.join(found.where(F.col("q").isNull()).select(F.col("group").alias("g"), F.col("name").alias("c")).distinct(),
                        F.col("group").eqNullSafe(F.col("g")) & (F.col("name") == F.col("c")), "left_semi")
    if not missed.isEmpty():
        again = _ranked_inside(long, brackets(missed, True)).select("group", "name", "i", F.col("q").alias("__q")).withColumnsRenamed({"group": "g", "name": "c", "i": "j"})
        same = F.col("group").eqNullSafe(F.col("g")) & (F.col("name") == F.col("c")) & (F.col("i") == F.col("j"))
        found = found.join(again, same, "left").select("group", "name", "n", "i", F.coalesce("q", "__q").alias("q"))
    return _rolled(found)
