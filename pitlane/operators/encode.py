"""Splits, encoders, imputation and scaling.

Fit/apply separation: every ``fit_*`` reads the train rows only and returns
a small fitted state (a Python dict of scalars, or a per-category lookup
DataFrame); ``apply`` functions use it on any split. Scalar state (medians,
means, the compound vocabulary) is one value per feature, collected to the
driver like a Spark ML model's parameters; per-category state stays a
DataFrame joined back (AQE broadcasts it when its measured size is small).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane import constants as K
from pitlane.functions.scalar import compound_code_fixed, existing, sector_share
from pitlane.operators.quantiles import exact_quantiles

SPLITS = ("train", "val", "test")
ROW_ORDER = ["Year", "RoundNumber", "LapNumber", "Driver"]  # the feature table's own order


# --- E1 temporal split --------------------------------------------------------

def split_by_date(year: Column | None = None, rnd: Column | None = None) -> Column:
    y = F.col("Year") if year is None else year
    r = F.col("RoundNumber") if rnd is None else rnd
    return (
        F.when(y <= K.TRAIN_LAST_YEAR, "train")
        .when((y == K.EVAL_YEAR) & (r <= K.VAL_CUTOFF_ROUND), "val")
        .when((y == K.EVAL_YEAR) & (r > K.VAL_CUTOFF_ROUND), "test")
    )


def global_row_index(df: DataFrame, order: list[str] = ROW_ORDER, col_name: str = "__idx") -> DataFrame:
    """0-based position of each row in ``order`` without a single-partition sort.

    Three levels: rows are counted per prefix key (all order columns but the last) and per
    head key (the first two, one row per race); offsets run over the
    heads, then over the prefixes of each head, and the last column ranks rows within their prefix.
    """
    prefix, last = order[:-1], order[-1]
    head = prefix[:2]
    asc = lambda cols: [F.col(c).asc_nulls_last() for c in cols]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*prefix).agg(F.count(F.lit(1)).alias("__n"))
    heads = counts.groupBy(*head).agg(F.sum("__n").alias("__n"))
    heads = heads.select(*head, F.coalesce(F.sum("__n").over(before(Window.orderBy(*asc(head)))), F.lit(0)).alias("__base"))
    inside = before(Window.partitionBy(*head).orderBy(*asc(prefix[len(head):]) or asc(head)))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    offsets = _null_safe_join(offsets, heads, head).select(*prefix, (F.col("__base") + F.col("__off")).alias("__off"))
    within = Window.partitionBy(*prefix).orderBy(F.col(last).asc_nulls_last())
    out = _null_safe_join(df, offsets, prefix)
    return out.withColumn(col_name, F.col("__off") + F.row_number().over(within) - 1).drop("__off")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null keys meet."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*(f"__r_{k}" for k in keys))


def _split_counts(df: DataFrame, col: str = "split") -> dict[str, int]:
    return {r[col]: r["n"] for r in df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).collect()}


def round_split(df: DataFrame) -> DataFrame:
    """E1 (a): distinct races in order, first 60 % train, next 20 % val, rest test."""
    rounds = df.select("Year", "RoundNumber").distinct()
    w = Window.orderBy("Year", "RoundNumber")  # one row per race: small
    ranked = rounds.select(
        "Year", "RoundNumber", F.dense_rank().over(w).alias("__rk"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"),
    )
    a = F.greatest(F.floor(F.col("__n") * 0.6), F.lit(1))
    b = F.when(F.floor(F.col("__n") * 0.8) > 0, F.floor(F.col("__n") * 0.8)).otherwise(F.lit(2))
    split = (
        F.when(F.col("__rk") <= a, "train").when(F.col("__rk") <= b, "val")
        .otherwise("test")
    )
    lookup = ranked.select("Year", "RoundNumber", split.alias("split"))
    return df.join(lookup, ["Year", "RoundNumber"], "left")


def row_split(df: DataFrame, order: list[str] = ROW_ORDER) -> DataFrame:
    """E1 (b): rows 60/20/20 in the table's order."""
    idx = global_row_index(df, order)
    n = df.count()
    return idx.withColumn(
        "split",
        F.when(F.col("__idx") < int(n * 0.6), "train").when(F.col("__idx") < int(n * 0.8), "val").otherwise("test"),
    ).drop("__idx")


def temporal_split(df: DataFrame, smoke_test: bool = False, order: list[str] = ROW_ORDER) -> DataFrame:
    """Adds ``split`` (train / val / test / null for other years).

    Fallbacks as in the original: smoke test -> race split, then row split
    if val or test is empty; finally, when test is empty and val is not,
    the last 30 % of val rows become test. The fallback decisions need the
    split sizes: one small aggregate (at most four rows) is collected.
    """
    if not smoke_test:
        out = df.withColumn("split", split_by_date())
    else:
        out = round_split(df)
        c = _split_counts(out)
        if not c.get("val") or not c.get("test"):
            out = row_split(df, order)
    c = _split_counts(out)
    if not c.get("test") and c.get("val"):
        cut = int(c["val"] * 0.7)
        val = global_row_index(out.where(F.col("split") == "val"), order)
        val = val.withColumn("split", F.when(F.col("__idx") >= cut, "test").otherwise("val")).drop("__idx")
        out = out.where(~F.col("split").eqNullSafe("val")).unionByName(val)
    return out


def in_rounds(df: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rows whose (Year, RoundNumber) is in a set of races (semi-join)."""
    return df.join(rounds.select("Year", "RoundNumber"), ["Year", "RoundNumber"], "left_semi")


def split_rounds(df: DataFrame, split: str) -> DataFrame:
    """The distinct races of one split."""
    return df.where(F.col("split") == split).select("Year", "RoundNumber").dropDuplicates()


def train_val(df: DataFrame) -> DataFrame:
    """Train and val rows together (the final fit's data)."""
    return df.where(F.col("split").isin("train", "val"))


# --- F3 sector shares ---------------------------------------------------------

def add_sector_fractions(df: DataFrame) -> DataFrame:
    """sector_i_pct = SectoriTime / LapTime (zero lap time -> null)."""
    out = {}
    for i in (1, 2, 3):
        c = f"Sector{i}Time"
        if c in df.columns and "LapTime" in df.columns:
            out[f"sector_{i}_pct"] = sector_share(c, "LapTime")
    return df.withColumns(out) if out else df


# --- F4 / F5 / U3 compound codes -------------------------------------------------

def _coded(values: DataFrame) -> DataFrame:
    """(c, code): the position of each distinct value in sorted order."""
    return values.distinct().select("c", (F.row_number().over(Window.orderBy("c")) - 1).cast("int").alias("code"))


def fit_compound_vocab(train: DataFrame, col: str = "Compound") -> DataFrame:
    """(c, code) of the sorted distinct train compounds plus UNKNOWN, a lookup table."""
    unknown = train.sparkSession.range(1).select(F.lit(K.UNKNOWN_COMPOUND).alias("c"))
    return _coded(train.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("c")).unionByName(unknown))


def _look_up(df: DataFrame, vocab: DataFrame, default: int, col: str, out: str) -> DataFrame:
    name = F.coalesce(F.col(col).cast("string"), F.lit(K.UNKNOWN_COMPOUND))
    lookup = vocab.select(F.col("c").alias("__c"), F.col("code").alias("__code"))
    joined = df.join(lookup, name == F.col("__c"), "left")
    return joined.withColumn(out, F.coalesce("__code", F.lit(default)).cast("int")).drop("__c", "__code")


def compound_code(df: DataFrame, vocab: DataFrame, col: str = "Compound", out: str = "compound_encoded") -> DataFrame:
    """code in the fitted vocabulary; null or unseen -> UNKNOWN's code."""
    unk = vocab.where(F.col("c") == K.UNKNOWN_COMPOUND).first()["code"]
    return _look_up(df, vocab, unk, col, out)


def baseline_compound_code(df: DataFrame, classes: DataFrame, col: str = "Compound",
                           out: str = "compound_encoded") -> DataFrame:
    """the baseline's own label codes: null -> UNKNOWN, position in the sorted
    train classes (null -> UNKNOWN included when present), an unseen value ->
    class 0."""
    return _look_up(df, classes, 0, col, out)


def fit_baseline_classes(train: DataFrame, col: str = "Compound") -> DataFrame:
    """(c, code) of the sorted distinct train values with null as UNKNOWN."""
    return _coded(train.select(F.coalesce(F.col(col).cast("string"), F.lit(K.UNKNOWN_COMPOUND)).alias("c")))


def add_fixed_compound_code(df: DataFrame, col: str = "Compound", out: str = "compound_encoded") -> DataFrame:
    """F5 on a table; an existing code column wins."""
    given = F.col(out) if out in df.columns else None
    return df.withColumn(out, compound_code_fixed(col, given))


# --- A14 / J6 smoothed target encoding -------------------------------------------

@dataclass
class TargetEncoding:
    prior: float | None
    stats: dict[str, DataFrame]  # column -> (value, encoded) lookup


def fit_target_encoding(
    train: DataFrame, cols: list[str], target: str = K.TARGET,
    smoothing: float = K.TE_SMOOTHING, min_samples_leaf: int = K.TE_MIN_SAMPLES_LEAF,
) -> TargetEncoding:
    """Per category n and mean of the target; weight w = 1/(1+exp(-(n-k)/s));
    enc = prior*(1-w) + mean*w; a category seen once gets the prior."""
    prior = train.agg(F.avg(target).alias("p")).collect()[0]["p"]
    stats = {}
    for c in cols:
        g = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(
            F.count(target).alias("__n"), F.avg(target).alias("__m"))
        w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
        p = F.lit(prior).cast("double")
        enc = F.when(F.col("__n") == 1, p).otherwise(p * (F.lit(1.0) - w) + F.col("__m") * w)
        stats[c] = g.select("__v", enc.alias("__enc"))
    return TargetEncoding(prior, stats)


def apply_target_encoding(df: DataFrame, te: TargetEncoding, names: dict[str, str]) -> DataFrame:
    """Left-join each lookup; null or unseen -> prior."""
    out = df
    for c, lookup in te.stats.items():
        lk = lookup.withColumnRenamed("__v", c).withColumnRenamed("__enc", names[c])
        out = out.join(lk, c, "left").withColumn(
            names[c], F.coalesce(F.col(names[c]), F.lit(te.prior).cast("double")))
    return out


# --- A11 / A12 median fill, A13 scaling ---------------------------------------

def _medians(df: DataFrame, cols: list[str], by: str | None) -> dict:
    """Exact medians per column (per group ``by``), one value per group and column."""
    if not cols:
        return {}
    groups = df.select(by).distinct().collect() if by else [{None: None}]
    out = {r[by]: dict.fromkeys(cols) for r in groups}
    for r in exact_quantiles(df, cols, [0.5], by).collect():
        out[r["group"]][r["name"]] = r["q"][0]
    return out if by else out[None]


def median_fill_per_split(df: DataFrame, cols: list[str], split_col: str = "split") -> DataFrame:
    """Nulls filled with the median of the row's own split (an all-null
    column stays null)."""
    cols = existing(df, cols)
    meds = _medians(df, cols, split_col)
    out = {}
    for c in cols:
        fill = None
        for s, m in meds.items():
            if s is None or m[c] is None:
                continue
            cond = F.col(split_col) == F.lit(s)
            fill = F.when(cond, F.lit(float(m[c]))) if fill is None else fill.when(cond, F.lit(float(m[c])))
        x = F.col(c).cast("double")
        out[c] = F.coalesce(x, fill) if fill is not None else x
    return df.withColumns(out)


def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Medians of the train rows."""
    return _medians(train, existing(train, cols), None)


def apply_fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) if v is not None else F.col(c).cast("double")
        for c, v in values.items() if c in df.columns
    })


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column on train; zero (or undefined) std -> 1."""
    cols = existing(train, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    r = train.agg(*aggs).collect()[0]
    out = {}
    for c in cols:
        m, s = r[f"{c}__m"], r[f"{c}__s"]
        s = 1.0 if s is None or s == 0 or math.isnan(s) else float(s)
        out[c] = (m, s)
    return out


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(m).cast("double")) / F.lit(s)
        for c, (m, s) in scaler.items() if c in df.columns
    })


# --- the training frame (L-2 front half) ------------------------------------------

def encode_features(df: DataFrame) -> tuple[DataFrame, TargetEncoding, DataFrame]:
    """Sector shares, compound codes (F4) and target encodings fitted on train."""
    df = add_sector_fractions(df)
    train = df.where(F.col("split") == "train")
    vocab = fit_compound_vocab(train)
    df = compound_code(df, vocab)
    te = fit_target_encoding(train, ["Driver", "EventName"])
    df = apply_target_encoding(df, te, {"Driver": "driver_encoded", "EventName": "circuit_encoded"})
    return df, te, vocab


def sequence_frame(df: DataFrame) -> DataFrame:
    """TL feature prep: fixed compound codes (F5) and sector shares."""
    return add_sector_fractions(add_fixed_compound_code(df))
