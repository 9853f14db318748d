"""Registered queries: splits, encoders, imputation, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.operators.quantiles import quantiles_from_sketches, race_sketches
from pitlane.plans.store import feature_store, stored_once
from pitlane.plans.registry import register

KEY = ["Year", "RoundNumber", "Driver", "LapNumber"]
TD_FEATS = K.MODEL_FEATURES
TL_FEATS = K.SEQUENCE_FEATURES


def split_features(spark, sf):
    return enc.temporal_split(feature_store(spark, sf))


@register("temporal_split", oracle="select Year, RoundNumber, Driver, LapNumber, split from featsplit")
def q_temporal_split(spark, sf):
    """Train <= 2024, val 2025 rounds <= 10, test 2025 rounds > 10."""
    return split_features(spark, sf).select(*KEY, "split")


@register(
    "round_split",
    oracle="""
with r as (select Year, RoundNumber, dense_rank() over (order by Year, RoundNumber) as rk, count(*) over () as n
           from (select distinct Year, RoundNumber from feat) d)
select f.Year, f.RoundNumber, f.Driver, f.LapNumber,
  case when rk <= greatest(floor(n * 0.6), 1) then 'train'
       when rk <= case when floor(n * 0.8) > 0 then floor(n * 0.8) else 2 end then 'val' else 'test' end as split
from feat f join r on f.Year = r.Year and f.RoundNumber = r.RoundNumber""",
)
def q_round_split(spark, sf):
    """E1 smoke-test form: distinct races 60/20/20."""
    return enc.temporal_split(feature_store(spark, sf), smoke_test=True).select(*KEY, "split")


@register(
    "sector_share",
    oracle="select Year, RoundNumber, Driver, LapNumber, sector_1_pct, sector_2_pct, sector_3_pct from tdf",
    doubles=("sector_1_pct", "sector_2_pct", "sector_3_pct"),
)
def q_sector_share(spark, sf):
    """sector time / lap time, zero lap time -> null."""
    return enc.add_sector_fractions(feature_store(spark, sf)).select(
        *KEY, "sector_1_pct", "sector_2_pct", "sector_3_pct")


@register("compound_code", oracle="select Year, RoundNumber, Driver, LapNumber, split, compound_encoded from tdf")
def q_compound_code(spark, sf):
    """compound index in the train vocabulary (+UNKNOWN); null/unseen -> UNKNOWN."""
    df = split_features(spark, sf)
    vocab = enc.fit_compound_vocab(df.where(F.col("split") == "train"))
    return enc.compound_code(df, vocab).select(*KEY, "split", "compound_encoded")


@register("compound_code_fixed", oracle="select Year, RoundNumber, Driver, LapNumber, compound_encoded from tlf")
def q_compound_code_fixed(spark, sf):
    """fixed compound codes (HARD 0 ... WET 4, other 2)."""
    return enc.add_fixed_compound_code(feature_store(spark, sf)).select(*KEY, "compound_encoded")


@register(
    "compound_vocab",
    oracle="select c as Compound, code from vocab",
)
def q_compound_vocab(spark, sf):
    """Distinct train compounds plus UNKNOWN, with their codes."""
    df = split_features(spark, sf)
    train = df.where(F.col("split") == "train")
    vals = train.where(F.col("Compound").isNotNull()).select("Compound").unionByName(
        train.limit(1).select(F.lit(K.UNKNOWN_COMPOUND).alias("Compound"))).distinct()
    from pyspark.sql.window import Window
    return vals.select("Compound", (F.row_number().over(Window.orderBy("Compound")) - 1).cast("int").alias("code"))


TE_SQL = """
with p as (select avg(lap_time_delta_fuel_corrected) as p from featsplit where split = 'train'),
{stats}
select f.Year, f.RoundNumber, f.Driver, f.LapNumber, f.split,
  coalesce(d.enc, (select p from p)) as driver_encoded, coalesce(c.enc, (select p from p)) as circuit_encoded
from featsplit f left join s_Driver d on d.v = f.Driver left join s_EventName c on c.v = f.EventName"""
TE_STATS = """s_{c} as (
  select v, case when n = 1 then p else p * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))) end as enc
  from (select {c} as v, count(lap_time_delta_fuel_corrected) as n, avg(lap_time_delta_fuel_corrected) as m
        from featsplit where split = 'train' and {c} is not null group by {c}) g, p)"""


@register(
    "target_encode",
    oracle=TE_SQL.format(stats=",\n".join(TE_STATS.format(c=c) for c in ("Driver", "EventName"))),
    doubles=("driver_encoded", "circuit_encoded"),
)
def q_target_encode(spark, sf):
    """Smoothed target encoding of Driver and EventName fitted on train."""
    df = split_features(spark, sf)
    te = enc.fit_target_encoding(df.where(F.col("split") == "train"), ["Driver", "EventName"])
    out = enc.apply_target_encoding(df, te, {"Driver": "driver_encoded", "EventName": "circuit_encoded"})
    return out.select(*KEY, "split", "driver_encoded", "circuit_encoded")


def _fill_split_sql(feats):
    cols = ", ".join(
        f"coalesce(cast({c} as double), quantile_cont(cast({c} as double), 0.5) over (partition by split)) as {c}"
        for c in feats)
    return f"select Year, RoundNumber, Driver, LapNumber, split, {cols} from tdf"


@register("median_fill_split", oracle=_fill_split_sql(TD_FEATS), doubles=tuple(TD_FEATS))
def q_median_fill_split(spark, sf):
    """Each split's nulls filled with that split's own medians."""
    df, _, _ = enc.encode_features(split_features(spark, sf))
    return enc.median_fill_per_split(df, TD_FEATS).select(*KEY, "split", *TD_FEATS)


def _fill_train_sql(feats, scale: bool):
    meds = ", ".join(f"median(cast({c} as double)) as {c}" for c in feats)
    filled = ", ".join(f"coalesce(cast(t.{c} as double), m.{c}) as {c}" for c in feats)
    base = f"""
with m as (select {meds} from tlf where split = 'train'),
filled as (select t.Year, t.RoundNumber, t.Driver, t.LapNumber, t.split, {filled} from tlf t, m)"""
    if not scale:
        return base + f"\nselect Year, RoundNumber, Driver, LapNumber, split, {', '.join(feats)} from filled"
    stats = ", ".join(f"avg({c}) as {c}__m, stddev_pop({c}) as {c}__s" for c in feats)
    scaled = ", ".join(
        f"({c} - s.{c}__m) / case when s.{c}__s is null or s.{c}__s = 0 then 1 else s.{c}__s end as {c}" for c in feats)
    return base + f""",
s as (select {stats} from filled where split = 'train')
select Year, RoundNumber, Driver, LapNumber, split, {scaled} from filled, s"""


@register("median_fill_train", oracle=_fill_train_sql(TL_FEATS, False), doubles=tuple(TL_FEATS))
def q_median_fill_train(spark, sf):
    """Every split filled with the train medians (sequence features)."""
    df = enc.sequence_frame(split_features(spark, sf))
    meds = enc.fit_medians(df.where(F.col("split") == "train"), TL_FEATS)
    return enc.apply_fill(df, meds).select(*KEY, "split", *TL_FEATS)


@register("standard_scale", oracle=_fill_train_sql(TL_FEATS, True), doubles=tuple(TL_FEATS))
def q_standard_scale(spark, sf):
    """Train-fitted standard scaling (population std, zero -> 1)."""
    df = enc.sequence_frame(split_features(spark, sf))
    train = df.where(F.col("split") == "train")
    meds = enc.fit_medians(train, TL_FEATS)
    filled = enc.apply_fill(df, meds)
    sc = enc.fit_scaler(filled.where(F.col("split") == "train"), TL_FEATS)
    return enc.apply_scaler(filled, sc).select(*KEY, "split", *TL_FEATS)


@register(
    "split_rounds",
    oracle="""select Year, RoundNumber, Driver, LapNumber from featsplit
where (Year, RoundNumber) in (select distinct Year, RoundNumber from featsplit where split = 'test')""",
)
def q_split_rounds(spark, sf):
    """The distinct races of a split, and a semi-join on them."""
    df = split_features(spark, sf)
    return enc.in_rounds(df, enc.split_rounds(df, "test")).select(*KEY)


@register(
    "train_val_union",
    oracle="select Year, RoundNumber, Driver, LapNumber, split from featsplit where split in ('train', 'val')",
)
def q_train_val_union(spark, sf):
    """Train + val rows for the final fit."""
    return enc.train_val(split_features(spark, sf)).select(*KEY, "split")


@register(
    "baseline_compound_code",
    oracle="""
with v as (select c, cast(row_number() over (order by c) - 1 as int) as code
           from (select distinct coalesce(Compound, 'UNKNOWN') as c from featsplit where split = 'train') x)
select f.Year, f.RoundNumber, f.Driver, f.LapNumber, f.split, coalesce(v.code, 0) as compound_encoded
from featsplit f left join v on v.c = coalesce(f.Compound, 'UNKNOWN')""",
)
def q_baseline_compound_code(spark, sf):
    """baseline label codes fitted on train; null -> UNKNOWN, unseen -> 0."""
    df = split_features(spark, sf)
    classes = enc.fit_baseline_classes(df.where(F.col("split") == "train"))
    return enc.baseline_compound_code(df, classes).select(*KEY, "split", "compound_encoded")


@register(
    "race_scan",
    oracle="""select Year, RoundNumber, Driver, LapNumber, stint_lap_number, lap_time_delta_fuel_corrected
from feat where Year = 2024 and RoundNumber = 3""",
    doubles=("lap_time_delta_fuel_corrected",),
)
def q_race_scan(spark, sf):
    """One race read from the race-partitioned feature table (partition pruning)."""
    from pitlane.sources import scan
    return scan.race_scan(feature_store(spark, sf), 2024, 3).select(
        "Year", "RoundNumber", "Driver", "LapNumber", "stint_lap_number", "lap_time_delta_fuel_corrected")


SKETCHED = ["LapTime", K.TARGET, "TrackTemp", "avg_speed_kph", "deg_rate_last_3", "TyreLife"]


@register(
    "sketch_quantiles",
    oracle=" union all ".join(
        f"""select split, '{c}' as name, count({c}) as n, quantile_cont({c}::double, 0.25) as q25, quantile_cont({c}::double, 0.5) as q50,
  quantile_cont({c}::double, 0.75) as q75 from featsplit where split is not null group by split having count({c}) > 0""" for c in SKETCHED),
    doubles=("q25", "q50", "q75"),
)
def q_sketch_quantiles(spark, sf):
    """Exact quartiles per split, bracketed by quantile sketches that were landed race by race with the feature table."""
    path = stored_once(spark, sf, "sketches", lambda p: race_sketches(feature_store(spark, sf), SKETCHED).write.mode("overwrite").parquet(f"{p}/races"))
    sketches = spark.read.parquet(f"{path}/races").withColumn("split", enc.split_by_date()).where(F.col("split").isNotNull())
    df = split_features(spark, sf).where(F.col("split").isNotNull())
    q = quantiles_from_sketches(df, sketches, SKETCHED, [0.25, 0.5, 0.75], "split")
    return q.select(F.col("group").alias("split"), "name", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))))
