"""Registered queries: stint sequences, padding, unpadding, masked loss, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlane import constants as K
from pitlane.operators import encode as enc
from pitlane.operators import sequences as S
from pitlane.plans.store import feature_store
from pitlane.plans.oracle_views import view
from pitlane.plans.registry import register
from pitlane.session import land

T = K.TARGET
FE = K.SEQUENCE_FEATURES
KEYS = ["Year", "RoundNumber", "Driver", "Stint"]


def fitted_scaler(df):
    train = df.where(F.col("split") == "train")
    meds = enc.fit_medians(train, FE)
    filled = enc.apply_fill(df, meds)
    return filled, enc.fit_scaler(filled.where(F.col("split") == "train"), FE)


def sequence_inputs(spark, sf):
    """TL prep: split, fixed compound codes, sector shares, train medians, train scaler."""
    df = enc.sequence_frame(enc.temporal_split(feature_store(spark, sf)))
    df = df.withColumn("seq_order", F.col("stint_lap_number"))
    filled, sc = fitted_scaler(df)
    return enc.apply_scaler(filled, sc)


def _seqin_sql():
    meds = ", ".join(f"median(cast({c} as double)) as {c}" for c in FE)
    filled = ", ".join(f"coalesce(cast(t.{c} as double), m.{c}) as {c}" for c in FE)
    stats = ", ".join(f"avg({c}) as {c}__m, stddev_pop({c}) as {c}__s" for c in FE)
    scaled = ", ".join(
        f"({c} - s.{c}__m) / case when s.{c}__s is null or s.{c}__s = 0 then 1 else s.{c}__s end as {c}" for c in FE)
    return f"""
with m as (select {meds} from tlf where split = 'train'),
filled as (select t.Year, t.RoundNumber, t.Driver, t.Stint, t.LapNumber, t.split, t.stint_lap_number as seq_order,
             t.{T}, {filled} from tlf t, m),
s as (select {stats} from filled where split = 'train')
select Year, RoundNumber, Driver, Stint, LapNumber, split, seq_order, {T}, {scaled} from filled, s"""


view("seqin", ("tlf",), _seqin_sql())

SEQ_SQL = """
select Year, RoundNumber, Driver, Stint, split, cast(count(*) as int) as L,
  list([{x}] order by seq_order) as X, list(round({t}, 6) order by seq_order) as y
from seqin where split is not null and {t} is not null and Year is not null and RoundNumber is not null
  and Driver is not null and Stint is not null
group by Year, RoundNumber, Driver, Stint, split having count(*) >= 2"""

view("seq_all", ("seqin",), SEQ_SQL.format(x=", ".join(f"round({c}, 6)" for c in FE), t=T))
SPLIT_KEYS = [*KEYS, "split"]


def sequences(spark, sf):
    """Train, val and test sequences; the split is part of the key."""
    df = sequence_inputs(spark, sf).where(F.col("split").isNotNull())
    # round the step values so both engines see the same numbers
    df = df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in FE + [T]})
    return S.stint_sequences(df, FE, T, order_col="seq_order", keys=SPLIT_KEYS)


@register("stint_sequences", oracle="select * from seq_all")
def q_stint_sequences(spark, sf):
    """B1: per stint X (L x 16), y (L); null targets and stints < 2 laps dropped."""
    return sequences(spark, sf)


@register(
    "prefix_augment",
    oracle="""select Year, RoundNumber, Driver, Stint, split, cast(e as int) as L, list_slice(X, 1, e) as X, list_slice(y, 1, e) as y
from (select *, unnest(range(2, L + 1)) as e from seq_all where split = 'train') q""",
)
def q_prefix_augment(spark, sf):
    """B2: all prefixes of length 2..L of the train sequences."""
    return S.prefix_augment(sequences(spark, sf).where(F.col("split") == "train"))


@register(
    "pad_mask",
    oracle="""
with b as (select *, (row_number() over (partition by split order by Year, RoundNumber, Driver, Stint) - 1) // 32 as batch from seq_all),
m as (select *, max(L) over (partition by split, batch) as maxlen from b)
select Year, RoundNumber, Driver, Stint, split, L, batch, maxlen,
  list_concat(X, list_transform(range(maxlen - L), lambda i: list_transform(range(len(X[1])), lambda j: cast(0 as double)))) as X_pad,
  list_concat(y, list_transform(range(maxlen - L), lambda i: cast(0 as double))) as y_pad,
  list_transform(range(1, maxlen + 1), lambda i: i <= L) as mask
from m""",
)
def q_pad_mask(spark, sf):
    """Per split, batches of 32 in key order, padded to the batch maximum, step mask."""
    return S.pad_batches(land(sequences(spark, sf), "sequences"), by="split")


def persistence_padded(spark, sf):
    """Padded batches of every split with a persistence prediction (previous step's target, 0 first)."""
    seq = land(sequences(spark, sf), "sequences").withColumn(
        "pred", F.concat(F.array(F.lit(0.0)), F.slice("y", 1, F.col("L") - 1)))
    b = S.pad_batches(seq, by="split")
    pad = F.col("maxlen") - F.col("L")
    return b.withColumn("pred_pad", F.concat("pred", F.array_repeat(F.lit(0.0), pad)))


UNPAD_SQL = """
select Year, RoundNumber, Driver, Stint, split, cast(pos as int) as pos,
  case when pos = 0 then cast(0 as double) else y[pos] end as pred, y[pos + 1] as y
from (select *, unnest(range(L)) as pos from seq_all) q"""


@register("unpad", oracle=UNPAD_SQL, doubles=("pred", "y"))
def q_unpad(spark, sf):
    """Padded predictions and targets back to one row per real step."""
    return S.unpad(persistence_padded(spark, sf), "pred_pad", "y_pad", keys=SPLIT_KEYS)


@register(
    "masked_huber",
    oracle=f"""select split, avg(case when abs(pred - y) <= 1 then 0.5 * (pred - y) * (pred - y) else abs(pred - y) - 0.5 end) as loss,
  count(*) as n_steps from ({UNPAD_SQL}) u group by split""",
    doubles=("loss",),
)
def q_masked_huber(spark, sf):
    """Huber loss (delta 1) over real steps only, padded steps masked out."""
    return S.masked_huber(persistence_padded(spark, sf), "pred_pad", "y_pad", by=["split"])


REQ_FEATS = [c for c in FE if c != "avg_rpm"]  # requests omit one feature: it becomes 0.0


@register(
    "request_matrix",
    oracle="""
with m as (select {meds} from tlf where split = 'train'),
filled as (select t.split, {filled} from tlf t, m),
s as (select {stats} from filled where split = 'train'),
r as (select Year, RoundNumber, Driver, Stint, stint_lap_number, {raw} from tlf
      where split = 'val' and Stint is not null)
select Year, RoundNumber, Driver, Stint, list([{scaled}] order by stint_lap_number) as X
from r, s group by Year, RoundNumber, Driver, Stint""".format(
        meds=", ".join(f"median(cast({c} as double)) as {c}" for c in FE),
        filled=", ".join(f"coalesce(cast(t.{c} as double), m.{c}) as {c}" for c in FE),
        stats=", ".join(f"avg({c}) as {c}__m, stddev_pop({c}) as {c}__s" for c in FE),
        raw=", ".join(f"cast({c} as double) as {c}" for c in REQ_FEATS),
        scaled=", ".join(
            f"round(({c if c in REQ_FEATS else '0.0'} - s.{c}__m) / case when s.{c}__s is null or s.{c}__s = 0 then 1 "
            f"else s.{c}__s end, 6)" for c in FE),
    ),
)
def q_request_matrix(spark, sf):
    """A stint's laps sent as a request (one feature absent) -> scaled matrix."""
    df = enc.sequence_frame(enc.temporal_split(feature_store(spark, sf)))
    _, sc = fitted_scaler(df)
    req = (
        df.where((F.col("split") == "val") & F.col("Stint").isNotNull())
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("stint_lap_number").alias("__o"), *[F.col(c).cast("double").alias(c) for c in REQ_FEATS])))
             .alias("laps"))
    )
    out = S.request_matrix(req, "laps", FE, sc)
    return out.select(*KEYS, S.round_array("X", 6, depth=2).alias("X"))
