"""Column expressions (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns (Spark keeps them apart, pandas does not)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floating]
    if not targets:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in targets})


def td_seconds(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """A duration as float seconds.

    Parquet durations arrive as bigint nanoseconds; Spark day-time intervals
    are converted exactly; anything else is parsed as a number, bad -> null.
    """
    x = col(c)
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.unix_micros(F.timestamp_seconds(F.lit(0)) + x).cast("double") / F.lit(1e6)
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return x.cast("double") / F.lit(1e9)
    return x.cast("string").try_cast("double")


def driver_number_str(c: Column | str, numeric: bool = True) -> Column:
    """P5: DriverNumber as string; numbers go through int so 1.0 becomes "1".

    ``numeric`` says that the column holds numbers; strings stay as they are ("01" is not car "1").
    """
    x = col(c)
    if not numeric:
        return x.cast("string")
    as_num = x.cast("string").try_cast("double")
    return F.when(
        as_num.isNotNull() & (as_num == F.floor(as_num)),
        as_num.cast("bigint").cast("string"),
    ).otherwise(x.cast("string"))


def clip_lower_zero(x: Column) -> Column:
    """pandas ``clip(lower=0)``: null stays null (``greatest(null, 0)`` would give 0)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def fuel_load(race_laps: Column, lap_number: Column, burn: float = K.FUEL_BURN_RATE_KG_PER_LAP) -> Column:
    """fuel left = max(0, race_laps*burn - lap*burn)."""
    return clip_lower_zero(race_laps * F.lit(burn) - lap_number * F.lit(burn))


def corrected_time(lap_time: Column, fuel: Column, effect: float = K.FUEL_TIME_EFFECT_S_PER_KG, sign: int = 1) -> Column:
    """lap time plus (sign=+1, as in the original) the fuel time effect."""
    return lap_time + F.lit(float(sign)) * (fuel * F.lit(effect))


def sector_share(sector: Column | str, lap_time: Column | str) -> Column:
    """sector / lap time, zero lap time -> null."""
    return F.try_divide(col(sector), col(lap_time))


def compound_code_fixed(compound: Column | str, given_code: Column | None = None) -> Column:
    """fixed compound code on the upper-cased name; unknown/null -> 2; a given code wins."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in K.COMPOUND_MAP.items()))
    name = F.upper(F.coalesce(col(compound).cast("string"), F.lit(K.UNKNOWN_COMPOUND)))
    code = F.coalesce(F.try_element_at(m, name), F.lit(K.COMPOUND_DEFAULT_CODE))
    if given_code is not None:
        code = F.coalesce(given_code, code)
    return code.cast("int")


def risk_band(delta: Column | str) -> Column:
    """NOMINAL below 0.1 s, DEGRADING below 0.3 s, else CLIFF RISK."""
    d = col(delta)
    return (
        F.when(d < K.RISK_NOMINAL_BELOW, "NOMINAL")
        .when(d < K.RISK_DEGRADING_BELOW, "DEGRADING")
        .when(d.isNotNull(), "CLIFF RISK")
    )


def file_key(year: Column | str, rnd: Column | str, suffix: str = "") -> Column:
    """zero-padded per-race key ``{year}_R{nn}``."""
    return F.format_string(f"%d_R%02d{suffix}", col(year).cast("int"), col(rnd).cast("int"))


def parse_utc(c: Column | str) -> Column:
    """F8: ISO-8601 string -> timestamp (session zone UTC); bad -> null."""
    return F.try_to_timestamp(col(c).cast("string"))


def number_or(c: Column | str, default: float | int, dtype: str = "double") -> Column:
    """parse a number with a default for missing or bad input."""
    text = F.trim(col(c).cast("string"))
    parsed = text.try_cast(dtype)
    if dtype in ("int", "bigint"):  # "7.0" is a whole number too; what does not fit the type is bad input
        real = text.try_cast("double")
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), parsed)
        parsed = F.coalesce(whole, F.when(text.rlike("[.eE]") & (real == F.floor(real)), real.try_cast(dtype)))
    return F.coalesce(parsed, F.lit(default).cast(dtype))


def round4(c: Column | str) -> Column:
    """F9."""
    return F.round(col(c), 4)


def status_has(status: Column | str, flag: str) -> Column:
    """does the track-status string contain a flag; null status -> ""."""
    return F.coalesce(col(status), F.lit("")).contains(flag)


def add_missing(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add optional columns that are absent as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in cols.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """The listed columns that exist, in list order."""
    have = set(df.columns)
    return [c for c in names if c in have]
