"""Registry of named queries and their DuckDB oracles.

``register(name, oracle=..., doubles=...)`` records a Spark query
(``fn(spark, sf_dir) -> DataFrame``) and the SQL DuckDB runs for the same
result. Double columns are rounded to 6 decimals in both engines, so
summation order does not decide the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.plans.oracle_views import with_views
from pitlane.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOUBLES: dict[str, tuple[str, ...]] = {}
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c), digits) for c in dbl}) if dbl else df


def oracle_text(body: str, doubles: tuple[str, ...] = ()) -> str:
    sql = with_views(body)
    if not doubles:
        return sql
    rep = ", ".join(f'round("{c}", {DIGITS}) as "{c}"' for c in doubles)
    # keep the WITH prefix outside: wrap only the final select
    return f"select * replace ({rep}) from (\n{sql}\n) q"


def register(name: str, oracle: str | None = None, doubles: tuple[str, ...] | list[str] = ()):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DOUBLES[name] = tuple(doubles)
        if oracle is not None:
            ORACLE[name] = oracle_text(oracle, tuple(doubles))
        return fn

    return deco
