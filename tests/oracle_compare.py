"""Compare a Spark query with its DuckDB oracle (row count, schema, values)."""

from __future__ import annotations

import math
import os

import duckdb

SF_SMALL = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
    "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, repr(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[bool, str]:
    s_cols = spark_df.columns
    rel = con.sql(sql)
    d_cols = rel.columns
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    bad = [
        (c, s_types[c], d_types[c]) for c in s_cols
        if s_types[c] in SPARK_TO_DUCK and SPARK_TO_DUCK[s_types[c]] != d_types[c]
    ]
    order = sorted(s_cols)
    s_rows = [tuple(_norm(r[c]) for c in order) for r in spark_df.collect()]
    d_raw = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in order)} from ({sql})").fetchall()
    d_rows = [tuple(_norm(x) for x in r) for r in d_raw]
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
    s_sorted = sorted(s_rows, key=_key)
    d_sorted = sorted(d_rows, key=_key)
    diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    if diffs:
        return False, f"{len(diffs)} value diffs; first: spark={diffs[0][0]} duck={diffs[0][1]}"
    if bad:
        return False, f"types differ: {bad}"
    return True, f"{len(s_rows)} rows"
