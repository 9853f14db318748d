"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.session import checkpoint_dir, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pitlane-llm/{name}-{uuid.uuid4().hex[:12]}"


_RECORDING = threading.local()


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note the tables that this thread lands meanwhile in ``paths``."""
    before = getattr(_RECORDING, "paths", None)
    _RECORDING.paths = paths
    try:
        yield
    finally:
        _RECORDING.paths = before


def drop_landed(spark: SparkSession, paths: list[str]) -> None:
    """Delete landed tables that nothing reads any more, and empty the list."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def land(df: DataFrame, name: str, reader: SparkSession | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back (cuts lineage), by the session ``reader`` if it is another one."""
    path = scratch(df.sparkSession, name)
    if getattr(_RECORDING, "paths", None) is not None:
        _RECORDING.paths.append(path)
    df.write.options(**options).parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """A struct of all columns, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in skip))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("b")).first()["b"]


def groups_for(total: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` units hold ``total``."""
    return max(least, -(-int(total) // each))


def rows_by_bytes(batch: pa.RecordBatch, col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``col`` holds about ``limit`` bytes (one row at least)."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which beats numpy's hashing here)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside its executor, and keeps the peak of its largest rows otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as rows that Python returns have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(data: bytes, limit: int = 4 << 20) -> Iterator[list[bytes]]:
    """Words (runs without ASCII white space) of a text in blocks of about ``limit`` bytes, cut between words."""
    at = 0
    while at < len(data):
        end = at + limit
        if end < len(data):
            m = _SPACE.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end
