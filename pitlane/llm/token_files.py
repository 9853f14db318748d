"""Token-ID output: Parquet files of token lists with selective reads.

One row per document in ascending ``doc_id`` order: ``doc_id``, ``part`` and
``local_start`` (tokens of the same file part before the document), ``n_tokens`` and
``tokens`` (list of int). Token lists are dictionary-encoded (16 bits or fewer a token),
the ordered integer columns are delta-encoded (format version 2), row groups and pages have set sizes,
and the writer adds column and offset indexes, so that a reader can fetch the metadata
columns alone or the pages of a ``doc_id`` range.

Null text counts as empty text (the end id alone). Repeated documents are separate rows;
rows that tie in ``doc_id`` are ordered by a hash of their text. A null ``doc_id`` comes
first. An empty table gives an empty folder that reads back as no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlane.llm.common import rows_by_bytes
from pitlane.llm.encoders import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
ORDERED = ("doc_id", "part", "local_start", "n_tokens")


def writer_options(row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> dict[str, str]:
    """Parquet writer settings of the format."""
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ORDERED},
    }


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, parts: int | None = None, **options: int) -> None:
    """Encode ``docs`` (doc_id, text) and write the files, ascending by ``doc_id``.

    Parts are ranges of (doc_id, text hash), so a repeated ``doc_id`` does not fill one part; there are as many
    as the input has partitions unless ``parts`` says otherwise.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in rows_by_bytes(batch, "text", 2 << 20):
                ids = enc.encode_all(rows.column("text").to_pylist(), end)
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), tokens], schema=ARROW)
                start += int(ends[-1])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    (
        src.repartitionByRange(parts or max(1, src.rdd.getNumPartitions()), F.col("doc_id"), tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(encode, SCHEMA)
        .write.options(**writer_options(**options))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows of the files; a ``doc_id`` range [lo, hi] is pushed to row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if lo is not None:
        df = df.filter(F.col("doc_id") >= lo)
    return df if hi is None else df.filter(F.col("doc_id") <= hi)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): tokens of all parts before each part; one row a part, metadata columns only."""
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens; reads no token page."""
    meta = read_tokens(spark, path).select("doc_id", "part", "local_start", "n_tokens")
    return meta.join(part_starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    crcs = read_tokens(spark, path).mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return crcs.join(part_starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
