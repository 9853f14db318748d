"""Best-fit packing with vector capacities.

Every sequence (bin) has three capacities: tokens, pieces of documents, and attention cost
(the sum of squared piece lengths). A piece of ``l`` tokens demands ``(l, 1, l * l)``.
Longest pieces go first; each goes to the open bin that can hold it under every capacity
and scores best, either by the weighted norm of what the bin has left afterwards
(``residual_norm``, smallest wins) or by the weighted dot product of demand and residual
(``dot``, largest wins). A new bin opens only if none fits.

A demand depends on the length alone, so the choice runs on the histogram of lengths, which has
at most ``max_tokens`` entries for any number of documents, over classes of bins with equal
residuals (at most two new classes a length). The outcome is a list of runs: pieces of one
length with ranks [lo, hi) go to sequences ``first + rank - lo`` at one offset. Pieces
get their rank from counts per (length, task), and look up the run they fall in.

A document longer than ``max_tokens`` is cut into pieces of that size, the first taking the rest.
Null text is empty text (the end id alone). Repeated documents are packed once each,
ties in length by their rank. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import land, rows_by_bytes
from pitlane.llm.encoders import CACHE_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first one takes the rest."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 1024, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents; ``nth`` counts a task's earlier pieces of the same length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer_path, cache_words), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in rows_by_bytes(batch, "text", 2 << 20):
                out = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), map(memoryview, enc.encode_all(rows.column("text").to_pylist(), end)), strict=True):
                    for k, (s, n) in enumerate(cut(len(ids) // 4, max_tokens)):
                        out.append((doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, PIECES)


def plan_bins(
    histogram: dict[int, int],
    max_tokens: int = 1024,
    max_pieces: int | None = None,
    max_attention: int | None = None,
    score: str = "residual_norm",
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Vector best fit over a histogram of lengths.

    Returns runs (length, rank_lo, rank_hi, first_sequence, offset) and the number of
    sequences. A capacity of None never binds (pieces: ``max_tokens``; attention: its square).
    """
    cap = np.array([max_tokens, max_pieces or max_tokens, max_attention or max_tokens**2], float)
    w = np.array(weights) / cap
    if score not in ("residual_norm", "dot"):
        raise ValueError(f"unknown score {score!r}")
    # a class: residual vector, number of bins, and the (length, how many) put into each of them
    residual, count, content = np.empty((0, 3)), [], []
    for length in sorted(histogram, reverse=True):
        left, need = histogram[length], np.array([length, 1, length * length], float)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        while left:
            fits = np.flatnonzero((residual >= need).all(axis=1) & (np.array(count, int) > 0))
            if fits.size:
                if score == "dot":
                    best = fits[np.argmax((residual[fits] * w) @ (need * w))]
                else:
                    best = fits[np.argmin((((residual[fits] - need) * w) ** 2).sum(axis=1))]
                room, have, old = residual[best], count[best], content[best]
            else:
                best, room, have, old = None, cap, left, []
            # the bin just filled has the smallest residual, so it stays the best while it fits
            each = 1 if score == "dot" else int((room // need).min())
            for k, bins in ((each, min(have, left // each)), (left % each, 1)):
                if k and bins and left >= k and have > 0:
                    residual = np.vstack([residual, room - k * need])
                    count.append(bins)
                    content.append([*old, (length, k)])
                    left, have = left - k * bins, have - bins
            if best is not None:
                count[best] = have
    runs, nxt, used = [], 0, Counter()
    for bins, items in zip(count, content, strict=True):
        if bins:
            at = 0
            for length, k in items:
                for _ in range(k):
                    runs.append((length, used[length], used[length] + bins, nxt, at))
                    used[length] += bins
                    at += length
            nxt += bins
    return runs, nxt


def ranked(parts: DataFrame) -> DataFrame:
    """Rank of each piece among all pieces of its length, from counts per (length, task)."""
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    max_tokens: int = 1024,
    max_pieces: int | None = None,
    max_attention: int | None = None,
    score: str = "residual_norm",
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    The histogram (at most ``max_tokens`` rows) is collected; the runs sent to the executors
    are bounded by the pieces that the bin classes hold, ``2 * max_tokens`` classes.
    """
    parts = land(pieces(docs, tokenizer_path, end_id, max_tokens, cache_words), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(histogram, max_tokens, max_pieces, max_attention, score)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        first = {int(n): i for i, n in reversed(list(enumerate(t[:, 0])))}
        last = {int(n): i + 1 for i, n in enumerate(t[:, 0])}
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                lo, mine = first[int(length)], n == length
                at[mine] = lo + np.searchsorted(t[lo : last[int(length)], 1], rank[mine], side="right") - 1
            run = t[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
