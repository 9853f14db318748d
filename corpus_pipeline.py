"""The corpus pipeline: documents that fail the quality rules go, near-duplicates leave one document each, repeated
passages are cut, documents with benchmark text go, and the rest is packed into training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet under the
shared folder and hands the reread table on. All stages but the last return the columns of ``docs``; columns that share names with a stage's own
ones pass through untouched. Null, empty, repeated and very long texts are handled as the operators say; an
empty table stays empty.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.llm import bwt_dedup, decontam, packing, quality, simhash
from pitlane.llm.common import drop_landed, land, recorded, table, whole_row

_LEFT = threading.local()


def stage(f):
    """A stage of the pipeline: what the one before it landed for its own use goes, as its result has been written by now."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT.paths = getattr(_LEFT, "paths", [])
        drop_landed(spark, _LEFT.paths)
        with recorded(_LEFT.paths):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the risk-controlled cutoffs of their language."""
    carried = docs.select("doc_id", "lang", "text", whole_row(docs).alias("__row"))
    featured = quality.with_features(carried, keep=["doc_id", "lang", "__row"])
    chosen = land(quality.cutoffs(featured, table(spark, sf_dir, "labels"), "lang"), "cutoffs")
    return quality.judge(featured, chosen, "lang").filter("kept").select("__row.*")


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (three-word shingles, three bits)."""
    return simhash.keep_one(docs, width=3, budget=3)


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 50-byte strings that a document with a smaller id has as well; drop documents of which nothing is left."""
    return bwt_dedup.remove_repeats(docs, length=50)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a ten-word window of a benchmark item."""
    rows = land(docs.select(whole_row(docs).alias("__row")).withColumn("__rid", F.monotonically_increasing_id()), "rows")
    index = decontam.build_index(rows.select(F.col("__rid").alias("doc_id"), "__row.text"))
    hit = decontam.contamination(index, table(spark, sf_dir, "benchmark"), size=10).filter(F.size("spans") > 0)
    return rows.join(hit.select(F.col("doc_id").alias("__rid")), "__rid", "left_anti").select("__row.*")


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_tokens=1024, cache_words=150_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, and token ids, have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = land(f(spark, docs, sf_dir), name)
    return docs
