"""The pipeline's stages against brute force, one after another."""

from __future__ import annotations

import duckdb
from helpers import EDGE, LONG, clashing, documents
from test_bwt_dedup import direct as direct_repeats
from test_decontam import direct as direct_hits
from test_quality import plain as plain_features
from test_simhash import plain as plain_fingerprint
from test_simhash import plain_components
from test_tokens import check_packing

import __spark_entry__ as E
import corpus_pipeline as C
from pitlane.llm import bwt_dedup
from pitlane.llm.common import land

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def near_dedup(docs):
    fps = [(d[0], plain_fingerprint(d[1])) for d in docs]
    comp = plain_components(fps)
    return [d for d, (i, f) in zip(docs, fps, strict=True) if i == comp[f]]


def cut(docs):
    out = []
    for d, (_, spans, text) in zip(docs, direct_repeats([(d[0], d[1]) for d in docs], 50), strict=True):
        spans = bwt_dedup.whole_characters(text, spans)
        left = bwt_dedup.kept(text, spans).decode()
        if not spans:
            out.append(d)
        elif left:
            out.append((d[0], left, d[2], d[3], len(left)))
    return out


def test_stages_against_brute_force(spark):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = rows(df)
    names = df.columns
    benchmark = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    stage = dict(C.STAGES)
    got = land(stage["quality_rules"](spark, df, SF), "t")
    # too few labels here for any cutoff to be proven, so the base rules alone decide
    want = [d for d in docs if (f := plain_features(d[1]))[0] >= 10 and 100 * f[4] <= 20 * f[0]]
    assert got.columns == names and sorted(rows(got)) == sorted(want) and len(want) < len(docs)
    got, want = land(stage["simhash_near_dedup"](spark, got, SF), "t"), near_dedup(sorted(want))
    assert got.columns == names and sorted(rows(got)) == sorted(want)
    got, want = land(stage["suffix_array_dedup"](spark, got, SF), "t"), cut(sorted(want))
    assert got.columns == names and sorted(rows(got)) == sorted(want)
    got = land(stage["benchmark_decontamination"](spark, got, SF), "t")
    hit = {d for d, _, n, _ in direct_hits([(d[0], d[1]) for d in want], benchmark, 10) if n}
    want = [d for d in want if d[0] not in hit]
    assert got.columns == names and sorted(rows(got)) == sorted(want) and hit
    packed = stage["best_fit_packing"](spark, got, SF).collect()
    check_packing(packed, [(d[0], d[1]) for d in want])
    whole = E.queries()["pipeline"](spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_every_stage_takes_edge_cases(spark):
    df = clashing(documents(spark, [*EDGE, (40, "copy " + LONG, "de", "b", 5), (41, "same words here " * 3, None, None, None)]))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        ids = [r.doc_id for r in out.collect()]
        assert ids and set(ids) <= {r.doc_id for r in df.collect()}, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert C.STAGES[-1][1](spark, df, SF).select("doc_id").distinct().count() == len({r.doc_id for r in df.collect()})


def test_null_and_repeated_rows(spark):
    rows_ = [(None, "a b c d e f g h i j k", "en", "s", 1), (None, "l m n o p q r s t u v w", "en", "s", 1), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g h i j k", "en", "s", 1)]
    kept = C.simhash_near_dedup(spark, documents(spark, rows_), SF).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 0, "l m n o p q r s t u v w"), (True, 1, ""), (True, 2, "a b c d e f g h i j k")]
