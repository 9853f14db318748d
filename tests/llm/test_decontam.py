"""The positional index against a direct search."""

from __future__ import annotations

import hashlib
import re

import pytest
from helpers import EDGE, clashing, documents
from oracle_compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E
from pitlane.llm import decontam as D
from pitlane.llm.queries import ORACLE


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def direct(docs, items, size):
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for i, q in items:
            q = words(q)
            n = min(size, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    named |= {i} - {None}
        out.append((d if d is not None else -1, len(w), len(hit), sorted(named)))
    return sorted(out)


ITEMS = [(1, "one two three ONE two three four"), (1, "five-six"), (2, "naïve quoted"), (10, "世界"), (3, None), (4, "..."), (None, "text"), (11, " ".join(f"w{i}x{i % 13}" for i in range(40, 60))), (12, "three four no")]


@pytest.mark.parametrize("block,segment", [(1 << 20, 4_000_000), (40, 12)])
def test_edges_against_direct_search(spark, block, segment):
    docs = clashing(documents(spark, EDGE))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = D.build_index(docs, segment_words=segment)
    got = D.contamination(index, items, size=4, block_bytes=block).withColumn("n_hit", D.covered()).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, sorted(r["items"])) for r in got) == direct([(r[0], r[1]) for r in EDGE], ITEMS, 4)


def test_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(D.build_index(documents(spark, [])), items).count() == 0
    got = D.contamination(D.build_index(documents(spark, EDGE)), none).collect()
    assert len(got) == len(EDGE) and not any(r.spans for r in got)
    assert D.matches(D.build_index(documents(spark, EDGE)), none).count() == 0


def test_exact_and_proximity_matches(spark):
    docs = documents(spark, [(1, "a b c d a c", "", "", 0), (2, "c x b x a", "", "", 0), (3, "a b", "", "", 0), (4, "c a b c", "", "", 0)])
    items = spark.createDataFrame([(7, "a b c"), (8, "c a"), (9, "b b")], "item_id long, text string")
    index = D.build_index(docs, segment_words=1)
    exact = {(r.doc_id, r.item, r.start) for r in D.matches(index, items).collect()}
    assert exact == {(1, 7, 0), (4, 7, 1), (4, 8, 0)}
    for segment in (1, 100):
        index = D.build_index(docs, segment_words=segment)
        for span in (3, 5):
            want = set()
            for d, t in ((1, "abcdac"), (2, "cxbxa"), (3, "ab"), (4, "cabc")):
                for i, q in ((7, "abc"), (8, "ca"), (9, "b")):
                    want |= {(d, i, s) for s in range(len(t)) if t[s] in q and set(q) <= set(t[s : s + span])}
            assert {(r.doc_id, r.item, r.start) for r in D.matches(index, items, span=span).collect()} == want


def test_index_rows(spark):
    index = D.build_index(documents(spark, [(1, "b a b", "", "", 0), (2, "a", "", "", 0)]).coalesce(1))
    rows = {bytes(r.term): r.positions for r in index.filter("term is not null").collect()}
    assert rows == {b"a": [1, 4], b"b": [0, 2]}
    asked = index.filter(F.col("term") == F.lit(b"a")).select("n")
    plan = asked._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op2_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = E.queries()["op2_positional_index"](spark, sf)
    ok, msg = compare(df, ORACLE["op2_positional_index"], duck(sf))
    assert ok, msg
    assert df.filter("contaminated").count() > 0 and df.filter("n_items = 0").first().items_sha256 == hashlib.sha256(b"").hexdigest()
