"""The length-stratified index against a direct scan, with its bounds, edges and skew."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE, clashing, documents
from oracle_compare import compare, duck

import __spark_entry__ as E
from pitlane.llm import ranked_search as R
from pitlane.llm.queries import ORACLE

ITEM = "item_id long, text string"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def direct(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in queries.items():
        scored = []
        for d, c, size in docs:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s:
                scored.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, items, k=10, segment=8 << 20, block=1 << 20):
    index = R.build_index(clashing(documents(spark, rows)), segment_bytes=segment)
    got = R.search(index, spark.createDataFrame(items, ITEM), k, block_bytes=block)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr)


ITEMS = [(1, "one two three"), (1, "FIVE"), (2, "w1x1 w2x2 w3x3 naïve 世界"), (3, None), (4, "..."), (None, "text same"), (5, "nowhere"), (6, "the a")]


@pytest.mark.parametrize("segment,block", [(8 << 20, 1 << 20), (60, 12)])
def test_edges_against_a_direct_scan(spark, segment, block):
    assert found(spark, EDGE, ITEMS, 10, segment, block) == direct([r[:2] for r in EDGE], ITEMS, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_tables_against_a_direct_scan(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.12)), 59)] for _ in range(n))
    rows = [(i, text(r.choice([5, 5, 5, 8, r.randint(1, 300)])), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, "v0 v1 v30 v31 v31", "en", "s", 0) for i in range(150)]  # a third of all rows: one length, one text
    rows += [(5, "v0 v50", "en", "s", 0)] * 100  # one id again and again
    items = [(i, text(r.randint(1, 25))) for i in range(25)]
    assert found(spark, rows, items, 7, 700, 200) == direct([x[:2] for x in rows], items, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert found(spark, [], ITEMS) == []
    index = R.build_index(documents(spark, EDGE))
    assert R.search(index, none).collect() == [] and R.search(index, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_do_not_cross_texts():
    texts = pa.array(["ab", "", "cd e", None, "é-F", "  "])
    assert R.term_counts(texts).tolist() == [1, 0, 2, 0, 2, 0]
    assert R.query_terms("É1 a_b A") == {"É1".encode(), b"a", b"b"}


def test_bounds_stop_early_and_lose_nothing():
    m = np.repeat(np.arange(10, 210), 20)
    docs = np.arange(len(m), dtype=np.int32)
    tf = np.where(m == 10, 3, 1).astype(np.int32)
    rare = docs[m == 30]
    segment = R.Postings(m, docs.tolist(), {0: (tf, docs), 1: (np.ones(len(rare), np.int32), rare)}, {0: 5, 1: 4000})
    best = R.Best(10)
    assert segment.search([0, 1], best) == 1
    want = 5 * (10**9 // (1000 + 240)) + 4000 * (10**9 // (1000 + 240))
    assert best.scores.tolist() == [want] * 10 and best.ids == rare[:10].tolist()
    assert segment.search([0], best) == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    ok, msg = compare(E.queries()["op13_ranked_search"](spark, path), ORACLE["op13_ranked_search"], duck(path))
    assert ok, msg
