"""Fingerprints and components against plain Python."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import EDGE, clashing, documents

import __spark_entry__ as E
from pitlane.llm import simhash as S


def plain(text, width=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(rows, budget=3):
    """{(doc_id, fp): component} by brute force over distinct fingerprints."""
    first = {}
    for d, f in rows:
        first[f] = min(x for x in (d, first.get(f)) if x is not None) if not (d is None and first.get(f) is None) else None
    fps = sorted(first)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget):
            x, y = find(f), find(fps[i + 1 + int(j)])
            root[max(x, y)] = min(x, y)
    least = {}
    for f in fps:
        r = find(f)
        least[r] = min((x for x in (least.get(r), first[f]) if x is not None), default=None)
    return {f: least[find(f)] for f in fps}


def check(rows, texts):
    want = [(d, plain(t)) for d, t in texts]
    comp = plain_components(want)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=key)
    assert got == sorted(((d, f"{f:016x}", comp[f]) for d, f in want), key=key)


def test_blocks_of_a_long_text():
    text = b"ab cd\te\n" * 900_000
    assert S.fingerprint(text) == S.fingerprint(text) == plain(text.decode())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op10_against_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    check(E.queries()["op10_simhash_trie"](spark, sf).collect(), duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def test_edges(spark):
    got = S.near_duplicates(clashing(documents(spark, EDGE)).drop("fingerprint")).collect()
    check(got, [(r[0], r[1]) for r in EDGE])
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_planted_fingerprints(spark):
    """Chains, a dense ball around one fingerprint, fingerprint zero and repeated classes."""
    rng = np.random.default_rng(5)
    fps = [0, 1, 7, 15]
    for _ in range(30):  # chains of up to three flips a step
        f = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(8):
            fps.append(f)
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))]
    fps += [int(x) for x in rng.integers(0, 2**64, 500, dtype=np.uint64)]
    rows = [(int(d), f) for d, f in zip(rng.permutation(2 * len(fps)), fps + fps, strict=True)]
    df = spark.createDataFrame([(d, f - 2**64 if f >= 2**63 else f) for d, f in rows], "doc_id long, fp long")
    want = plain_components(rows)
    got = {r.fp % 2**64: r.component_id for r in S.components(df).collect()}
    assert got == want


def test_walk_in_small_batches(monkeypatch):
    monkeypatch.setattr(S, "BATCH", 64)
    rng = np.random.default_rng(1)
    v = np.sort((np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 4096, 700, dtype=np.uint64))
    v = np.unique(v)
    root = S.trie_links(v, np.array([0, len(v)]), 16, 3)
    comp = plain_components([(i, int(f)) for i, f in enumerate(v)])
    assert root.tolist() == [comp[int(f)] for f in v]
