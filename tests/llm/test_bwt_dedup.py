"""Repeated substrings against a direct search."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from helpers import EDGE, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_compare import compare, duck

import __spark_entry__ as E
from pitlane.llm import bwt_dedup as B
from pitlane.llm.queries import ORACLE


def direct(docs, n):
    """[(doc_id, removed spans, text)] by looking at every window."""
    docs = [(B.NO_DOC if d is None else d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, t in docs:
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        spans = []
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        out.append((d, [tuple(s) for s in spans], t))
    return out


def expected(docs, n):
    return sorted((d, len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(B.kept(t, s)).hexdigest()) for d, s, t in direct(docs, n))


def rows(df):
    return sorted((B.NO_DOC if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 7)))
    line = " ".join(word() for _ in range(14))
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.integers(0, 80)))
        kind = i % 6
        if kind == 1 and texts:
            t = texts[int(rng.integers(len(texts)))]
        if kind == 2 and texts:
            o = texts[int(rng.integers(len(texts)))]
            t = t[: len(t) // 2] + o[len(o) // 4 :] + t[len(t) // 2 :]
        if kind in (3, 4):
            t = t + "\n" + line + "\n" + t[:30]
        if kind == 5:
            t = word() * 60
        texts.append(t)
    ids = rng.permutation(n).tolist()
    return [(int(d) if d % 17 else None if d else 0, t) for d, t in zip(ids, texts, strict=True)] + [(5, texts[2]), (5, texts[2])]


@pytest.mark.parametrize("hot,shard,bucket", [(5000, 3 << 20, 4 << 20), (1, 500, 300), (3, 2000, 1000)])
def test_against_direct_search(spark, hot, shard, bucket):
    docs = corpus()
    df = clashing(documents(spark, [(d, t, "en", "s", 0) for d, t in docs]))
    got = B.repeats(df, 50, shard_bytes=shard, bucket_bytes=bucket, hot_strings=hot)
    assert rows(got) == expected(docs, 50)


def test_edges(spark):
    df = documents(spark, EDGE + [(30, EDGE[4][1], "en", "a", 0)])
    want = expected([(r[0], r[1]) for r in EDGE] + [(30, EDGE[4][1])], 50)
    assert rows(B.repeats(df, 50)) == want
    assert B.repeats(documents(spark, []), 50).count() == 0 and B.remove_repeats(documents(spark, [])).count() == 0


def test_removal_keeps_rows_and_characters(spark):
    docs = corpus(8)
    df = documents(spark, [(d, t, "en", f"s{i}", len(t)) for i, (d, t) in enumerate(docs)] + [(900, None, None, "null", None), (901, "", "en", "empty", 0)])
    got = {r.source: r for r in B.remove_repeats(df).collect()}
    assert B.remove_repeats(df).columns == df.columns
    for i, (d, spans, text) in enumerate(direct(docs, 50)):
        cut = B.whole_characters(text, spans)
        left = B.kept(text, cut).decode()
        if cut and not left:
            assert f"s{i}" not in got
        else:
            assert got[f"s{i}"].text == left and got[f"s{i}"].n_chars == len(left)
            assert got[f"s{i}"].doc_id == (None if d == B.NO_DOC else d)
    assert got["null"].text is None and got["empty"].text == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=12), st.integers(2, 9))
def test_merge_of_transforms(texts, length):
    raw = sorted({t.encode() for t in texts if len(t) >= length}) or [b"a" * length]
    slices = np.arange(len(raw)) % 3
    least = np.arange(len(raw), dtype=np.int64)[::-1].copy()
    flat, stop = B.least_documents(raw, slices, least, length)
    got = np.split(flat, stop[:-1])
    assert [len(x) for x in got] == [len(t) - length + 1 for t in raw]
    for i, t in enumerate(raw):
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            assert got[i][k] == min(int(d) for x, d in zip(raw, least, strict=True) if w in x)


def test_common_prefixes_of_the_interleave():
    texts = [b"banana", b"ananas", b"bandana"]
    parts = [np.frombuffer(t + b"\xff", np.uint8) + np.uint8(1) for t in texts]
    orders, transforms = zip(*(B.slice_transform(p, 10) for p in parts), strict=True)
    merged, common = B.merge_transforms(list(transforms), 10)
    suffixes = [bytes(p[i:]) for p, o in zip(parts, orders, strict=True) for i in o]
    order = [suffixes[i] for i in merged]
    head = [s[: s.index(0)] for s in order]
    assert head == sorted(head)
    for a, b, c in zip(head, head[1:], common[1:].tolist(), strict=False):
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == k or (k == min(len(a), len(b)) == max(len(a), len(b)) and c >= k)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=9), st.integers(2, 9))
def test_intervals_are_those_of_the_whole_interleave(texts, length):
    parts = [np.frombuffer(b"\xff".join([*texts[i::3], b""]), np.uint8) + np.uint8(1) for i in range(min(3, len(texts)))]
    orders, transforms = zip(*(B.slice_transform(p, length) for p in parts), strict=True)
    merged, common = B.merge_transforms(list(transforms), length)
    suffixes = [bytes(p[i : i + length]) for p, o in zip(parts, orders, strict=True) for i in o]
    want = []
    for i, c in zip(merged.tolist(), common.tolist(), strict=True):
        if c < length or not want:
            want.append([])
        want[-1].append(i)
    full = lambda i: len(suffixes[i]) == length and 0 not in suffixes[i]
    want = {frozenset(g) for g in want if len(g) > 1 and full(g[0])}
    alive, block = B.repeated_intervals(list(transforms), length)
    assert {frozenset(alive[block == b].tolist()) for b in set(block.tolist())} == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op3_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = E.queries()["op3_bwt_merge"](spark, sf)
    ok, msg = compare(df, ORACLE["op3_bwt_merge"], duck(sf))
    assert ok, msg
