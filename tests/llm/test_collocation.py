"""Tiled pair counts and phrases against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, clashing, documents
from oracle_compare import compare, duck

import __spark_entry__ as E
from pitlane.llm import collocation as C
from pitlane.llm.queries import ORACLE


def direct(rows, min_count, top, max_words=5):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        held = set()  # phrases that a longer one always holds
        for q, a in counts.items():
            if a >= min_count:
                held |= {p for m in range(2, len(q)) for i in range(len(q) - m + 1) if counts[p := q[i : i + m]] <= a}
        scored = []
        for p, a in counts.items():
            if len(p) < 2 or a < min_count or p in held:
                continue
            s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(spark, rows, **kw):
    docs = clashing(documents(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)]))
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(docs, **kw).collect())


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "cat", "SAT", "on", "a", "mat", "é", "世界", "x.y", "z\x00z", " "]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\v", ""]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    return rows + [("on the mat the cat sat on the mat", "en")] * 40 + [("the the the the the the the", "fr")] * 5 + [(None, "en"), ("", "de")]


@pytest.mark.parametrize("seed,shard,sent", [(1, 16 << 20, 1000), (2, 300, 0), (3, 300, 40)])
def test_phrases_against_plain_counting(spark, seed, shard, sent):
    rows = corpus(seed)
    assert found(spark, rows, min_count=4, top=30, shard_bytes=shard, broadcast_rows=sent) == direct(rows, 4, 30)


def test_edges_and_empty_tables(spark):
    rows = [r[1:3] for r in EDGE]
    assert found(spark, rows, min_count=2, top=500) == direct(rows, 2, 500)
    assert found(spark, []) == [] and found(spark, [(None, None), ("", "en")]) == []


@pytest.mark.parametrize("side,dense", [(4, 1), (4, 64), (512, 64), (2, 10**9)])
def test_tiles_count_every_pair(side, dense):
    r = np.random.default_rng(side)
    a, b = (np.minimum(r.geometric(0.05, 5000) - 1, 300) for _ in range(2))
    x, y, n, at = C.count_pairs(a, b, side, dense)
    assert Counter(zip(a.tolist(), b.tolist())) == dict(zip(zip(x.tolist(), y.tolist()), n.tolist()))
    assert (x[at] == a).all() and (y[at] == b).all()
    assert [len(v) for v in C.count_pairs(a[:0], b[:0])] == [0, 0, 0, 0]


def test_ids_follow_frequency(spark):
    rows = spark.createDataFrame([("en", f"w{i}", 10_000 // (i + 1) + 1) for i in range(500)] + [("fr", "a", 5)], "lang string, words string, f long")
    got = C.ranked(rows, ["words"]).collect()
    assert sorted(r.id for r in got if r.lang == "en") == list(range(500)) and [r.id for r in got if r.lang == "fr"] == [0]
    f = [r.f for r in sorted((r for r in got if r.lang == "en"), key=lambda r: r.id)]
    assert all(x * 2 ** (1 / 8) >= max(f[i:]) for i, x in enumerate(f))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = E.queries()["op12_pair_tiles"](spark, path)
    ok, msg = compare(got, ORACLE["op12_pair_tiles"], duck(path))
    assert ok, msg


def test_words_are_numbered_alike_in_pieces(monkeypatch):
    texts = [t.encode() for t, _ in corpus(5) if t]
    seq, words, n = C.encode(texts)
    for piece in (1, 7, 100):
        monkeypatch.setattr(C, "PIECE", piece)
        again = C.encode(texts)
        assert (again[0] == seq).all() and again[1].equals(words) and (again[2] == n).all()


def test_shards_are_read_and_handed_over_a_few_at_a_time(spark):
    """Rows of megabytes: neither a row group nor an Arrow batch holds all of a file's."""
    import pyarrow.parquet as pq
    from pitlane.session import row_by_row

    r = random.Random(6)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(100_000)), "en", "s", 0) for i in range(24)]
    shards = C.word_shards(documents(spark, rows).coalesce(1), shard_bytes=1 << 20)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")) for f in shards.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24 and max(g.num_rows for g in groups) <= 12
    own = row_by_row(spark, 1 << 20).read.schema(shards.schema).parquet(*shards.inputFiles())
    count = lambda batches: (b.from_arrays([[b.num_rows]], ["n"]) for b in batches)
    held = [x.n for x in own.select("seq", "words").mapInArrow(count, "n long").collect()]
    assert sum(held) == 24 and max(held) == 1
