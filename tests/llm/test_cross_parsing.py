"""Cross-parsing against a search in the sample itself, sampling bounds, edges and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, EDGE, LONG, clashing, documents

import __spark_entry__ as E
from pitlane.llm import cross_parsing as C
from pitlane.llm.common import table

SAMPLES = {"aa": b"the cat sat on the mat, the end", "bb": "le chat était sur le tapis".encode(), "cc": b"xyz"}


def flat(text: str) -> bytes:
    out = bytearray()
    for b in text.lower().encode():
        b = b if b >= 128 or 97 <= b <= 122 else 32
        if b != 32 or (out and out[-1] != 32):
            out.append(b)
    return bytes(out)


def parse(text: bytes, sample: bytes) -> int:
    """Phrases by looking for every prefix in the sample."""
    i = n = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = j, n + 1
    return n


def direct(text: str, samples: dict[str, bytes]) -> tuple[str, float]:
    cost = sorted((parse(flat(text), flat(v.decode())) * math.log2(len(flat(v.decode())) + 1), k) for k, v in samples.items())
    return cost[0][1], cost[1][0] / (cost[0][0] + cost[1][0]) if len(cost) > 1 else 1.0


def strings(seed: int) -> list[str]:
    r = random.Random(seed)
    words = ["the", "cat", "chat", "était", "sur", "le", "mat", "xyz", "zz", "世界", "Q7", "sat on"]
    return ["", "a", "?", *("".join(r.choice([*words, " ", ". "]) for _ in range(r.randint(1, 60))) for _ in range(80)), "the cat " * 700]


@pytest.mark.parametrize("alone,block", [(1, 4), (24, 512), (1000, 512)])
def test_phrases_equal_a_search_in_the_sample(alone, block):
    model = C.Automata(SAMPLES)
    texts = strings(alone)
    data = [t.lower().encode() for t in texts]
    codes, sizes = C.symbols(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    assert [len(flat(t)) for t in texts] == sizes.tolist()
    got = model.phrases(model.code[codes], sizes, alone, block)
    assert got.tolist() == [[parse(flat(t), flat(SAMPLES[k].decode())) for k in model.langs] for t in texts]


def test_winner_and_score_equal_the_direct_ones():
    texts = [t for t in strings(3) if flat(t).strip()]
    model = C.Automata(SAMPLES)
    best, score = C.judge_batch(model, pa.array(texts))
    for t, b, s in zip(texts, best, score, strict=True):
        assert (model.langs[b], pytest.approx(s)) == direct(t, SAMPLES)


def test_edges(spark):
    rows = [*EDGE, (20, "12 34 ... !", "en", "a", 0), (21, "the mat", None, None, 0)]
    docs = clashing(documents(spark, rows)).withColumnsRenamed({"n": "lang_pred", "source": "a.b"})
    got = C.identify(docs, SAMPLES, keep=["doc_id", "a.b"]).collect()
    want = sorted((d if d is not None else -1, *(("und", 0.0) if not any(c.isalpha() for c in t or "") else direct(t, SAMPLES))) for d, t, *_ in rows)
    want = [(d, lang, round(s, 9)) for d, lang, s in want]
    assert got[0].asDict().keys() == {"doc_id", "a.b", "lang_pred", "score"}
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, round(r.score, 9)) for r in got) == want


def test_nothing_learnt_and_empty_tables(spark):
    docs, none = documents(spark, EDGE), documents(spark, [])
    assert C.sample_languages(none) == {}
    assert {(r.lang_pred, r.score) for r in C.identify(docs, {}).collect()} == {("und", 0.0)}
    assert C.identify(none, SAMPLES).count() == 0
    assert [r.score for r in C.identify(spark.createDataFrame([(1, "abc", "", "", 0)], DOCS), {"x": b"abc"}).collect()] == [1.0]


def test_samples_are_bounded_whatever_the_skew(spark):
    rows = [(i, f"{LONG[i * 90 : i * 90 + 3000]} mot{i}", "hot" if i % 9 else "rare", "s", 0) for i in range(400)]
    rows += [(1000, LONG * 3, "hot", "s", 0), (1001, "tiny text", "small", "s", 0), (1002, "12 34", "digits", "s", 0), (1003, "x", None, "s", 0)]
    got = C.sample_languages(documents(spark, rows), sample_bytes=20_000, piece_chars=256)
    assert set(got) == {"hot", "rare", "small"} and got["small"] == b"tiny text"
    assert all(15_000 <= len(got[k]) <= 21_000 for k in ("hot", "rare"))
    assert got == C.sample_languages(documents(spark, rows[::-1]), sample_bytes=20_000, piece_chars=256)
    assert all(len(v) <= 5_000 for v in C.sample_languages(documents(spark, rows), total_bytes=16_000, piece_chars=256).values())


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    got = E.queries()["op11_cross_parsing"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id].text or "")) for r in got)
    judged = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in judged) >= 0.98 * len(judged) > 100
    assert all(0 <= r.score <= 1 for r in got)
