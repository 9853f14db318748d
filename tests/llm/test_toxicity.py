"""The recurrent network: gradients, windows, held-out accuracy and edge cases."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
from helpers import EDGE, clashing, documents

import __spark_entry__ as E
from pitlane.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in T.initial().items()}
    inputs = T.Inputs([b"ab", b"cde", b"f", b"ab\xc3\xa9"])
    ids = rng.integers(0, 4, (3, T.WINDOW))
    ids[1, 5:] = -1
    ids[2, 1:] = -1
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.sum(np.logaddexp(0, T.forward(w, inputs.vectors(w), ids)) - y * T.forward(w, inputs.vectors(w), ids)))
    keep = {}
    vectors = inputs.vectors(w)
    logit = T.forward(w, vectors, ids, keep)
    grads = T.backward(w, inputs, vectors, np.zeros(4, bool), keep, T._sigmoid(logit) - y)
    for name, at in (("Wf", (3, 7)), ("Ub", (2, 30)), ("Uf", (1, 5)), ("cb", (4,)), ("A", (5, 3)), ("v", (2,)), ("o", (20,)), ("bias", (0,)), ("word", (inputs.word[1], 4)), ("gram", (inputs.gram[0], 2))):
        old, e = w[name][at], 1e-3
        w[name][at] = old + e
        up = loss()
        w[name][at] = old - e
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * e) - grads[name][at]) < 2e-2 * max(0.05, abs(grads[name][at])), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 48, 49, 100, 1000):
        m = T.window_matrix(np.arange(n))
        assert set(m[m >= 0].tolist()) == set(range(n))
        assert all(b - a == T.STRIDE for a, b in zip(T.windows_of(n), T.windows_of(n)[1:], strict=False))
        assert (m[:, 0] >= 0).all() or n == 0


def test_a_document_scores_as_its_highest_window():
    w = T.initial()
    text = b" ".join(b"w%d" % (i % 37) for i in range(500))
    best, parts = T.document_logits(w, [text, b"", None, b"one"])
    assert len(parts[0]) == len(T.windows_of(500)) and best[0] == parts[0].max() and len(parts[1]) == len(parts[2]) == 1
    words = text.split()
    alone = [T.document_logits(w, [b" ".join(words[s : s + T.WINDOW])])[0][0] for s in T.windows_of(500)]
    assert np.allclose(parts[0], alone, atol=1e-4)


def test_held_out_documents_are_told_apart():
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    train = [r for r in rows if not held(r[0])]
    sample = [(t.encode(), y) for k in (0, 1) for _, t, y in [r for r in train if r[2] == k][:360]]
    w, middle = T.train(sample)
    test = [r for r in rows if held(r[0])]
    s, y = T.document_logits(w, [t.encode() for _, t, _ in test])[0] - middle, np.array([r[2] for r in test])
    rank = np.argsort(np.argsort(s))
    assert (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum() > 0.93
    assert ((s >= 0) == y).mean() > 0.92


def test_op8_and_edges(spark):
    df = E.queries()["op8_bigru_toxicity"](spark, SF)
    rows = df.collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id) for r in rows)
    labels = spark.createDataFrame([(5, 1, 1), (8, 1, 0), (9, 1, 0), (9, 1, None), (7, 0, 1), (7, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.score_documents(clashing(documents(spark, EDGE)).drop("score"), labels, max_rows=5).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGE)
    none = T.score_documents(documents(spark, EDGE), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert T.score_documents(documents(spark, []), labels).count() == 0


def test_scores_do_not_see_labels_of_held_out_rows(spark):
    docs = documents(spark, [(i, f"word{i % 7} other{i % 3} thing{i}", "en", "s", 0) for i in range(60)])
    mark = lambda flip: spark.createDataFrame([(i, 1, int((i % 3 == 0) != (flip and held(i)))) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in T.score_documents(docs, mark(flip)).collect()} for flip in (False, True))
    assert a == b
