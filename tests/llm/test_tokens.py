"""Token files and packing against the plain tokenizer."""

from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import EDGE, clashing, documents
from tokenizers import Tokenizer

import __spark_entry__ as E
from pitlane.llm import packing, token_files
from pitlane.llm.common import scratch
from pitlane.llm.encoders import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(path):
    texts = [r[1] or "" for r in EDGE] + [
        "a  b", " a", "a ", "\ta\n\n b", "x \u3000y", "it's 'tis we'LL", "A\u0301 e\u0301 \u212b \u03a3\u03a3", "...a,b;c\r\nd", "\x00a \x1c b\x1d", "  ", "\n",
        "a <|endoftext|> b", "x<|ENDOFTEXT|>y <|startoftext|>", "<|endoftext|>", "a<|endof text|>", "<|endoftext|><|endoftext|> é", "<| endoftext |>",
        "don't.\nI'm 3.14 a_b ###x", "ŒUVRE İstanbul ǅ ŉ", "مرحبا بالعالم", "👍🏽 ok👍",
    ]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    enc, ref = Encoder(path, cache_words=50), plain(path)
    assert enc.kind != "whole"
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref(t), t[:80]


def expected_op1(rows):
    ref, start, out = plain(WORD), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ref(text), 1]
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_op1_on_the_small_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = E.queries()["op1_token_files"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected_op1(rows)


def test_token_files_edges_layout_and_selective_reads(spark):
    path = scratch(spark, "t")
    df = clashing(documents(spark, EDGE))
    token_files.write_tokens(df, path, WORD, parts=4, row_group_bytes=64 << 10, page_bytes=4 << 10)
    got = token_files.token_digests(spark, path).collect()
    ref = plain(WORD)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(ref(t)) + 1, crc([*ref(t), 1])) for d, t, *_ in EDGE)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((r[0] for r in EDGE), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1]]
    assert {(r.doc_id, r.start) for r in token_files.read_metadata(spark, path).collect()} == {(r.doc_id, r.start) for r in got}
    some = token_files.read_tokens(spark, path, 7, 8)
    assert sorted(r.doc_id for r in some.collect()) == [7, 8, 8, 8]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,7), LessThanOrEqual(doc_id,8)]" in some._jdf.queryExecution().toString()
    import glob

    for f in glob.glob(path.removeprefix("file:") + "/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
            # a dictionary that would not pay (few tokens) gives way to deltas
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(cols["tokens.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in cols["local_start"].encodings


def test_token_files_of_an_empty_table(spark):
    path = scratch(spark, "t")
    token_files.write_tokens(documents(spark, []), path, WORD)
    assert token_files.token_digests(spark, path).count() == 0


def check_packing(rows, docs, size=1024, max_pieces=None, max_attention=None):
    ref = plain(BYTE)
    want = []
    for doc, text in docs:
        ids = [*ref(text), 2]
        want += [(doc, k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), size))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= size and len(items) <= (max_pieces or size) and sum(n * n for _, n in items) <= (max_attention or size**2)
    return len(bins), sum(r.length for r in rows)


def test_op6_on_the_small_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    n, total = check_packing(E.queries()["op6_best_fit_packing"](spark, SF).collect(), docs)
    assert n <= -(-total // 1024) + 2


@pytest.mark.parametrize("score", ["residual_norm", "dot"])
@pytest.mark.parametrize("caps", [(None, None), (3, None), (None, 20_000)])
def test_packing_edges_under_every_capacity(spark, score, caps):
    rows = EDGE + [(100 + i, "word " * (i % 37), "en", "a", 0) for i in range(200)]
    got = packing.pack(clashing(documents(spark, rows)), BYTE, max_tokens=128, max_pieces=caps[0], max_attention=caps[1], score=score).collect()
    check_packing(got, [(r[0], r[1]) for r in rows], 128, *caps)
    assert packing.pack(documents(spark, []), BYTE).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    hist = {int(n): int(c) for n, c in zip(rng.permutation(1024)[:300] + 1, rng.integers(1, 2000, 300), strict=True)}
    runs, n = packing.plan_bins(hist)
    for length, count in hist.items():
        mine = sorted((lo, hi) for x, lo, hi, _, _ in runs if x == length)
        assert mine[0][0] == 0 and mine[-1][1] == count and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
    total = sum(k * v for k, v in hist.items())
    assert n <= 1.02 * total / 1024 + 2


def test_word_parts_are_tokenized_once(monkeypatch):
    """Marks, line feeds and case do not make a word another one to the tokenizer."""
    for path, words in ((WORD, 1), (BYTE, 3)):
        enc, ref, asked = Encoder(path), plain(path), []
        real = enc._letters
        monkeypatch.setattr(enc, "_letters", lambda word, space: asked.append((word, space)) or real(word, space))  # noqa: B023
        text = "thorin thorin, thorin.\nThorin! thorin; thorin: thorin?\nThorin, thorin"
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ref(text)
        assert len(asked) == len(set(asked)) == words, asked


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer_on_mixed_parts(path):
    rng = np.random.default_rng(5)
    parts = ["a", "Th", "É", "ñ", "ß", "İ", "ŉ", "漢", "́", "7", ".", ",", "!", "...", "'s", "_", "***", " ", " ", "  ", "\n", "\n\n", "\t", "\x01", "\xa0", "Σ", "end.\nIn ", "word, "]
    enc, ref = Encoder(path, cache_words=50), plain(path)
    for n in rng.integers(0, 12, 4000):
        t = "".join(rng.choice(parts, n))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ref(t), repr(t)
