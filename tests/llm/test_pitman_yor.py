"""The language model: exact parts against plain Python, the model against its own laws and held-out text."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import EDGE, clashing, documents

import __spark_entry__ as E
from pitlane.llm import pitman_yor as P


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base(docs):
    held = {i: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(docs)}
    c = Counter(w for i, (_, t) in enumerate(docs) if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, (d, t) in enumerate(docs):
        w = tokens(t)
        out.append((d, held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def check(rows, docs):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    want = sorted(base(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op5(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = E.queries()["op5_pitman_yor"](spark, sf).collect()
    check(rows, duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    # perplexity a token, on text that was not trained on: far under the unigrams
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.1


def test_edges(spark):
    rows = P.score_documents(clashing(documents(spark, EDGE)).drop("score")).collect()
    check(rows, [(r[0], r[1]) for r in EDGE])
    assert P.score_documents(documents(spark, [])).count() == 0
    only_held = P.score_documents(documents(spark, [(None, "a b", "", "", 0)])).collect()
    assert only_held[0].train_tokens == 0 and math.isclose(only_held[0].score, 0, abs_tol=1e-6)


def test_shards_and_buckets_do_not_change_the_exact_parts(spark):
    df = documents(spark, EDGE)
    check(P.score_documents(df, shard_bytes=2000, bucket_bytes=1000).collect(), [(r[0], r[1]) for r in EDGE])


def test_probabilities_sum_to_one_in_every_restaurant():
    rng = np.random.default_rng(1)
    room, customers = np.repeat(np.arange(5), 40), rng.integers(1, 400, 200)
    p = np.full(200, 1 / 60)  # 40 dishes and a rest of 20 / 60
    x = P.Restaurants(room, customers, 5, P.DISCOUNT)
    t = x.averaged_tables(p, 3, 2, 4)
    assert (t >= 1).all() and (t <= customers).all() and t.max() > 1
    n = P.STRENGTH + np.bincount(room, customers)
    own = (customers - P.DISCOUNT * t) / n[room]
    left = (P.STRENGTH + P.DISCOUNT * np.bincount(room, t)) / n
    assert np.allclose(np.bincount(room, own) + left, 1)


def test_expected_tables_of_one_dish():
    """Against exact seating one customer at a time, also past the size where blocks are drawn."""
    for customers in (30, 1500):
        x = P.Restaurants(np.zeros(1, int), np.array([customers]), 1, 0.5)
        rng, got, want = np.random.default_rng(2), [], []
        for _ in range(600):
            x.seat(np.array([0.3]), rng)
            got.append(x.tables[0])
            t = 1
            for i in range(1, customers):
                new = (P.STRENGTH + 0.5 * t) * 0.3
                t += rng.random() < new / (new + i - 0.5 * t)
            want.append(t)
        assert abs(np.mean(got) - np.mean(want)) < 5 * np.std(want) / 600**0.5 + 0.02 * np.mean(want)


def test_split_contexts(spark, monkeypatch):
    """Contexts dealt in parts give the same exact columns and proper scores."""
    monkeypatch.setattr(P, "WIDE", 1)
    import pyarrow as pa

    table = pa.table({"shard": pa.array([0, 0], pa.int32()), "held_out": [False, True], "text": [b"a b a c a d", b"a b x"]})
    s = P.Shard(table)
    assert s.sizes.tolist() == [7, 4] and s.counts().sum() == 7
    asked = P.ask_words(table, 4)
    words = pa.concat_tables([P.answer_words(asked.filter(pa.compute.equal(asked.column("bucket"), b)), 1, 4, 1, 2, 0) for b in set(asked.column("bucket").to_pylist())])
    parent = P.Parent(s, words, 4)
    assert parent.n == 7 and parent.distinct == 5 and len(parent.wide) == 2
    pairs = P.ask_pairs(table.append_column("doc_id", pa.array([1, 2])), words, 4)
    replies = pa.concat_tables([P.answer_pairs(pairs.filter(pa.compute.equal(pairs.column("bucket"), b)), 1, 2, 0) for b in set(pairs.column("bucket").to_pylist())])
    both = pa.concat_tables([words.append_column("kind", pa.array([1] * len(words))), replies.append_column("kind", pa.array([2] * len(replies)))])
    done = P.finish(table.append_column("doc_id", pa.array([1, 2])), both, 4).to_pylist()
    assert [r["n_known"] for r in done] == [7, 3] and all(-20 < r["score"] < 0 for r in done)


def plain_chain(texts, sweeps, burn):
    """Predictive probabilities of pairs, from a chain that seats one customer after another: {(context, word): p}, and for unknown contexts."""
    import random

    rng = random.Random(5)
    pairs = Counter(p for t in texts for p in zip([b"\n", *tokens(t)], tokens(t)))
    vocabulary = {w for _, w in pairs}
    base = 1 / (len(vocabulary) + 1)

    def seat(customers, t, total, d, p):
        """Tables of a dish, its customers seated again."""
        t_new = 1
        for i in range(1, customers):
            new = (P.STRENGTH + d * (total - t + t_new)) * p
            t_new += rng.random() < new / (new + i - d * t_new)
        return t_new

    tables, top = dict(pairs), dict.fromkeys(vocabulary, 1)
    sums, rooms = Counter(), {c for c, _ in pairs}
    for sweep in range(sweeps):
        guests = Counter()
        for (_, w), t in tables.items():
            guests[w] += t
        for w in top:
            top[w] = seat(guests[w], top[w], sum(top.values()), P.PARENT_DISCOUNT, base)
        left = P.STRENGTH + P.PARENT_DISCOUNT * sum(top.values())
        p = {w: (guests[w] - P.PARENT_DISCOUNT * top[w] + left * base) / (P.STRENGTH + sum(guests.values())) for w in top}
        if sweep >= burn:
            n, total = Counter(), Counter()
            for (c, w), t in tables.items():
                n[c] += pairs[c, w]
                total[c] += t
            for c in [*rooms, None]:
                for w in top:
                    own = pairs[c, w] - P.DISCOUNT * tables.get((c, w), 0)
                    sums[c, w] += (own + (P.STRENGTH + P.DISCOUNT * total[c]) * p[w]) / (P.STRENGTH + n[c]) / (sweeps - burn)
        totals = Counter()
        for (c, _), t in tables.items():
            totals[c] += t
        for c, w in tables:
            t = seat(pairs[c, w], tables[c, w], totals[c], P.DISCOUNT, p[w])
            totals[c] += t - tables[c, w]
            tables[c, w] = t
    return sums


def test_the_parent_is_seated_on_the_contexts_tables(spark):
    """A word that is frequent after one word only is rare elsewhere, as in a chain that seats one customer after another."""
    rows = [(i, "a x", "", "", 0) for i in range(400)] + [(1000 + i, f"c{i} y", "", "", 0) for i in range(60)]
    asked = [(2000, "new x"), (2001, "new y"), (2002, "a y"), (2003, "a x"), (2004, "c1 x")]
    docs = documents(spark, rows + [(i, t, "", "", 0) for i, t in asked])
    got = {r.doc_id: r.score for r in P.score_documents(docs, P.F.col("doc_id") >= 2000, burn=8, samples=16).collect()}
    want = plain_chain([r[1] for r in rows], 75, 25)
    # the pair of the document's two words alone: what follows and precedes it is the same in both
    second = lambda t: math.log10(want[(w if (w := t.split()[0].encode()) != b"new" else None), t.split()[1].encode()])
    assert abs((got[2001] - got[2000]) - (second("new y") + math.log10(want[b"y", b"\n"]) - second("new x") - math.log10(want[b"x", b"\n"]))) < 0.15
    assert abs((got[2003] - got[2002]) - (second("a x") + math.log10(want[b"x", b"\n"]) - second("a y") - math.log10(want[b"y", b"\n"]))) < 0.15
    assert got[2001] > got[2000]


def chain(table, buckets, burn, samples, seed):
    """The dealt chain of one shard, in this process: probability by (context, follower) hashes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def each(f, left, right=None):
        here = set(left.column("bucket").to_pylist())
        of = lambda t, b: t.filter(pc.equal(t.column("bucket"), b))
        return pa.concat_tables([f(of(left, b)) if right is None else f(of(left, b), of(right, b)) for b in sorted(here)])

    kind = lambda t, k: t.filter(pc.equal(t.column("kind"), k))
    words = each(lambda t: P.answer_words(t, 1, buckets, 0, 1, seed), P.ask_words(table, buckets))
    s = P.Shard(table)
    known = P.Parent(s, words, buckets).distinct
    opened = contexts = each(lambda t: P.open_contexts(t, buckets, seed), P.ask_pairs(table, words, buckets))
    parent, tables = P.sweep_rows([]), float(known)
    for k in range(1, burn + samples + 1):
        parent = each(lambda a, b: P.sweep_parent(a, b, known, tables, seed, k), kind(contexts, 1), kind(parent, 0))
        tables, n = (pc.sum(kind(parent, 0).column(c)).as_py() for c in ("tables", "customers"))
        contexts = each(lambda a, b: P.sweep_contexts(a, b, buckets, known, tables, n, burn, samples, seed, k), kind(contexts, 0), kind(parent, 1))
    answers = each(P.answer_places, kind(opened, 2), kind(contexts, 3))
    wide = P.Parent(s, words, buckets).wide
    pairs, _ = s.pairs()
    by = s.pairs_by_bucket(pairs, wide, buckets)[0]
    p = {}
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        got = P._from_log(*P.unpack(data, "<u2"))
        p |= {(int(s.hashes[x >> 32]), int(s.hashes[x & 0xFFFFFFFF])): v for x, v in zip(pairs[by[b]].tolist(), got.tolist(), strict=True)}
    return p, len(wide)


def test_a_split_context_is_one_restaurant(monkeypatch):
    """Its probabilities sum to one, and are those of the context in one piece, up to sampling."""
    import pyarrow as pa

    words = [f"w{j}" for j in range(600)]
    train = [" ".join(f"hot {w}" for _ in range(20 if j % 2 else 2)) + f" {w} {w}" for j, w in enumerate(words)]
    # every word, the end and one unknown word after "hot"
    asked = [f"hot {w}" for w in [*words, "hot", "new"]] + ["hot"]
    table = pa.table({"shard": pa.array([0] * (len(train) + len(asked)), pa.int32()), "held_out": [False] * len(train) + [True] * len(asked), "text": [t.encode() for t in train + asked]})
    hot = P.xxhash.xxh64_intdigest(b"hot")
    whole, n_whole = chain(table, 16, 6, 60, 1)
    monkeypatch.setattr(P, "WIDE", 500)
    split, n_split = chain(table, 16, 6, 60, 1)
    assert (n_whole, n_split) == (0, 1)
    for p in (whole, split):
        assert abs(sum(v for (c, _), v in p.items() if c == hot) - 1) < 0.01
    ratio = np.array([math.log10(split[k] / whole[k]) for k in whole if k[0] == hot])
    assert abs(ratio.mean()) < 0.01 and np.abs(ratio).max() < 0.15


def test_sorted_hashes_travel_by_byte_planes():
    """The upper bytes of the differences lie together, so a compressor that knows repeats alone removes them."""
    import pyarrow as pa

    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    (steps,) = P._steps(hashes)
    assert (P._from_steps(steps) == hashes).all() and len(P._from_steps(P._steps(hashes[:0])[0])) == 0
    assert pa.Codec("lz4").compress(steps.tobytes()).size < 0.9 * hashes.nbytes


def shard_of(texts):
    import pyarrow as pa

    return pa.table({"shard": pa.array([0] * len(texts), pa.int32()), "held_out": [i % 3 == 1 for i in range(len(texts))], "text": pa.array(texts, pa.binary())})


ODD = [b"", None, b" ", b"A b\tA\n\nb\x0bc\x0cd\re", b"\x1c\x00 \x00\x1f \x85 \xa0", b" lead", b"trail ", "Ä é ÄÉ".encode(), b"x" * 50, b"\n", b"A b"]


@pytest.mark.parametrize("block", [1, 20, 1 << 20])
def test_words_are_numbered_as_split_words(block):
    ids, words, counts = P.numbered(ODD, block)
    want = [(t or b"").lower().split() for t in ODD]
    assert counts.tolist() == [len(w) for w in want]
    assert [words[i] for i in ids] == [x for w in want for x in w] and len(set(words)) == len(words)
    assert [len(x) for x in P.numbered([], block)] == [0, 0, 0] and [len(x) for x in P.numbered([None, b" "], block)] == [0, 0, 2]


def test_a_shard_holds_the_tokens_and_pairs_of_its_texts():
    s = P.Shard(shard_of(ODD))
    want = [[*(t or b"").lower().split(), b""] for t in ODD]
    number = lambda w: int(np.searchsorted(s.hashes, np.uint64(P.xxhash.xxh64_intdigest(w))))
    assert s.tokens.tolist() == [number(x) for w in want for x in w] and s.sizes.tolist() == [len(w) for w in want]
    trained = Counter((number(c) << 32) + number(x) for i, w in enumerate(want) if i % 3 != 1 for c, x in zip([b"", *w], w))
    pairs, counts = s.pairs()
    again, inverse = s.distinct_pairs()
    assert (again == pairs).all() and (pairs[inverse] == s.pair_of).all() and (np.diff(pairs) > 0).all()
    assert counts.tolist() == [trained[x] for x in pairs.tolist()]


def test_what_travels_takes_few_bytes():
    """Shuffle and disk: a pair that is asked takes less than its arrays do under the shuffle's own compression."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [f"w{j}".encode() for j in range(20_000)]
    texts = [b" ".join(words[j] for j in np.minimum(rng.zipf(1.3, 300), 20_000) - 1) for _ in range(400)]
    table = shard_of(texts)
    asked = P.ask_words(table, 4)
    answers = pa.concat_tables([P.answer_words(asked.filter(pa.compute.equal(asked.column("bucket"), b)), 1, 4, 0, 1, 1) for b in range(4)])
    asks = P.ask_pairs(table, answers, 4)
    pairs = len(P.Shard(table).pairs()[0])
    sizes = [pa.Codec("lz4").compress(d).size for d in asks.column("data").to_pylist()]
    assert sum(sizes) < 5.8 * pairs  # 6.4 without byte planes and entropy coding
    # and comes back whole
    a = [P.Asked(asks.filter(pa.compute.equal(asks.column("bucket"), b))) for b in range(4)]
    assert sum(len(x.at) for x in a) == pairs and sum(x.counts.sum() for x in a) == P.Shard(table).counts().sum()
    c = P.Contexts.opened(a[0])
    c.seat(a[0].start, np.random.default_rng(1))
    c.predict(a[0].start, *c.totals(), 1)
    for d in (P.Contexts.unpacked(c.packed()), P.Contexts.unpacked(P.Contexts.unpacked(c.packed()).packed())):
        assert all((getattr(c, k) == getattr(d, k)).all() for k in ("whole", "followers", "words", "at", "counts", "tables")) and np.allclose(c.mean, d.mean, rtol=1e-3)


def test_numbers_travel_whole():
    rng = np.random.default_rng(4)
    for kind in ("<u2", "<u4", "<u8"):
        for n in (0, 1, 1000):
            a = rng.integers(0, 1 << 8 * int(kind[2]) - 1, n).astype(kind)
            assert (P._from_planes(P._planes(a, kind)) == a).all()
    followers = rng.integers(1, 40, 500)
    at = np.concatenate([np.sort(rng.choice(1 << 20, n, replace=False)) for n in followers])
    assert (P._from_places(P._places(at, followers), followers) == at).all()
    assert len(P._from_places(P._places(at[:0], followers[:0]), followers[:0])) == 0
    values = rng.integers(0, 300, 1000).astype(np.uint64)
    for v in (values, values[:0]):
        distinct, first, inverse = P.ranked(v)
        assert (distinct == np.unique(v)).all() and (v[first] == distinct).all() and (distinct[inverse] == v).all()
    (data,) = P.unpack(P.pack(values), "<u8")
    assert (data == values).all()


def test_only_dishes_of_several_customers_are_drawn():
    """The tables are those of a seating of all dishes in one order: the most customers first."""
    rng = np.random.default_rng(5)
    room, customers, p = np.sort(rng.integers(0, 9, 800)), np.minimum(rng.zipf(1.7, 800), 60), rng.random(800) * 0.1
    x = P.Restaurants(room, customers, 9, 0.8)
    for k in range(3):
        before, draw = x.tables.copy(), np.random.default_rng(k)
        x.seat(p, np.random.default_rng(k), 2)
        rest = np.bincount(room, before)[room] - before + 2
        want, order = np.ones(800), np.argsort(-customers, kind="stable")
        for i in range(1, customers.max()):
            live = order[: (customers > i).sum()]
            new = (P.STRENGTH + 0.8 * (rest[live] + want[live])) * p[live]
            want[live] += draw.random(len(live)) < new / (new + i - 0.8 * want[live])
        assert (x.tables == want).all()
