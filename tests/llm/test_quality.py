"""Quality features and risk-controlled cutoffs against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from helpers import EDGE, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E
from pitlane.llm import quality as Q
from pitlane.llm.queries import ORACLE


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    covered = {j for i, x in enumerate(wins) if c[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def features(spark, texts):
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rows = Q.with_features(df).orderBy("doc_id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


def test_features_of_edge_texts(spark):
    texts = [r[1] for r in EDGE] + ["a b c d e a b c d e", "a b c d e f", "a\n a\na\n\n\na \na", "a a a a a a a a a", "\x0bx\x0c<>#\x1cy", "a b c d e x a b c d e a b c d e", "#$%"]
    assert features(spark, texts) == [plain(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab#\n \té", max_size=120), min_size=1, max_size=40))
def test_features_of_random_texts(spark, texts):
    assert features(spark, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("n,a,level", [(50, 0.1, 0.05), (3000, 0.01, 0.001), (10, 0.01, 0.5), (200_000, 0.02, 1e-6), (1, 0.5, 0.4)])
def test_exact_binomial_limit(spark, n, a, level):
    got = spark.range(1).select(Q.most_rejections(F.lit(n).cast("long"), a, F.lit(math.log(level))).alias("k")).first().k
    tail, k = -math.inf, -1
    for i in range(n + 1):
        t = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log(1 - a)
        top = max(t, tail)
        tail = top + math.log(math.exp(t - top) + math.exp(tail - top))
        if tail > math.log(level):
            break
        k = i
    assert got == k


def labelled(spark, n, junk_every=10):
    """Good documents, and every tenth one full of symbols; languages en (most) and de (few)."""
    rows = []
    for i in range(n):
        words = [f"w{i}x{j}" for j in range(30)]
        if i % junk_every == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "de" if i % 50 == 7 else "en", "s", 0))
    labels = spark.createDataFrame([(i, int(i % junk_every != 0), 0) for i in range(n)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    return documents(spark, rows), labels


def step_by_hand(doc):
    n = max(doc.n_words, 1)
    m = {"symbols_per_word": doc.n_symbols / n, "dup_line_share": doc.n_dup_lines / max(doc.n_lines, 1), "repeat_share": doc.n_repeat_words / n,
         "same_word_share": 1 - doc.n_distinct / n, "mean_word_chars": doc.word_chars / n, "short_words": -doc.word_chars / n}
    return min(next((j for j, c in enumerate(Q.LADDERS[r]) if v > c), Q.STEPS) for r, v in m.items())


def tail(n, a, k):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log(1 - a)) for i in range(k + 1))


def chosen_by_hand(featured, labels, risk, delta):
    good = {}
    for d, q, _ in labels:
        if q is not None:
            good[d] = min(q, good.get(d, 1))
    held = {}
    for r in featured:
        if r.doc_id in good and not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words):
            held.setdefault(r.lang, []).append((step_by_hand(r), good[r.doc_id]))
    out = {}
    for lang, rows in held.items():
        n, best = sum(g for _, g in rows), None
        for j in range(Q.STEPS):
            k, bad = (sum(s <= j and g == want for s, g in rows) for want in (1, 0))
            if tail(n, risk, k) > delta / len(held):
                break
            if bad > k and (best is None or bad - k > best[3] - best[1]):
                best = (j, k, n, bad)
        if best:
            out[lang] = best
    return out


def several_strata(spark):
    """Junk of another kind in each language, some of it labelled good; one language with too few labels."""
    import random

    r, rows, labels = random.Random(3), [], []
    for i in range(3000):
        lang = ("en", "en", "de", "fr", None, "es")[i % 6]
        words, junk = [f"w{r.randint(0, 400)}" + "a" * r.randint(0, 6) for _ in range(40)], i // 6 % 9 == 0
        if junk:
            words = {"en": [w + "#|" for w in words], "de": r.sample(words[:20], 20) + r.sample(words[:20], 20), "fr": [w + "x" * 20 for w in words],
                     None: [f"{chr(97 + j % 26)}{chr(97 + r.randint(0, 25))}" for j in range(40)], "es": [w + "#" for w in words]}[lang]
        text = ("\n" if lang == "de" and junk else " ").join(words)
        rows.append((i, text, lang, "s", 0))
        if lang != "es" or i // 6 % 5 == 0:
            labels.append((i, int(not junk or i % 1080 == 0), 0))
    labels += [(0, 0, 0), (1, None, 0), (99_999, 1, 0)]
    return rows, labels


def test_joint_steps_against_plain_python_and_sql(spark, tmp_path):
    import duckdb
    from pitlane.llm.queries import QUERIES

    rows, labels = several_strata(spark)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    f = Q.with_features(docs)
    got = {}
    for r in Q.cutoffs(f, marks).collect():
        got.setdefault(r.stratum, {})[r.rule] = (r.cutoff, r.k, r.n, r.bad)
    want = chosen_by_hand(f.collect(), labels, 0.02, 0.05)
    assert len(want) >= 3 and "es" not in want
    assert got == {lang: {rule: (cuts[j], k, n, bad) for rule, cuts in Q.LADDERS.items()} for lang, (j, k, n, bad) in want.items()}
    # the registered query on these tables, against its SQL in DuckDB
    path = f"{tmp_path}/in"
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    marks.coalesce(1).write.parquet(f"{path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    out = QUERIES["op4_risk_controlled_rules"](spark, path)
    ok, msg = compare(out, ORACLE["op4_risk_controlled_rules"], con)
    assert ok, msg
    gone = {r.doc_id for r in out.collect() if not r.kept and not r.base_failed}
    assert {rows[i][2] for i in gone} == set(want)


def test_cutoffs_hold_the_risk_and_stay_off_without_proof(spark):
    docs, labels = labelled(spark, 4000)
    f = Q.with_features(clashing(docs))
    cut = Q.cutoffs(f, labels).collect()
    assert {r.rule for r in cut} == set(Q.LADDERS) and all(r.stratum == "en" and r.k <= 0.02 * r.n for r in cut)
    out = Q.judge(f, Q.cutoffs(f, labels))
    assert {r.doc_id for r in out.filter("not kept").collect()} == {i for i in range(0, 4000, 10) if i % 50 != 7}


def test_edges(spark):
    docs, labels = documents(spark, EDGE), labelled(spark, 1)[1]
    odd = clashing(docs).withColumns({"stratum": F.lit("s"), "n_words": F.lit("x"), "base_failed": F.lit("x"), "a.b": F.lit(1)})
    f = Q.with_features(odd)
    out = Q.judge(f, Q.cutoffs(f, labels))
    assert sorted(out.columns) == sorted({*odd.columns, *Q.FEATURES, "base_failed", "kept"})
    out = out.collect()
    assert len(out) == len(EDGE) and all(r["a.b"] == 1 and r.stratum == "s" for r in out)
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (1, 2, 3))
    empty = Q.with_features(documents(spark, []))
    assert Q.judge(empty, Q.cutoffs(empty, labels)).count() == 0


def test_no_python_in_the_plan(spark):
    df = E.queries()["op4_risk_controlled_rules"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op4_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    ok, msg = compare(E.queries()["op4_risk_controlled_rules"](spark, sf), ORACLE["op4_risk_controlled_rules"], duck(sf))
    assert ok, msg
