"""Preference pairs against plain Python."""

from __future__ import annotations

import pytest
from oracle_compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as E
from pitlane.llm import preference as P
from pitlane.llm.queries import ORACLE

SCHEMA = "pair_id long, turn long, role string, text string"
LONG = "long " * 50_000
A = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "é"), (1, 3, "assistant", "good"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, None, "system", None), (3, 0, "user", "q"), (3, 0, "user", "q"),
    (4, 0, "user", "only chosen"), (None, 0, "user", "nobody"), (6, 0, None, ""), (7, 0, "user", LONG), (7, 1, "assistant", "x"),
]
B = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "é"), (1, 3, "assistant", "bad"), (1, 4, "user", "more"), (1, 5, "assistant", "end"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, None, "system", ""), (3, 0, "user", "r"),
    (5, 0, "user", "only rejected"), (6, 0, None, ""), (6, 1, "assistant", None), (7, 0, "user", LONG), (7, 1, "assistant", "y"),
]


def plain(rows, pair):
    seen = sorted({(t is not None, t or 0, r or "", x or "") for p, t, r, x in rows if p == pair})
    turns = {}
    for has, t, r, x in seen:
        turns.setdefault((has, t), []).append((r, x))
    return turns


def rendered(turns):
    text, spans = "", []
    for r, x in turns:
        head = f"<|im_start|>{r}\n"
        if r == "assistant":
            spans.append((len(text) + len(head), len(text) + len(head) + len(x) + len("<|im_end|>\n")))
        text += head + x + "<|im_end|>\n"
    return text, spans


def test_pairs_against_plain_python(spark):
    extra = lambda df: df.select("*", F.lit("x").alias("side"), F.lit("y").alias("turns"))
    got = {r.pair_id: r for r in P.format_pairs(extra(spark.createDataFrame(A, SCHEMA)), extra(spark.createDataFrame(B, SCHEMA))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for pair, row in got.items():
        a, b = plain(A, pair), plain(B, pair)
        keys = sorted({*a, *b})
        n = next((i for i, k in enumerate(keys) if a.get(k) != b.get(k)), len(keys))
        flat = lambda side, ks: [t for k in ks for t in side.get(k, [])]
        assert row.n_prompt_turns == n
        assert row.prompt == rendered(flat(a, keys[:n]))[0]
        for side, text, mask in ((a, row.chosen, row.chosen_mask), (b, row.rejected, row.rejected_mask)):
            want, spans = rendered(flat(side, keys[n:]))
            assert text == want and [(m.start, m.end) for m in mask] == spans


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.format_pairs(none, none).count() == 0
    assert P.format_pairs(*P.answers_of_next(none.withColumnRenamed("pair_id", "conv_id"))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op9_matches_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = E.queries()["op9_preference_pairs"](spark, sf)
    ok, msg = compare(df, ORACLE["op9_preference_pairs"], duck(sf))
    assert ok, msg
    assert df.filter("n_prompt_turns > 0 and chosen_loss_chars > 0").count() > 0
