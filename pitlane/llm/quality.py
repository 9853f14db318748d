"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Every rule is a measure of a document and a ladder of cutoffs, from lenient to strict: a document above the cutoff goes. The
ladders have equally many steps, and step ``j`` takes cutoff ``j`` of every rule at once, so what a step rejects, the next one
rejects as well. For a stratum with ``n`` good labelled holdout documents of which step ``j`` rejects ``k``, the exact binomial tail
``P(Bin(n, risk) <= k)`` is a p-value for "the rules together reject more than a share ``risk`` of good documents". Steps are tested
from the most lenient on while the p-value is at most ``delta / strata``: testing in a fixed order needs no correction
over steps and rules, and the Bonferroni division covers the strata. So with probability ``1 - delta`` at least, in every stratum, the
rules together reject no more than a share ``risk`` of good documents. Among the steps that pass, the one that rejects most bad less good
documents is taken; if none helps, or the holdout is too small to prove anything, the rules are off in that stratum.

Null text has no words. Null strata form a stratum of their own; strata without labels have no
active rule. Documents labelled more than once count as bad if any label says so; null labels are
ignored. Repeated rows are judged alike. Empty tables give no rows. Columns named as the counts, ``base_failed`` or ``kept`` are
replaced by them; all other columns pass through. Five-word windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import land

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SHINGLE = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
BROADCAST_STRATA = 10_000

STEPS = 50


def ladder(lenient: float, strict: float) -> tuple[float, ...]:
    """Cutoffs in equal steps, rounded so that every engine compares with the same numbers."""
    return tuple(round(lenient + (strict - lenient) * j / (STEPS - 1), 6) for j in range(STEPS))


#: The cutoffs of each rule, step by step: a document above the cutoff goes.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": tuple(round(3.0 * 0.91**j, 6) for j in range(STEPS)),
    "dup_line_share": ladder(0.98, 0.1),
    "repeat_share": ladder(0.2, 0.02),
    "same_word_share": ladder(0.98, 0.6),
    "mean_word_chars": ladder(30.0, 9.0),
    "short_words": ladder(-1.0, -3.0),
}


def with_features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus the counts of FEATURES, as a written table.

    It is written because later filters would otherwise be pushed into these expressions,
    which refer to each other many times.
    """
    keep = [f"`{c}`" for c in (docs.columns if keep is None else keep) if c not in FEATURES]
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    df = df.withColumns({"__w": F.filter(F.split(text, SPACES), lambda x: x != ""), "__l": lines, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    w = F.col("__w")
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        # one hash for each five-word window
        "__h": F.when(F.size(w) > SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))),
    }).drop("__w", "__l", "__text")
    # only documents with a repeated window sort their windows
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(repeated, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("__s")
    same = lambda j, k: F.get(s, j)["x"] == F.get(s, k)["x"]
    starts = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), F.get(s, j)["i"])), lambda x: x.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + SHINGLE - F.greatest(i, a["end"])).alias("n"), (i + SHINGLE).alias("end")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long")).select(*keep, *FEATURES)
    return land(df, "features")


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measure of each rule, from the features."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "same_word_share": 1 - F.col("n_distinct") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def most_rejections(n: Column, a: float, log_level: Column) -> Column:
    """Largest k with P(Bin(n, a) <= k) at most the level, -1 if none: the exact tail, summed in logarithms.

    The tail passes one half at the mean, so the sum ends there.
    """
    odds = math.log(a / (1 - a))

    def step(s: Column, i: Column) -> Column:
        term = F.when(i == 0, n * math.log1p(-a)).otherwise(s["term"] + F.log((n - i + 1) / i) + odds)
        top = F.greatest(term, s["tail"])
        tail = F.when(i == 0, term).otherwise(top + F.log(F.exp(term - top) + F.exp(s["tail"] - top)))
        return F.struct(term.alias("term"), tail.alias("tail"), F.when(tail <= log_level, i).otherwise(s["k"]).alias("k"))

    zero = F.struct(F.lit(0.0).alias("term"), F.lit(-1e300).alias("tail"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * a)), zero, step, lambda s: s["k"])


def step_of(ladders: dict[str, tuple[float, ...]]) -> Column:
    """The first step that rejects the document (STEPS if none does)."""

    def first(cuts: tuple[float, ...], value: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value <= c))

    return F.least(*(first(ladders[r], m) for r, m in measures().items()))


def cutoffs(featured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n, k, bad) of the strata with active rules, from labelled documents that pass the base rules.

    n: good labelled documents; k and bad: the good and bad ones that the chosen step rejects.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = featured.filter(~base_failed()).select("doc_id", F.col(f"`{stratum}`").alias("stratum"), step_of(LADDERS).alias("step")).join(marks, "doc_id")
    counts = held.groupBy("stratum", "step").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("k"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select("stratum", "step", F.sum("k").over(upto).alias("k"), F.sum("bad").over(upto).alias("bad"), F.sum("k").over(whole).alias("n"))
    strata = steps.select(F.coalesce(F.countDistinct(F.struct("stratum")), F.lit(0)).alias("s")).first()["s"]
    # k only grows with the steps, so a step passes if it and all before it do
    most = most_rejections(F.col("n"), risk, F.lit(math.log(delta / max(strata, 1))))
    limits = steps.select(F.col("stratum").alias("s"), "n").distinct().select("s", most.alias("most"))
    passed = steps.join(limits, F.col("stratum").eqNullSafe(F.col("s"))).filter((F.col("step") < STEPS) & (F.col("k") <= F.col("most")) & (F.col("bad") > F.col("k")))
    best = passed.groupBy("stratum").agg(F.max_by(F.struct("step", "k", "bad", "n"), F.struct(F.col("bad") - F.col("k"), -F.col("step"))).alias("b"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.array(*map(F.lit, c)).alias("cuts")) for r, c in LADDERS.items())))
    return best.select("stratum", "b", rules.alias("r")).select("stratum", "r.rule", F.get("r.cuts", F.col("b.step")).alias("cutoff"), "b.n", "b.k", "b.bad")


def judge(featured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """``featured`` plus base_failed and kept.

    The cutoffs are six rows a stratum; they are broadcast while the counted number of strata is small.
    """
    by = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    few = by.count() <= BROADCAST_STRATA
    joined = featured.join(F.broadcast(by) if few else by, F.col(f"`{stratum}`").eqNullSafe(F.col("__stratum")), "left")
    above = F.lit(False)
    for rule, m in measures().items():
        above = above | F.coalesce(m > F.col("__cut")[rule], F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~above}).drop("__cut", "__stratum")
