"""Language identification by cross-parsing against suffix automata.

``sample_languages`` draws a bounded sample of labelled text per language, ``Automata`` turns each
sample into a suffix automaton, and ``identify`` cross-parses every whole text with each of them: from the start
of a phrase the automaton follows the text for as long as what it has read occurs in the language's sample (the
longest match), then the next phrase begins. With ``c`` phrases against a sample of ``n`` symbols, ``c * log2(n + 1)``
bits describe the text; divided by the text's symbols this is its cross-parsing entropy, and the language with the
smallest one wins. The logarithm is the normalisation: a shorter sample has shorter matches, but cheaper ones.

Symbols are the UTF-8 bytes of the lower-cased text; everything in ASCII that is not a letter counts as a
space, and runs of spaces as one. Bytes that a sample never holds are phrases of their own.

The sample is bounded by ``sample_bytes`` a language and ``total_bytes`` over all languages (split evenly beyond
that). It is cut as pieces of ``piece_chars`` characters picked by hash from anywhere in the labelled texts, so a long
document or a language with a third of all rows only has a smaller share of its pieces taken. Texts to be
judged are never cut: a task steps through all texts of a batch side by side, and finishes the
longest ones alone.

Null and letterless texts are ``und`` with score 0, and so is everything if nothing was learnt. Ties go to the
language that sorts first. Repeated rows are judged one by one; rows without a language, or with a null one, are not
learnt from. An empty table gives an empty result. Only the named columns are read; ``keep`` names those to pass on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import land, rows_by_bytes

UNDETERMINED = "und"
SPACE = 0x20


def _classes() -> np.ndarray:
    """Byte -> symbol: ASCII letters and bytes of other letters stay, the rest of ASCII is a space."""
    out = np.arange(256, dtype=np.uint8)
    ascii_bytes = np.arange(128)
    out[:128][~((ascii_bytes >= ord("a")) & (ascii_bytes <= ord("z")))] = SPACE
    return out


CLASSES = _classes()


def symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of concatenated texts and each text's number of symbols; a text begins with no space."""
    s = CLASSES[data]
    before = np.empty_like(s)
    before[1:] = s[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    before[starts[starts < len(s)]] = SPACE
    keep = (s != SPACE) | (before != SPACE)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], upto[ends] - upto[starts]


def sample_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample_bytes: int = 32 << 10, total_bytes: int = 1 << 20, piece_chars: int = 512, name: str = "languages",
) -> dict[str, bytes]:
    """Per language about ``sample_bytes`` of its texts, as pieces from anywhere in them."""
    src = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.length(text).alias("n"))
    src = src.filter(F.col("lang").isNotNull() & (F.col("n") > 0))
    sizes = src.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = land(sizes, f"{name}-sizes")  # one row a language
    each = F.least(F.lit(sample_bytes), F.floor(F.lit(total_bytes) / F.greatest(F.count("*").over(Window.partitionBy(F.lit(1))), F.lit(1))))
    share = sizes.select("lang", each.alias("each"), F.least(F.lit(1.0), 1.5 * each / F.col("bytes")).alias("share"))
    # Numbers of the pieces to take: each piece has its own hash, the same on every run.
    numbers = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece_chars).cast("int"))
    luck = lambda i: F.pmod(F.xxhash64(F.col("key"), i), F.lit(1 << 30))
    chosen = src.join(share, "lang").withColumn("pieces", F.filter(numbers, lambda i: luck(i) < F.col("share") * (1 << 30)))
    pieces = chosen.filter(F.size("pieces") > 0).select("lang", "each", "key", "text", F.explode("pieces").alias("i"))
    pieces = pieces.select("lang", "each", luck(F.col("i")).alias("luck"), F.lower(F.substring("text", F.col("i") * piece_chars + 1, F.lit(piece_chars))).alias("piece"))
    pieces = pieces.filter(F.col("piece").rlike(r"\p{L}")).distinct()
    # About 1.5 times the bound was drawn; a running size per language cuts the rest.
    order = Window.partitionBy("lang").orderBy("luck", "piece").rowsBetween(Window.unboundedPreceding, 0)
    kept = pieces.withColumn("upto", F.sum(F.octet_length("piece")).over(order)).filter(F.col("upto") - F.octet_length("piece") < F.col("each"))
    rows = kept.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("piece")), "\n").alias("text")).collect()
    return {r.lang: r.text.encode() for r in sorted(rows, key=lambda r: r.lang)}


class Automata:
    """One step table for the suffix automata of all languages.

    Entry ``root + state * width + symbol`` holds four times the place of the next state plus the phrases that end with this
    step: none while the match goes on, one if the symbol starts the next phrase, and one more for a symbol that the sample
    lacks, which leads back to the root. So a text is read with one look-up a symbol and language.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        parts = {k: symbols(np.frombuffer(v, np.uint8), np.array([len(v)]))[0] for k, v in samples.items()}
        seen = np.unique(np.concatenate([*parts.values(), np.empty(0, np.uint8)]))
        self.width = len(seen) + 1  # the last one: any symbol that no sample holds
        self.code = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.int16)
        self.code[seen] = np.arange(len(seen))
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            table = _step_table(self.code[parts[lang]].tolist(), self.width, base)
            self.roots.append(base)
            tables.append(table)
            base += len(table)
        self.roots = np.array(self.roots, np.int64)
        self.table = np.concatenate([*tables, np.empty(0, np.int64)]).astype(np.int32 if base < 1 << 28 else np.int64)
        self.bits = np.array([np.log2(len(parts[k]) + 1) for k in self.langs])

    def phrases(self, codes: np.ndarray, sizes: np.ndarray, alone: int = 24, block: int = 512) -> np.ndarray:
        """Phrases of each text (row) against each language (column).

        Texts run side by side, longest first; those left when fewer than ``alone`` are still running go on one by one.
        """
        n, k = len(sizes), len(self.langs)
        order = np.argsort(-sizes, kind="stable")
        long = sizes[order]
        at = (np.cumsum(sizes) - sizes)[order]
        state = np.repeat(self.roots[:, None], n, 1)
        count = np.zeros((k, n), np.int64)
        pos = 0
        while (running := int(np.searchsorted(-long, -pos, side="left"))) >= alone:  # texts with a symbol at ``pos``
            step = int(min(block, long[running - 1] - pos))
            now = codes[at[:running, None] + (pos + np.arange(step))].T.astype(np.int64, order="C")
            s, c = np.ascontiguousarray(state[:, :running]), np.zeros((k, running), np.int32)
            v, ended = np.empty(s.shape, self.table.dtype), np.empty(s.shape, self.table.dtype)
            for row in now:
                s += row
                np.take(self.table, s, out=v, mode="clip")
                np.bitwise_and(v, 3, out=ended)
                c += ended
                np.right_shift(v, 2, out=s)
            state[:, :running] = s
            count[:, :running] += c
            pos += step
        look = memoryview(self.table)
        for t in range(running):
            rest = codes[at[t] + pos : at[t] + long[t]].tolist()
            for g in range(k):
                s, c = int(state[g, t]), 0
                for x in rest:
                    v = look[s + x]
                    c += v & 3
                    s = v >> 2
                state[g, t] = s
                count[g, t] += c
        out = np.empty((n, k), np.int64)
        out[order] = (count + (state != self.roots[:, None])).T  # the phrase that the text ends in
        return out


def _step_table(codes: list[int], width: int, base: int) -> np.ndarray:
    """The suffix automaton of a text as a flat table (see ``Automata``)."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for x in codes:
        now = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and x not in go[p]:
            go[p][x] = now
            p = link[p]
        if p >= 0:
            q = go[p][x]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(x) == q:
                    go[p][x] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    known = np.zeros(width, bool)
    known[list(go[0])] = True
    after = np.zeros(width, np.int64)
    after[list(go[0])] = list(go[0].values())
    table = np.tile(4 * (base + after * width) + np.where(known, 1, 2), (len(go), 1))
    table[0] = 4 * base + 1
    rows = np.repeat(np.arange(len(go)), [len(t) for t in go])
    cols = np.array([x for t in go for x in t], np.int64)
    table[rows, cols] = 4 * (base + np.array([q for t in go for q in t.values()], np.int64) * width)
    return table.ravel()


@functools.lru_cache(maxsize=2)
def automata(samples: tuple[tuple[str, bytes], ...]) -> Automata:
    """The automata of these samples, built once a worker process."""
    return Automata(dict(samples))


def judge_batch(model: Automata, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Winner (its place among ``langs``) and score of each text; texts without symbols have no meaning here."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    s, sizes = symbols(data, ends[1:] - ends[0])
    cost = model.phrases(model.code[s], sizes) * model.bits
    rows = np.arange(len(sizes))
    best = cost.argmin(1)
    least = cost[rows, best]
    if len(model.langs) == 1:
        return best, np.ones(len(sizes))
    cost[rows, best] = np.inf
    second = cost.min(1)
    return best, np.divide(second, least + second, out=np.zeros(len(sizes)), where=least + second > 0)


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text", keep: list[str] = ("doc_id",), batch_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (the runner-up's share of the two smallest entropies: 0.5 is a tie)."""
    own = [f"__{i}" for i in range(len(keep))]  # names with dots do not reach Python
    src = docs.select(*(docs[f"`{c}`"].alias(o) for c, o in zip(keep, own, strict=True)), docs[f"`{text}`"].alias("__text"))
    src = src.withColumn("__letters", F.coalesce(F.col("__text").rlike(r"\p{L}"), F.lit(False)))
    schema = src.select(*own, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for part in rows_by_bytes(batch, "__text", batch_bytes):
                model = model or automata(tuple(samples.items()))
                letters = part.column("__letters").to_numpy(zero_copy_only=False)
                if model.langs:
                    best, score = judge_batch(model, part.column("__text"))
                    names = pa.array(model.langs, pa.string()).take(pa.array(best))
                    names = pc.if_else(pa.array(letters), names, UNDETERMINED)
                    score = np.where(letters, score, 0.0)
                else:
                    names, score = pa.array([UNDETERMINED] * part.num_rows), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(o) for o in own), names, pa.array(score)], names=schema.names)

    return src.mapInArrow(judge, schema).toDF(*keep, "lang_pred", "score")
