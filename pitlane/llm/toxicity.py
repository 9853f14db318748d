"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word (runs without ASCII white space, A-Z lowered) are an embedding of the whole word and the mean embedding of
its byte trigrams, both hashed into fixed tables. Two gated recurrent layers read a window of ``WINDOW``
words forwards and backwards, attention weighs the positions, and a logistic unit scores the pooled state. Windows start every
``STRIDE`` words and cover the whole text; a document's score is its highest window's, shifted so that 0.5
separates the training documents best.

Training runs on at most ``max_rows`` labelled documents of each class (a documented bound; those with the least
hash of their doc_id), by back-propagation through time and Adam: first every window has its document's label, then only
the highest windows do (the one window that makes a document toxic, and the most suspicious ones of a clean one).
The weights, a fixed number of bytes, go to the executors, which score every document.

Null and empty texts have one empty window. Without labels of both classes the score is the share of toxic labels (0 without
labels). Null labels are ignored, and a document labelled more than once is toxic if any label says so. Repeated rows
are scored alike; null doc_ids are never training rows and count as not held out. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import rows_by_bytes, word_blocks

WINDOW, STRIDE = 32, 16
HIDDEN, SIZE = 12, 12  # units of each direction; size of each embedding
WORDS, TRIGRAMS = 8192, 4096  # hashed table sizes
BATCH = 4096  # windows scored at once
FALSE_ALARM = 2.0  # what calling a clean document toxic costs, against missing a toxic one
Weights = dict[str, np.ndarray]


def initial(seed: int = 5) -> Weights:
    rng = np.random.default_rng(seed)
    glorot = lambda a, b: (rng.standard_normal((a, b)) * (2 / (a + b)) ** 0.5).astype(np.float32)
    w = {"word": (rng.standard_normal((WORDS, SIZE)) * 0.1).astype(np.float32), "gram": (rng.standard_normal((TRIGRAMS, SIZE)) * 0.1).astype(np.float32)}
    for d in ("f", "b"):
        w |= {f"W{d}": glorot(2 * SIZE, 3 * HIDDEN), f"U{d}": glorot(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return w | {"A": glorot(2 * HIDDEN, HIDDEN), "v": glorot(HIDDEN, 1)[:, 0], "o": glorot(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}


class Inputs:
    """Hashed input numbers of distinct words."""

    def __init__(self, words: list[bytes]):
        self.word = np.fromiter((xxhash.xxh32_intdigest(w) % WORDS for w in words), np.int64, len(words))
        flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        grams = flat[:-2] << np.uint32(16) | flat[1:-1] << np.uint32(8) | flat[2:] if len(flat) else flat
        ends = np.cumsum(length)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = inside[ends - 2] = False  # trigrams stay inside their word
        self.gram = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)[inside[:-2]] if len(flat) else np.empty(0, np.int64)
        self.count = length - 2
        self.first = np.cumsum(self.count) - self.count

    def vectors(self, w: Weights) -> np.ndarray:
        if not len(self.word):
            return np.empty((0, 2 * SIZE), np.float32)
        grams = np.add.reduceat(w["gram"][self.gram], self.first, axis=0) / self.count[:, None].astype(np.float32)
        return np.concatenate([w["word"][self.word], grams], axis=1)


def windows_of(n: int) -> np.ndarray:
    """First words of a text's windows: overlapping, and together the whole text."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def window_matrix(ids: np.ndarray) -> np.ndarray:
    """The text's word numbers by window, -1 past the end."""
    at = windows_of(len(ids))[:, None] + np.arange(WINDOW)
    return np.where(at < len(ids), np.append(ids, -1)[np.minimum(at, len(ids))], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(gates: np.ndarray, live: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction; ``gates`` (time, batch, 3 * HIDDEN) hold the inputs' share."""
    h, states = np.zeros((gates.shape[1], HIDDEN), np.float32), np.empty((*gates.shape[:2], HIDDEN), np.float32)
    for t in range(len(gates)):
        a = h @ U
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = np.where(live[t][:, None], n + z * (h - n), h)
        if keep is not None:
            keep.append((h, z, r, n, a[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states


def forward(w: Weights, vectors: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows of word numbers (batch, WINDOW), -1 where there is no word."""
    ids = ids.T
    live, at = ids >= 0, np.maximum(ids, 0)
    if not len(vectors):
        return np.full(ids.shape[1], w["bias"][0])
    states, caches = [], []
    for d in ("f", "b"):
        gates = (vectors @ w[f"W{d}"] + w[f"c{d}"])[at if d == "f" else at[::-1]]
        cache = [] if keep is not None else None
        s = _run(gates, live if d == "f" else live[::-1], w[f"U{d}"], cache)
        states.append(s if d == "f" else s[::-1])
        caches.append(cache)
    h = np.concatenate(states, axis=2)
    a = np.tanh(h @ w["A"])
    e = np.where(live, a @ w["v"], -1e9)
    e = np.exp(e - e.max(axis=0))
    share = np.where(live, e / e.sum(axis=0), 0).astype(np.float32)
    pooled = (share[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep |= {"live": live, "at": at, "h": h, "a": a, "share": share, "pooled": pooled, "caches": caches}
    return pooled @ w["o"] + w["bias"][0]


def backward(w: Weights, inputs: Inputs, vectors: np.ndarray, out_words: np.ndarray, k: dict, dlogit: np.ndarray) -> Weights:
    """Gradients of all weights; ``out_words`` marks words whose own embedding was left out."""
    g: Weights = {"o": k["pooled"].T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * w["o"]
    dshare = (k["h"] * dpooled).sum(axis=2)
    dh = k["share"][:, :, None] * dpooled
    de = k["share"] * (dshare - (k["share"] * dshare).sum(axis=0))
    da = de[:, :, None] * w["v"] * (1 - k["a"] ** 2)
    g["v"] = np.einsum("tb,tbj->j", de, k["a"])
    g["A"] = np.einsum("tbi,tbj->ij", k["h"], da)
    dh = dh + da @ w["A"].T
    dvectors = np.zeros_like(vectors)
    for d, cache, part in (("f", k["caches"][0], slice(0, HIDDEN)), ("b", k["caches"][1], slice(HIDDEN, None))):
        step = 1 if d == "f" else -1
        out, live, at, U = dh[::step, :, part], k["live"][::step], k["at"][::step], w[f"U{d}"]
        dgates, dU, carry = np.zeros((*at.shape, 3 * HIDDEN), np.float32), np.zeros_like(U), np.zeros(out.shape[1:], np.float32)
        for t in range(len(at) - 1, -1, -1):
            h, z, r, n, an = cache[t]
            total = out[t] + carry
            on = live[t][:, None]
            own = np.where(on, total, 0)
            dn = own * (1 - z) * (1 - n * n)
            dz = own * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dgates[t] = np.concatenate([dz, dr, dn], axis=1)
            through = np.concatenate([dz, dr, dn * r], axis=1)
            dU += h.T @ through
            carry = through @ U.T + own * z + np.where(on, 0, total)
        g[f"U{d}"] = dU
        flat, where = dgates.reshape(-1, 3 * HIDDEN), at.reshape(-1)
        by_word = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        np.add.at(by_word, where, flat)
        g[f"W{d}"], g[f"c{d}"] = vectors.T @ by_word, by_word.sum(axis=0)
        dvectors += by_word @ w[f"W{d}"].T
    g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
    np.add.at(g["word"], inputs.word[~out_words], dvectors[~out_words, :SIZE])
    np.add.at(g["gram"], inputs.gram, np.repeat(dvectors[:, SIZE:] / inputs.count[:, None].astype(np.float32), inputs.count, axis=0))
    return g


def tokens(text: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers of distinct words."""
    parts = [np.fromiter((number.setdefault(x, len(number)) for x in block), np.int64, len(block)) for block in word_blocks((text or b"").lower())]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def document_logits(w: Weights, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every document's highest window logit, and all its window logits."""
    number: dict[bytes, int] = {}
    ids = [tokens(t, number) for t in texts]
    vectors = Inputs(list(number)).vectors(w)
    sizes = [len(windows_of(len(x))) for x in ids]
    logits, waiting, rows = [], [], 0
    for x in ids:
        m = window_matrix(x)
        for lo in range(0, len(m), BATCH):
            waiting.append(m[lo : lo + BATCH])
            rows += len(waiting[-1])
            if rows >= BATCH:
                logits.append(forward(w, vectors, np.concatenate(waiting)))
                waiting, rows = [], 0
    if waiting:
        logits.append(forward(w, vectors, np.concatenate(waiting)))
    parts = np.split(np.concatenate(logits), np.cumsum(sizes)[:-1]) if texts else []
    return np.array([p.max() for p in parts]), parts


def train(rows: list[tuple[bytes, int]], seed: int = 5, epochs: tuple[int, int] = (3, 5), batch: int = 256, rate: float = 0.01, per_document: int = 24, drop: float = 0.3, spare: int = 5) -> tuple[Weights, float]:
    """Weights, and the logit that separates the classes best, from (text, 0 or 1) rows of both classes.

    Every ``spare``-th row of a class is kept from the weights and sets the logit. ``drop`` is the share of words
    whose own embedding a step leaves out, so that their trigrams must do.
    """
    rng, w = np.random.default_rng(seed), initial(seed)
    rows = sorted(rows, key=lambda r: r[1])
    aside = [r for k in (0, 1) for r in [x for x in rows if x[1] == k][spare - 1 :: spare]]
    rows = [r for k in (0, 1) for i, r in enumerate(x for x in rows if x[1] == k) if i % spare != spare - 1]
    if len({y for _, y in aside}) < 2:
        aside = rows
    moment, power = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps = 0
    number: dict[bytes, int] = {}
    matrices = [window_matrix(tokens(t, number)) for t, _ in rows]
    words = list(number)
    label = np.array([y for _, y in rows])

    def update(ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        nonlocal steps
        used = np.unique(ids[ids >= 0])
        inputs = Inputs([words[i] for i in used.tolist()])
        vectors, keep = inputs.vectors(w), {}
        if not len(vectors):
            return
        out = rng.random(len(vectors)) < drop
        vectors[out, :SIZE] = 0
        logit = forward(w, vectors, np.where(ids >= 0, np.searchsorted(used, ids), -1), keep)
        grads = backward(w, inputs, vectors, out, keep, ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32))
        steps += 1
        for k, d in grads.items():
            moment[k] += 0.1 * (d - moment[k])
            power[k] += 0.001 * (d * d - power[k])
            w[k] -= (rate * (moment[k] / (1 - 0.9**steps)) / (np.sqrt(power[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)

    def epoch(ids: np.ndarray, y: np.ndarray) -> None:
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            mine = order[lo : lo + batch]
            update(ids[mine], y[mine], weight[mine])

    for _ in range(epochs[0]):  # windows of every document under its label
        picked = [m[rng.permutation(len(m))[:per_document]] for m in matrices]
        epoch(np.concatenate(picked), np.repeat(label, list(map(len, picked))))
    for _ in range(epochs[1]):  # the highest windows only
        picked, y = [], []
        logits = document_logits(w, [t for t, _ in rows])[1]
        for m, s, k in zip(matrices, logits, label.tolist(), strict=True):
            top = np.argsort(-s, kind="stable")[: 2 if k else 6]
            picked.append(m[top])
            y += [k] * len(top)
        epoch(np.concatenate(picked), np.array(y))
    best, label = document_logits(w, [t for t, _ in aside])[0], np.array([y for _, y in aside])
    order = np.argsort(best)
    # errors if everything after the i-th document is called toxic
    missed = np.concatenate([[0], np.cumsum(label[order])])
    spared = np.concatenate([[0], np.cumsum(1 - label[order])])
    errors = missed / missed[-1] + FALSE_ALARM * (1 - spared / spared[-1])
    values = np.concatenate([[best[order][0] - 1], best[order], [best[order][-1] + 1]])
    places = np.flatnonzero(errors == errors.min())
    i = int(places[len(places) // 2])
    return w, float((values[i] + values[i + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, held: Column, max_rows: int) -> list[tuple[bytes, int]]:
    """At most ``max_rows`` labelled documents of each class, in the order of their doc_id's hash.

    The ids are picked without the texts; only the picked ones' texts are read, one for an id that several rows have.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.filter(~held).select("doc_id").distinct().join(marks, "doc_id")
    picked = None
    for k in (0, 1):
        some = known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = some if picked is None else picked.union(some)
    # at most 2 * max_rows ids
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text")).collect()
    return [(bytes(r["text"]), r["toxic"]) for r in sorted(rows, key=lambda r: (r["toxic"], r["doc_id"]))]


def held_out(divisor: int = 5, remainder: int = 0) -> Column:
    """The documents whose labels are not learnt from, by the crc32 of the doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, held: Column | None = None, max_rows: int = 1200, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (0 or 1) of every document."""
    held = held_out() if held is None else held
    rows = training_rows(docs, labels, held, max_rows)
    both = len({y for _, y in rows}) == 2
    share = sum(y for _, y in rows) / max(1, len(rows))
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, seed) if both else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_by_bytes(batch, "text", 2 << 20):
                if sent.value is None:
                    score = np.full(part.num_rows, share)
                else:
                    weights, middle = sent.value
                    score = _sigmoid(document_logits(weights, part.column("text").to_pylist())[0].astype(float) - middle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held.alias("held_out"))
    scored = src.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
