"""Ranked lexical search over a length-stratified index.

A document's score for a query sums, over the query's distinct terms, ``w * ((10^9 * tf) div (1000 * tf + 8 * m))``: ``w``
falls with the number of documents that hold the term, ``m`` is the document's length normaliser (100 for the mean length).

``build_index`` groups documents by equal ``m``: a segment of the index holds whole strata, or a part of one that is larger
than a segment. Inside a segment documents are numbered in the order of their strata, and a term's postings are
runs of documents with equal ``m`` and equal ``tf``, in falling order of ``tf`` in each stratum. So everything that
depends on lengths is one number a stratum, and a term's impact is computed once for each (stratum, tf).

``search`` takes the queries in blocks of bounded bytes. The postings of a block's terms are dealt out by segment.
For every query a task bounds each stratum by the sum of its terms' largest impacts, visits strata in falling order of
these bounds, and stops at the first bound below the score of the worst of the query's best documents so far; that score
is carried from segment to segment. Each task returns its best documents for each query, and the best of these are the result.

A segment holds about ``segment_bytes`` of text (one document at least), so a term of all documents, or a length that a third
of all rows share, is spread over many. Strata of long documents, which hold few each, share segments.

Null texts and texts without terms are in no stratum and count nowhere; queries without terms have no result. Repeated rows are
documents of their own, and equal scores rank by doc_id, nulls first. Query rows with equal ids are one query with the terms of all of them. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import groups_for, land

TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Scale and slope of the score (fixed values of the formula).
ONE, TF_SCALE, M_SCALE, M_BASE, M_SLOPE = 1_000_000_000, 1000, 8, 10, 90

INDEX = "segment long, term binary, m array<long>, tf array<int>, docs array<int>, doc_ids array<long>"
ARROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.binary()), ("m", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())),
    ("docs", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
])


def term_edges(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in concatenated texts; no term runs from one text into the next."""
    inside = TERM_BYTES[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[[0, -1]] = inside[[0, -1]] if len(data) else False
    cuts = ends[(ends > 0) & (ends < len(data))]
    joined = cuts[inside[cuts - 1] & inside[cuts]]  # a term ends and another one starts here
    starts = np.flatnonzero(edge[:-1] & inside)
    stops = np.flatnonzero(edge[1:] & inside) + 1
    if len(joined):
        joined = np.unique(joined)
        starts, stops = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([stops, joined]))
    return starts, stops


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the end of each text."""
    raw = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def term_counts(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text."""
    data, ends = _bytes(texts)
    starts, _ = term_edges(data, ends)
    upto = np.searchsorted(starts, ends)
    return np.diff(np.concatenate([[0], upto]))


def _with_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, n) of documents that have terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = term_counts(batch.column("text"))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64())], names=["doc_id", "text", "n"])
            yield out.filter(pa.array(n > 0))

    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(count, "doc_id long, text string, n long")


def normaliser(n: Column, n_docs: int, n_terms: int) -> Column:
    """100 for a document of mean length, 10 more or less for each ninth of it (exact at any size)."""
    wide = lambda x: x.cast("decimal(19,0)")
    return M_BASE + F.call_function("div", M_SLOPE * wide(n) * wide(F.lit(n_docs)), wide(F.lit(n_terms)))


class _Segment:
    """Writes the index rows of one segment."""

    def __init__(self, segment: int, doc_ids: pa.Array, texts: pa.Array, m: np.ndarray):
        order = np.argsort(m, kind="stable")
        take = pa.array(order)
        self.segment, self.doc_ids, self.m = segment, doc_ids.take(take), m[order].astype(np.int64)
        data, ends = _bytes(texts.take(take))
        starts, stops = term_edges(data, ends)
        doc = np.searchsorted(ends, starts, side="right")
        low = LOWER[data].tobytes()
        words = pa.array([low[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()).dictionary_encode()
        self.terms = words.dictionary
        ids = words.indices.to_numpy().astype(np.int64)
        # Postings in (term, document) order with their tf, then by falling tf in each stratum.
        n = len(self.m)
        pairs = np.sort(ids * n + doc)
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        self.tf = np.diff(np.append(first, len(pairs))).astype(np.int32)
        term, self.docs = np.divmod(pairs[first], n)
        order = np.lexsort((-self.tf, self.m[self.docs], term))
        self.docs, self.tf = self.docs[order].astype(np.int32), self.tf[order]
        self.cuts = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def rows(self, step: int = 50_000) -> Iterator[pa.RecordBatch]:
        """One row for the documents (no term), then a row for each term."""

        def batch(rows: int, **cols) -> pa.RecordBatch:
            cols = {"segment": pa.array(np.full(rows, self.segment)), **cols}
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(rows, f.type) for f in ARROW], schema=ARROW)

        ids = pa.ListArray.from_arrays(pa.array([0, len(self.doc_ids)], pa.int32()), self.doc_ids)
        yield batch(1, m=pa.array([self.m], pa.list_(pa.int64())), doc_ids=ids)
        for lo in range(0, len(self.terms), step):
            hi = min(lo + step, len(self.terms))
            a, b = self.cuts[lo], self.cuts[hi]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(self.cuts[lo : hi + 1] - a, pa.int32()), pa.array(x[a:b]))  # noqa: B023, E731
            yield batch(hi - lo, term=self.terms[lo:hi], tf=lists(self.tf), docs=lists(self.docs))


class Index:
    """A written index: its rows, the number of documents with terms and the number of their terms."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def strata_places(docs: DataFrame, segment_bytes: int) -> DataFrame:
    """For each group of strata its first segment and the number of segments that share it.

    Strata below 1024 are groups of their own; above, a group holds those that agree in their ten leading bits, which bounds the
    groups by some 13,000 whatever the lengths.
    """
    sizes = docs.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(F.lit(1)).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return land(sizes.select(
        "grp", F.floor(before / segment_bytes).alias("first"),
        F.greatest(F.lit(1), F.ceil(F.col("bytes") / segment_bytes)).alias("parts"),
    ), "strata")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = 8 << 20) -> Index:
    """The written index of all ``docs`` that have terms."""
    counted = _with_counts(docs, key, text)
    total = counted.agg(F.count("*").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_docs, n_terms = total["d"], total["t"]
    m = normaliser(F.col("n"), n_docs, max(n_terms, 1))
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.col("m") + 0.5)).cast("int") - 9)
    placed = counted.select("doc_id", "text", m.alias("m")).withColumn("grp", F.call_function("shiftleft", F.call_function("shiftright", F.col("m"), shift), shift))
    places = strata_places(placed, segment_bytes)
    # The row's place in its file, not its id: rows that repeat one id spread as well.
    dealt = placed.withColumn("row", F.monotonically_increasing_id()).join(places, "grp")
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("segment"), "m", "doc_id", "text")

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        texts = rows.column("text").cast(pa.large_string()).combine_chunks()
        segment = _Segment(key[0].as_py(), rows.column("doc_id").combine_chunks(), texts, rows.column("m").to_numpy())
        return pa.Table.from_batches(segment.rows(), ARROW)

    rows = dealt.groupBy("segment").applyInArrow(build, INDEX)
    return Index(land(rows, "strata-index", compression="zstd"), n_docs, n_terms)


def query_terms(text: str | None) -> set[bytes]:
    """Distinct terms of a text."""
    if not text:
        return set()
    data, ends = _bytes(pa.array([text]))
    low = LOWER[data].tobytes()
    return {low[a:b] for a, b in zip(*(x.tolist() for x in term_edges(data, ends)), strict=True)}


def weight(df: int, n_docs: int) -> int:
    """Weight of a term that ``df`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with this tf adds in a document with this normaliser, before its weight."""
    return ONE * tf // (TF_SCALE * tf + M_SCALE * m)


class Best:
    """The ``k`` best documents of one query: highest score, then smallest id (null before all)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, object)

    @property
    def least(self) -> int:
        """A document must score this to be among the best (with a smaller id if it only ties)."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        rows = sorted(zip([*self.scores.tolist(), *scores.tolist()], [*self.ids, *ids], strict=True), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        rows = rows[: self.k]
        self.scores, self.ids = np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]


class Postings:
    """One segment's postings of the block's terms as runs: (term, stratum, tf) and the documents of each run."""

    def __init__(self, m: np.ndarray, doc_ids: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], weights: dict[int, int]):
        self.ids = doc_ids
        values, self.stratum_of = np.unique(m, return_inverse=True)
        self.first = np.searchsorted(m, values)  # documents are numbered by stratum
        self.n = np.diff(np.append(self.first, len(m)))
        self.terms: dict[int, tuple[np.ndarray, ...]] = {}
        for t, (tf, docs) in postings.items():
            at = self.stratum_of[docs]
            start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (tf[1:] != tf[:-1])]))
            value = weights[t] * impact(tf[start].astype(np.int64), values[at[start]])  # once for each (stratum, tf)
            top = np.flatnonzero(np.concatenate([[True], at[start][1:] != at[start][:-1]]))  # the largest tf comes first
            spread = np.repeat(value, np.diff(np.append(start, len(docs))))
            self.terms[t] = docs, spread, at, at[start][top], value[top], np.append(start[top], len(docs))

    def search(self, terms: list[int], best: Best, singly: int = 4) -> int:
        """Add this segment's documents to ``best``; returns how many strata were visited.

        The ``singly`` strata with the highest bounds are visited one by one, then all that may still matter.
        """
        lists = [self.terms[t] for t in terms if t in self.terms]
        bound = np.zeros(len(self.n), np.int64)
        for _, _, _, strata, largest, _ in lists:
            bound[strata] += largest
        order = np.argsort(-bound, kind="stable")
        for i, g in enumerate(order[:singly].tolist()):
            if bound[g] < best.least:
                return i
            base, score = self.first[g], np.zeros(self.n[g], np.int64)
            for docs, value, _, strata, _, cuts in lists:
                j = np.searchsorted(strata, g)
                if j < len(strata) and strata[j] == g:
                    own = slice(cuts[j], cuts[j + 1])
                    score[docs[own] - base] += value[own]
            self._offer(score, base, best)
        rest = order[singly:]
        rest = rest[bound[rest] >= best.least]
        if len(rest):
            wanted = np.zeros(len(bound), bool)
            wanted[rest] = True
            score = np.zeros(len(self.ids), np.int64)
            for docs, value, at, _, _, _ in lists:
                own = wanted[at]
                score[docs[own]] += value[own]
            self._offer(score, 0, best)
        return min(singly, len(order)) + len(rest)

    def _offer(self, score: np.ndarray, base: int, best: Best) -> None:
        found = np.flatnonzero(score >= best.least)
        if len(found) > best.k:  # ties with the last one stay, ids decide
            found = found[score[found] >= np.partition(score[found], -best.k)[-best.k]]
        if len(found):
            best.add(score[found], [self.ids[base + i] for i in found.tolist()])


def _query_blocks(queries: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[dict[int | None, set[bytes]]]:
    """Terms of the queries by id, in blocks of about ``block_bytes`` of text; rows of one id are in one block."""
    src = queries.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text"))
    n = groups_for(src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"], block_bytes)
    for k in range(n):
        block: dict[int | None, set[bytes]] = {}
        for r in src.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator():
            block.setdefault(r.item, set()).update(query_terms(r.text))
        if any(block.values()):
            yield {item: terms for item, terms in block.items() if terms}


def _search_block(index: Index, block: dict[int | None, set[bytes]], k: int, tasks: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each query of the block."""
    rows = index.rows
    names = sorted(set().union(*block.values()))
    spark = rows.sparkSession
    number = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(names)], "term binary, t int"))  # at most the block's bytes
    held = rows.filter("term is not null").select("segment", "term", "tf", "docs").join(number, "term")
    matched = land(held.select("segment", "t", "tf", "docs"), "matched")
    df = {r.t: r.df for r in matched.groupBy("t").agg(F.sum(F.size("docs")).alias("df")).collect()}
    weights = {t: weight(n, index.n_docs) for t, n in df.items()}
    place = {w: i for i, w in enumerate(names)}
    items = [(item, sorted(place[w] for w in terms if place[w] in df)) for item, terms in block.items()]
    heads = rows.filter("term is null").select("segment", F.lit(-1).alias("t"), "m", "doc_ids", F.lit(None).cast("array<int>").alias("tf"), F.lit(None).cast("array<int>").alias("docs"))
    heads = heads.join(matched.select("segment").distinct(), "segment", "left_semi")
    mixed = heads.unionByName(matched.withColumns({"m": F.lit(None).cast("array<long>"), "doc_ids": F.lit(None).cast("array<long>")}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        now, head, postings = None, None, {}

        def finish() -> None:
            if head is not None and postings:
                segment = Postings(*head, postings, weights)
                for (_, terms), b in zip(items, best, strict=True):
                    segment.search(terms, b)

        for batch in batches:
            segments, ts = batch.column("segment").to_pylist(), batch.column("t").to_pylist()
            cols = {c: batch.column(c) for c in ("m", "doc_ids", "tf", "docs")}
            for i, (s, t) in enumerate(zip(segments, ts, strict=True)):
                if s != now:
                    finish()
                    now, head, postings = s, None, {}
                if t < 0:
                    head = cols["m"][i].values.to_numpy(), cols["doc_ids"][i].values.to_pylist()
                else:
                    postings[t] = cols["tf"][i].values.to_numpy(), cols["docs"][i].values.to_numpy()
        finish()
        out = [(item, d, s) for (item, _), b in zip(items, best, strict=True) for s, d in zip(b.scores.tolist(), b.ids, strict=True)]
        cols = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    return mixed.repartition(tasks, "segment").sortWithinPartitions("segment", "t").mapInArrow(find, "item_id long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of each query's ``k`` best documents."""
    spark = index.rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism  # few: each one's worst best score spares later strata
    found = None
    for block in _query_blocks(queries, key, text, block_bytes):
        part = land(_search_block(index, block, k, tasks), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
