"""Benchmark decontamination with a positional inverted index.

``build_index`` cuts the training documents into segments and writes, for every segment, its
documents and its postings: one row per term with the sorted positions of all its occurrences.
Documents follow each other in a segment's positions with a gap of one, so no phrase runs
from one into the next. Queries fetch the postings of their own terms only and, per
segment, intersect lists: a phrase starts with the positions of its rarest term, shifted by the term's
offset in the phrase, and keeps those that are also in the shifted list of the next rarest
term, and so on. Term counts for "rarest" come from the whole index.

A segment holds about ``segment_words`` words (one document at least), which bounds a task, and a
term that is in every document is spread over all segments. Query texts are taken in blocks of bounded
bytes; each block is sent to the executors and run against the whole index.

Null texts and texts without words have no postings. Queries shorter than the window are one window;
queries without words match nothing. Repeated documents and queries are handled one by one; queries that
share an id count once. Queries with a null id mark words but are not listed. Empty tables give
no rows (no documents) or no hits (no queries). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import groups_for, land

#: Words of a text whose A-Z are lowered, as UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
INDEX = "segment long, doc_no int, doc_id long, base int, n_words int, term binary, n long, positions array<int>"
ARROW = pa.schema([
    ("segment", pa.int64()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("base", pa.int32()), ("n_words", pa.int32()),
    ("term", pa.binary()), ("n", pa.int64()), ("positions", pa.list_(pa.int32())),
])


def words(text: bytes | None, block: int = 4 << 20) -> Iterator[list[bytes]]:
    """Lists of words, a block of text at a time."""
    data, at = (text or b"").lower(), 0
    while at < len(data):
        m = BREAK.search(data, at + block)
        end = m.start() if m else len(data)
        yield WORD.findall(data, at, end)
        at = end


class _Segment:
    """Documents and word numbers gathered until a segment is full."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.end = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        terms, n = self.terms, 0
        for block in words(text):
            self.ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in block), np.int32, len(block)))
            n += len(block)
        self.docs.append((doc_id, self.end, n))
        self.end += n + 1

    def rows(self, segment: int, step: int = 20_000) -> Iterator[pa.RecordBatch]:
        """Document rows, then posting rows in term order."""

        def batch(rows: int, **cols) -> pa.RecordBatch:
            full = {"segment": pa.array(np.full(rows, segment)), **cols}
            return pa.RecordBatch.from_arrays([full[f.name] if f.name in full else pa.nulls(rows, f.type) for f in ARROW], schema=ARROW)

        ids, bases, counts = zip(*self.docs, strict=True)
        yield batch(len(ids), doc_no=pa.array(range(len(ids)), pa.int32()), doc_id=pa.array(ids, pa.int64()), base=pa.array(bases, pa.int32()), n_words=pa.array(counts, pa.int32()))
        if not self.terms:
            return
        names = sorted(self.terms)
        place = np.empty(len(names), np.int32)
        place[[self.terms[w] for w in names]] = np.arange(len(names))
        flat = place[np.concatenate(self.ids)]
        gaps = np.repeat(np.arange(len(counts)), counts)  # a gap before each document but the first
        positions = (np.arange(len(flat)) + gaps).astype(np.int32)[np.argsort(flat, kind="stable")]
        ends = np.cumsum(np.bincount(flat, minlength=len(names)))
        for lo in range(0, len(names), step):
            hi = min(lo + step, len(names))
            first = ends[lo - 1] if lo else 0
            cuts = np.concatenate([[first], ends[lo:hi]])
            lists = pa.ListArray.from_arrays(pa.array(cuts - first, pa.int32()), pa.array(positions[first : cuts[-1]]))
            yield batch(hi - lo, term=pa.array(names[lo:hi], pa.binary()), n=pa.array(np.diff(cuts)), positions=lists)


def build_index(docs: DataFrame, segment_words: int = 4_000_000) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): document rows and posting rows (``term`` not null)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, now = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                now.add(doc_id, texts[i].as_buffer().to_pybytes() if texts[i].is_valid else None)
                if now.end >= segment_words:
                    yield from now.rows(task << 32 | k)
                    k, now = k + 1, _Segment()
        if now.docs:
            yield from now.rows(task << 32 | k)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return land(src.mapInArrow(build, INDEX), "postings", compression="zstd")


class Phrases:
    """Distinct phrases of a block of queries, over the block's own vocabulary."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]], size: int | None):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        self.phrases: list[tuple[int, ...]] = []
        self.items: list[list[int]] = []
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for block in words(text) for w in block]
            n = min(size or len(ids), len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                key = tuple(ids[i : i + n])
                if key not in number:
                    number[key] = len(self.phrases)
                    self.phrases.append(key)
                    self.items.append([])
                if item is not None and item not in self.items[number[key]]:
                    self.items[number[key]].append(item)


def phrase_starts(phrase: tuple[int, ...], lists: dict[int, np.ndarray], counts: dict[int, int]) -> np.ndarray:
    """Positions at which the whole phrase occurs: shifted lists intersected from the rarest term on."""
    order = sorted(range(len(phrase)), key=lambda o: (counts.get(phrase[o], 0), phrase[o], o))
    starts = None
    for o in order:
        at = lists.get(phrase[o])
        if at is None:
            return np.empty(0, np.int32)
        if starts is None:
            starts = at - o
            continue
        i = np.searchsorted(at, starts + o)
        starts = starts[at[np.minimum(i, len(at) - 1)] == starts + o]
        if not len(starts):
            break
    return starts


def near_starts(terms: tuple[int, ...], lists: dict[int, np.ndarray], counts: dict[int, int], span: int, ends: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Positions of a query word from which ``span`` words of one document hold all the query's words."""
    order = sorted(set(terms), key=lambda t: (counts.get(t, 0), t))
    if not order or any(t not in lists for t in order):
        return np.empty(0, np.int32)
    starts = np.unique(np.concatenate([lists[t] for t in order]))
    limit = np.minimum(starts + span, ends[np.searchsorted(bases, starts, side="right") - 1])
    for t in order:
        at = lists[t]
        i = np.searchsorted(at, starts)
        keep = (i < len(at)) & (at[np.minimum(i, len(at) - 1)] < limit)
        starts, limit = starts[keep], limit[keep]
    return starts


def query_blocks(queries: DataFrame, key: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The queries in blocks of about ``block_bytes`` of text."""
    src = queries.select(F.col(key).cast("long").alias("item"), F.col("text").cast("binary").alias("text"))
    n = groups_for(src.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b")).first()["b"], block_bytes)
    for k in range(n):
        rows = src.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in rows]


def _against(index: DataFrame, block: Phrases, run: Callable, schema: str) -> DataFrame:
    """Run ``run(segment, lists, counts, documents)`` for every segment, on the postings of the block's words."""
    spark = index.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.array(list(block.vocabulary), pa.binary()), "number": pa.array(range(len(block.vocabulary)), pa.int32())}))
    asked = index.filter(F.col("term").isNotNull()).join(F.broadcast(terms), "term")
    found = asked.groupBy("number").agg(F.sum("n").alias("n")).collect()
    sent = spark.sparkContext.broadcast({r["number"]: r["n"] for r in found})
    documents = index.filter(F.col("term").isNull()).select("segment", "doc_no", "base", "n_words", F.lit(None).cast("int").alias("number"), F.lit(None).cast("array<int>").alias("positions"))
    lists = asked.select("segment", F.lit(None).cast("int").alias("doc_no"), F.lit(None).cast("int").alias("base"), F.lit(None).cast("int").alias("n_words"), "number", "positions")

    def segment(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = table.column("number").to_numpy()
        if table.num_rows == 0:
            return pa.Table.from_batches([], schema)
        is_doc = np.isnan(number.astype(float))
        docs = table.filter(pa.array(is_doc)).sort_by("doc_no")
        posts = table.filter(pa.array(~is_doc))
        column = posts.column("positions").combine_chunks()
        flat, at = (column.values.to_numpy(), column.offsets.to_numpy()) if posts.num_rows else (np.empty(0, np.int32), np.zeros(1, int))
        by = {int(t): flat[a:b] for t, a, b in zip(posts.column("number").to_pylist(), at[:-1], at[1:], strict=True)}
        return run(table.column("segment")[0].as_py(), by, sent.value, docs)

    return documents.union(lists).groupBy("segment").applyInArrow(segment, schema)


def contamination(index: DataFrame, queries: DataFrame, key: str = "item_id", size: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged hit words, by position in the document) and items (matching query ids)."""
    schema = "segment long, doc_no int, spans array<struct<start:int,end:int>>, items array<long>"
    arrow = pa.schema([("segment", pa.int64()), ("doc_no", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])
    hits = None
    for rows in query_blocks(queries, key, block_bytes):
        block = Phrases(rows, size)
        sent = index.sparkSession.sparkContext.broadcast((block.phrases, block.items))

        def run(segment: int, lists: dict, counts: dict, docs: pa.Table, sent=sent) -> pa.Table:
            phrases, items = sent.value
            bases = docs.column("base").to_numpy()
            starts, lengths, named = [], [], {}
            for phrase, ids in zip(phrases, items, strict=True):
                if phrase[0] not in lists:
                    continue
                at = phrase_starts(phrase, lists, counts)
                if len(at):
                    starts.append(at)
                    lengths.append(np.full(len(at), len(phrase)))
                    for d in np.unique(np.searchsorted(bases, at, side="right") - 1).tolist():
                        named.setdefault(d, set()).update(ids)
            if not starts:
                return arrow.empty_table()
            starts, lengths = np.concatenate(starts), np.concatenate(lengths)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate((starts + lengths)[order])
            # a span ends where the next start lies beyond all ends so far
            new = np.concatenate([[True], starts[1:] > ends[:-1]])
            first, last = starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
            doc = np.searchsorted(bases, first, side="right") - 1
            out = {}
            for d, a, b in zip(doc.tolist(), (first - bases[doc]).tolist(), (last - bases[doc]).tolist(), strict=True):
                out.setdefault(d, []).append({"start": a, "end": b})
            return pa.table([pa.array([segment] * len(out)), pa.array(list(out), pa.int32()), pa.array(list(out.values()), arrow.field("spans").type), pa.array([sorted(named[d]) for d in out], pa.list_(pa.int64()))], schema=arrow)

        if block.phrases:
            part = _against(index, block, run, schema)
            hits = part if hits is None else hits.union(part)
    docs = index.filter(F.col("term").isNull()).select("segment", "doc_no", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    if hits is None:
        return docs.select("doc_id", "n_words", F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<bigint>").alias("items"))
    merged = hits.groupBy("segment", "doc_no").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = docs.join(merged, ["segment", "doc_no"], "left")
    return out.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("spans", "items")))


def covered(spans: str = "spans"):
    """Words in at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(F.col(spans), zero, step, lambda a: a["n"].cast("long"))


def matches(index: DataFrame, queries: DataFrame, key: str = "item_id", span: int | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item, start): exact matches of whole query texts, or, with ``span``, places from which
    that many words of a document hold all words of the query in any order."""
    schema, out = "segment long, doc_no int, item long, start int", None
    for rows in query_blocks(queries, key, block_bytes):
        block = Phrases(rows, None)
        sent = index.sparkSession.sparkContext.broadcast((block.phrases, block.items))

        def run(segment: int, lists: dict, counts: dict, docs: pa.Table, sent=sent) -> pa.Table:
            bases, n = docs.column("base").to_numpy(), docs.column("n_words").to_numpy()
            found = []
            for phrase, ids in zip(*sent.value, strict=True):
                at = phrase_starts(phrase, lists, counts) if span is None else near_starts(phrase, lists, counts, span, bases + n, bases)
                doc = np.searchsorted(bases, at, side="right") - 1
                found += [(segment, d, item, p) for d, p in zip(doc.tolist(), (at - bases[doc]).tolist(), strict=True) for item in ids]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            return pa.table({c: pa.array(v, t) for c, v, t in zip(("segment", "doc_no", "item", "start"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)})

        part = _against(index, block, run, schema) if block.phrases else None
        out = part if out is None or part is None else out.union(part)
    docs = index.filter(F.col("term").isNull()).select("segment", "doc_no", "doc_id")
    if out is None:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item"), F.lit(0).alias("start"))
    return out.join(docs, ["segment", "doc_no"]).select("doc_id", "item", "start")
