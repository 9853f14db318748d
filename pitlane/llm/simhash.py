"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has the bits that are set in over half of a document's shingle hashes (XXH64, seed 42).
Distinct fingerprints form a binary trie over their bits. The self-join walks pairs of nodes
of the same depth together, from (root, root): a pair goes on to its child pairs, adds one error
where the children's bits differ, and is dropped when the errors exceed the budget. Nodes are
ranges of the sorted fingerprints, so a step handles many pairs at once.

To spread the walk, bits are cut into ``budget + 1`` blocks. Two fingerprints
within the budget agree on one whole block; each fingerprint is rotated so that each block in turn
comes first, and subtries that share the leading block are joined in the same task. The walk
then starts below that block with no error. Tasks keep the links they find as a forest (each fingerprint to the
least one it reached), never as a list of all pairs, and the forests are merged by
large-star / small-star rounds.

Documents without words have fingerprint zero and link like any other. Null text has no words.
Repeated rows share a fingerprint class. ``component_id`` is the smallest doc_id reachable;
null doc_ids are only taken if a component has no other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import groups_for, land, nullable, whole_row, word_blocks

SEED = 42
BATCH = 1 << 18  # node pairs handled at once in a task


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or b"").lower()):
        words = carry + block
        n += _count(words, width, ones)
        carry = words[-(width - 1) :] if width > 1 else []
    if not n:
        if not carry:
            return 0
        n = _count(carry, len(carry), ones)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _count(words: list[bytes], width: int, ones: np.ndarray) -> int:
    """Add the bits of all shingles' hashes; returns the number of shingles."""
    if len(words) < width:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))], "<u8")
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(hashes)


def with_fingerprint(docs: DataFrame, width: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the column ``carry``; fp holds the fingerprint's bits as a signed long."""
    more = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(texts[i].as_buffer().to_pybytes() if texts[i].is_valid else None, width) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *map(batch.column, more)], names=["doc_id", "fp", *more])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *(T.StructField(c, nullable(docs.schema[c].dataType)) for c in more)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, schema)


class Forest:
    """Links between positions 0..n-1, kept as each position's least reachable one."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(values: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Least linked position of every position.

    ``values`` are sorted within the ranges that ``roots`` (starts and the final end) cut; the
    fingerprints of a range agree on their leading ``depth`` bits.
    """
    forest = Forest(len(values))
    ones = [None] * 64  # by depth: how many of the first i values have that bit set

    def bit_counts(d: int) -> np.ndarray:
        if ones[d] is None:
            ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
        return ones[d]

    lo, hi = roots[:-1], roots[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    todo = [(depth, lo[i : i + BATCH], hi[i : i + BATCH], lo[i : i + BATCH], hi[i : i + BATCH], np.zeros(len(lo[i : i + BATCH]), np.int8)) for i in range(0, len(lo), BATCH)]
    while todo:
        d, alo, ahi, blo, bhi, err = todo.pop()
        c = bit_counts(d)
        # children: the values whose next bit is 0 come first
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        part = []
        for x0, x1, y0, y1, cost, keep in (
            (alo, amid, blo, bmid, 0, slice(None)),
            (amid, ahi, bmid, bhi, 0, slice(None)),
            (alo, amid, bmid, bhi, 1, slice(None)),
            (amid, ahi, blo, bmid, 1, ~own),  # the mirror image of the line above for a node with itself
        ):
            part.append((x0[keep], x1[keep], y0[keep], y1[keep], err[keep] + cost))
        x0, x1, y0, y1, e = (np.concatenate(z) for z in zip(*part, strict=True))
        same, nx, ny = x0 == y0, x1 - x0, y1 - y0
        live = (e <= budget) & (nx > 0) & (ny > 0) & ~(same & (nx == 1))
        x0, x1, y0, y1, e, same, nx, ny = (z[live] for z in (x0, x1, y0, y1, e, same, nx, ny))
        # two single leaves are compared at once
        single = (nx == 1) & (ny == 1)
        near = np.bitwise_count(values[x0[single]] ^ values[y0[single]]) <= budget
        forest.link(x0[single][near], y0[single][near])
        x0, x1, y0, y1, e = (z[~single] for z in (x0, x1, y0, y1, e))
        if d + 1 < 64:
            for i in range(0, len(x0), BATCH):
                todo.append((d + 1, *(z[i : i + BATCH] for z in (x0, x1, y0, y1, e))))
    return forest.root


def links(classes: DataFrame, budget: int = 3, per_group: int = 50_000) -> DataFrame:
    """(a, b): every fingerprint linked to the least one that its subtrie's walk reached, b < a by position."""
    blocks = budget + 1
    width = 64 // blocks
    n = classes.count()
    groups = groups_for(n * blocks, per_group, 48)
    turned = classes.select("fp", F.explode(F.array(*(F.lit(i) for i in range(blocks)))).alias("block"))
    rotated = F.when(F.col("block") == 0, F.col("fp")).otherwise(F.expr(f"shiftleft(fp, block * {width}) | shiftrightunsigned(fp, 64 - block * {width})"))
    turned = turned.select("fp", "block", rotated.alias("v"))
    turned = turned.withColumn("bucket", F.pmod(F.xxhash64("block", F.shiftrightunsigned("v", 64 - width)), F.lit(groups)))

    def walk(table: pa.Table) -> pa.Table:
        block, v, fp = (table.column(c).to_numpy() for c in ("block", "v", "fp"))
        v = v.view(np.uint64)
        order = np.lexsort((v, block))
        block, v, fp = block[order], v[order], fp[order]
        lead = v >> np.uint64(64 - width)
        starts = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])]))
        root = trie_links(v, np.append(starts, len(v)), width, budget)
        moved = root != np.arange(len(root))
        return pa.table({"a": fp[moved], "b": fp[root[moved]]})

    return turned.select("bucket", "block", "v", "fp").groupBy("bucket").applyInArrow(walk, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(v, root): each linked node's least node, by alternating large and small stars until nothing moves.

    Minima are partial aggregates and the joins back can be split where a node is hot.
    """
    edges = land(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v != root").distinct(), "edges")
    state = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return edges
        state = new
        both = edges.union(edges.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.min(F.least("v", "root")).alias("m"))
        large = both.join(least, "v").filter("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).filter("v != root").distinct()
        down = large.groupBy("v").agg(F.min("root").alias("m"))
        # every node points to its least smaller neighbour, and so do its other smaller neighbours
        small = large.join(down, "v")
        edges = land(small.select("v", F.col("m").alias("root")).union(small.select(F.col("root").alias("v"), F.col("m").alias("root"))).filter("v != root").distinct(), "edges")


def components(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, root, component_id): the least fingerprint and the smallest doc_id that each fingerprint reaches. ``fps``: (doc_id, fp), landed."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    star = stars(links(classes.select("fp"), budget))
    rooted = classes.join(star.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """One row of each component: that of its smallest doc_id, the first written one if several rows have it."""
    carried = docs.select("doc_id", "text", whole_row(docs).alias("__row"))
    rows = with_fingerprint(carried, width, "__row").withColumn("__rid", F.monotonically_increasing_id())
    rows = land(rows, "fingerprints")
    of = rows.select("doc_id", "fp", "__rid").join(components(rows.select("doc_id", "fp"), budget), "fp")
    first = of.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("__rid").alias("__rid"))
    return rows.join(first.select("__rid"), "__rid", "left_semi").select("__row.*")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row."""
    fps = land(with_fingerprint(docs, width), "fingerprints")
    out = fps.join(components(fps, budget), "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
