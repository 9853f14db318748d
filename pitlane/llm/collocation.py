"""Phrase collocations by direct-address tiling.

Words of a language get ids in the order of their frequency (to an eighth of an octave). Ids that are neighbours in a text
are a pair, and a pair falls into the tile (first id // side, second id // side). Frequent words have small ids, so most pairs
are in few tiles: those are counted by address, with a dense ``bincount`` over all cells of the tile; the pairs of
sparsely filled tiles are sorted and counted as coordinates. Pairs that are frequent in the whole corpus are ranked
like the words, become the symbols of the next round, and the round is the same: two neighbouring symbols of ``m`` words overlap in
``m - 1``, so their pair is a phrase of ``m + 1`` words. No phrase is missed, as all parts of a frequent phrase are frequent.

A shard is a part of one language's texts of about ``shard_bytes`` (one document at least). It holds the sequence of
its symbols and, for each distinct one, its count. The counts of all shards are added up by Spark; the shards are told the ids of those
of their symbols that are frequent (all frequent symbols are sent while their counted number is small, else each shard's own), count the
pairs of these, and go on. A language with most of all rows, or a word in
every text, has many shards with one row in each.

Only A-Z are lowered; pieces end at ``[.,;:!?\\n\\v\\f\\r]`` and at the end of a text, words at spaces and tabs, and phrases do not
leave their piece. Null texts have no words, texts without a language are ``und``. Repeated rows count as often as they are there. Empty
tables have no phrases. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import drop_landed, give_back, land, recorded, rows_by_bytes
from pitlane.session import BIG_ROWS, row_by_row

BREAK = b"."
#: Lowers A-Z and writes every character that ends a piece as a full stop.
TABLE = bytes(0x2E if b in b".,;:!?\n\v\f\r" else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))

WORDS = "shard long, lang string, seq binary, words array<string>, n array<long>"
PAIRS = "shard long, lang string, seq binary, a array<long>, b array<long>, n array<long>"
PAIRS_ARROW = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()),
    ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
])
#: Text that is cut into words at a time.
PIECE = 1 << 20
#: How shards, rows of megabytes, are written.
SHARDS = {"compression": "zstd", **BIG_ROWS}


def squeeze(seq: np.ndarray) -> np.ndarray:
    """The sequence without gaps (-1) that begin it or follow a gap."""
    keep = seq >= 0
    keep[1:] |= seq[:-1] >= 0
    return seq[keep]


def encode(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Local word numbers of some texts (gaps between pieces), the words and their counts."""
    data = b"\n".join(texts).translate(TABLE)
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        parts.append(pa.array(data[at:end].replace(BREAK, b" . ").split(), pa.binary()).dictionary_encode())
        at = end
    if not parts:
        return np.empty(0, np.int32), pa.array([], pa.string()), np.empty(0, np.int64)
    merged = pa.concat_arrays([p.dictionary for p in parts]).dictionary_encode()  # numbered as they first occur, as in one piece
    number, names = merged.indices.to_numpy(zero_copy_only=False).astype(np.int32), merged.dictionary
    start = np.cumsum([0, *(len(p.dictionary) for p in parts)])
    ids = np.concatenate([number[s:][p.indices.to_numpy(zero_copy_only=False)] for s, p in zip(start, parts, strict=False)])
    gap = pc.index(names, BREAK).as_py()
    n = np.bincount(ids, minlength=len(names))
    if gap >= 0:
        ids = np.where(ids == gap, np.int32(-1), ids - (ids > gap).astype(np.int32))
        names = pa.concat_arrays([names[:gap], names[gap + 1 :]])
        n = np.delete(n, gap)
    return squeeze(ids), names.cast(pa.string()), n


def word_shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_bytes: int = 16 << 20) -> DataFrame:
    """The written shards of words: sequence, distinct words and their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal k, held, size
            for name in list(held):
                seq, words, n = encode(held.pop(name))
                if len(words):
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(n, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([name]), pa.array([seq.tobytes()], pa.binary()), *lists], names=["shard", "lang", "seq", "words", "n"])
                    k += 1
            held, size = {}, 0
            give_back()

        for batch in batches:
            for some in rows_by_bytes(batch, "text", PIECE):
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                for name, t in zip(some.column("lang").to_pylist(), texts, strict=True):
                    held.setdefault(name, []).append(t)
                    size += len(t)
                    if size >= shard_bytes:
                        yield from rows()
        yield from rows()

    src = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).filter("octet_length(text) > 0")
    return land(src.mapInArrow(cut, WORDS), "words", **SHARDS)


def count_pairs(a: np.ndarray, b: np.ndarray, side: int = 512, dense: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (first ids, second ids, counts) and the number of the distinct pair at each place.

    A tile with at least one pair for ``dense`` cells is counted by address, the rest as sorted coordinates.
    """
    if not len(a):
        return a, b, np.empty(0, np.int64), np.empty(0, np.int32)
    wide = int(b.max()) // side + 1
    tile = (a // side).astype(np.int64) * wide + b // side
    order = np.argsort(tile, kind="stable")
    tile = tile[order]
    edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
    full = np.diff(edges) * dense >= side * side
    at = np.empty(len(a), np.int32)
    firsts, seconds, counts, found = [], [], [], 0
    for lo, hi in zip(edges[:-1][full].tolist(), edges[1:][full].tolist(), strict=True):
        here = order[lo:hi]
        cell = (a[here] % side) * side + b[here] % side
        n = np.bincount(cell, minlength=side * side)
        held = np.flatnonzero(n)
        number = np.cumsum(n > 0, dtype=np.int32) - 1
        at[here] = number[cell] + found
        row, col = divmod(int(tile[lo]), wide)
        firsts.append(row * side + held // side)
        seconds.append(col * side + held % side)
        counts.append(n[held])
        found += len(held)
    del tile
    rest = order[np.repeat(~full, np.diff(edges))]
    if len(rest):
        pair = a[rest].astype(np.int64) << 32 | b[rest]
        by = np.argsort(pair)
        pair = pair[by]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        at[rest[by]] = np.cumsum(new, dtype=np.int32) - 1 + found
        start = np.flatnonzero(new)
        firsts.append(pair[start] >> 32)
        seconds.append(pair[start] & 0xFFFFFFFF)
        counts.append(np.diff(np.append(start, len(by))))
    return np.concatenate(firsts), np.concatenate(seconds), np.concatenate(counts), at


def next_round(seq: np.ndarray, known: np.ndarray, ids: np.ndarray, units: int) -> tuple[np.ndarray, ...]:
    """From local numbers and the ids of those that are frequent: the pairs' own sequence, ids and counts."""
    to_id = np.full(units + 1, -1, np.int32)  # the last one stands for gaps
    to_id[known] = ids
    x = to_id[seq]
    live = (x[:-1] >= 0) & (x[1:] >= 0)
    a, b, n, at = count_pairs(x[:-1][live], x[1:][live])
    live = np.flatnonzero(live)
    out = np.full(len(x), -1, np.int32)
    out[live] = at
    return squeeze(out), a, b, n


def ranked(frequent: DataFrame, keys: list[str]) -> DataFrame:
    """``id`` per language: 0 for the most frequent, in falling order of ``f`` to an eighth of an octave.

    A bucket of equal octave eighths is split by hash and numbered in parts, so no language is sorted in one task.
    """
    octave, part = F.floor(F.log2("f") * 8).alias("octave"), F.pmod(F.xxhash64(*keys), F.lit(32)).alias("part")
    src = frequent.select("*", octave, part)
    sizes = src.groupBy("lang", "octave", "part").count()  # some ten thousand rows a language at most
    upto = Window.partitionBy("lang").orderBy(F.desc("octave"), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("lang", "octave", "part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("lang", "octave", "part").orderBy(F.desc("f"), *keys))
    return src.withColumn("place", place).join(base, ["lang", "octave", "part"]).select("lang", (F.col("base") + F.col("place") - 1).alias("id"), *keys, "f")


def frequent_units(shards: DataFrame, keys: list[str], min_count: int) -> tuple[DataFrame, DataFrame]:
    """The units (lang, shard, u, keys, n) of all shards, and the frequent ones (written): lang, id, keys and total count ``f``."""
    at = F.explode(F.sequence(F.lit(0), F.size("n") - 1)).alias("u")  # read in place: zipped arrays would be an object a unit
    units = shards.select("lang", "shard", *keys, "n", at).select("lang", "shard", "u", *(F.col(c)[F.col("u")].alias(c) for c in (*keys, "n")))
    total = units.groupBy("lang", *keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    return units, land(ranked(land(total, "frequent"), keys), "ranked")


class Known:
    """The frequent units of all languages: (language) -> ids of a shard's own units."""

    def __init__(self, frequent: pa.Table, keys: list[str]):
        self.keys, self.of = keys, {}
        langs = np.array(frequent.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            t = frequent.filter(pa.array(langs == lang)).combine_chunks()
            ids = t.column("id").to_numpy()
            if len(keys) == 1:
                self.of[lang] = t.column(keys[0]).chunk(0), ids
            else:  # first ids and second ids are below 2^31 here
                pair = t.column("a").to_numpy() << 32 | t.column("b").to_numpy()
                order = np.argsort(pair)
                self.of[lang] = pair[order], ids[order]

    def units(self, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and ids of a shard's units that are frequent."""
        lang = row.column("lang")[0].as_py()
        if lang not in self.of:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        values, ids = self.of[lang]
        own = [row.column(k)[0].values for k in self.keys]
        if len(own) == 1:
            at = pc.fill_null(pc.index_in(own[0], value_set=values), -1).to_numpy(zero_copy_only=False)
        else:
            pair = own[0].to_numpy() << 32 | own[1].to_numpy()
            at = np.minimum(np.searchsorted(values, pair), len(values) - 1)
            at = np.where(values[at] == pair, at, -1)
        found = np.flatnonzero(at >= 0)
        return found, ids[at[found]]


def _next_row(shard: pa.Scalar, lang: pa.Scalar, seq: pa.Scalar, known: np.ndarray, ids: np.ndarray, units: int) -> pa.RecordBatch | None:
    """The shard's row in the next round; none if no pair is left."""
    out, *lists = next_round(np.frombuffer(seq.as_buffer(), np.int32), known, ids, units)
    if not len(lists[0]):
        return None
    cols = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int64, copy=False))) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([lang.as_py()], pa.string()), pa.array([out.tobytes()], pa.binary()), *cols], schema=PAIRS_ARROW)


def pair_shards(shards: DataFrame, units: DataFrame, frequent: DataFrame, keys: list[str], broadcast_rows: int) -> DataFrame:
    """The written shards of the next round.

    Up to ``broadcast_rows`` counted frequent units are sent to all executors; beyond, a join tells every shard the ids of its
    own ones. Both give the same rows.
    """
    if frequent.count() <= broadcast_rows:
        sent = shards.sparkSession.sparkContext.broadcast(Known(frequent.select("lang", "id", *keys).toArrow(), keys))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    out = _next_row(row.column("shard")[0], row.column("lang")[0], row.column("seq")[0], *sent.value.units(row), len(row.column(keys[0])[0]))
                    if out:
                        yield out
                    out = row = None
                    give_back()

        own = row_by_row(shards.sparkSession).read.schema(shards.schema).parquet(*shards.inputFiles())
        out = land(own.select("shard", "lang", "seq", *keys).mapInArrow(step, PAIRS), "pairs", shards.sparkSession, **SHARDS)
        sent.destroy()
        return out

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            rows = [_next_row(left.column("shard")[0], left.column("lang")[0], left.column("seq")[0], right.column("u").to_numpy(), right.column("id").to_numpy(), left.column("units")[0].as_py())]
        give_back()
        return pa.Table.from_batches([r for r in rows if r], PAIRS_ARROW)

    own = units.drop("n").join(frequent.drop("f"), ["lang", *keys]).select(F.col("shard").alias("of"), "u", "id")
    left = shards.select("shard", "lang", "seq", F.size("n").alias("units"))
    return land(left.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(answer, PAIRS), "pairs", **SHARDS)


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _described(levels: list[DataFrame]) -> list[DataFrame]:
    """For each length: lang, id, f, phrase, its last word, and the counts of its first and last 1, 2, ... words."""
    out = [levels[0].select("lang", "id", "f", F.col("words").alias("phrase"), F.col("words").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for level in levels[1:]:
        p = out[-1].select("lang", F.col("id").alias("a"), F.col("phrase").alias("p_phrase"), F.col("heads").alias("p_heads"))
        s = out[-1].select("lang", F.col("id").alias("b"), "last", F.col("tails").alias("s_tails"))
        out.append(land(level.join(p, ["lang", "a"]).join(s, ["lang", "b"]).select(
            "lang", "id", "f", F.concat_ws(" ", "p_phrase", "last").alias("phrase"), "last",
            F.concat("p_heads", F.array("f")).alias("heads"), F.concat("s_tails", F.array("f")).alias("tails"),
        ), "phrases"))
    return out


def _scored(phrases: DataFrame, longer: DataFrame | None, size: int, totals: DataFrame) -> DataFrame:
    """Phrases of ``size`` words with the lowest cut's l, r and score, but for those that a longer one always holds."""
    if longer is not None:
        held = longer.select("lang", F.col("a").alias("id"), "f").union(longer.select("lang", F.col("b").alias("id"), "f"))
        phrases = phrases.join(held, ["lang", "id", "f"], "left_anti")
    cut = lambda k: F.struct(
        F.call_function("div", 1000 * _exact(F.col("f")) * _exact(F.col("n")), _exact(F.col("heads")[k - 1]) * _exact(F.col("tails")[size - k - 1])).alias("score"),
        F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[size - k - 1].alias("r"),
    )
    least = F.array_min(F.array(*(cut(k) for k in range(1, size))))
    return phrases.join(totals, "lang").withColumn("cut", least).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100, top: int = 2000,
    shard_bytes: int = 16 << 20, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    levels, written = [], []
    with recorded(written):
        shards = word_shards(docs, text, lang, shard_bytes)
    totals = land(shards.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    for size in range(1, max_words + 1):
        keys = ["words"] if size == 1 else ["a", "b"]
        units, frequent = frequent_units(shards, keys, min_count)
        levels.append(frequent)
        if size < max_words:
            last, written = written, []
            with recorded(written):
                shards = pair_shards(shards, units, frequent, keys, broadcast_rows)
            drop_landed(docs.sparkSession, last)
    described = _described(levels)
    found = None
    for size in range(2, max_words + 1):
        part = _scored(described[size - 1], levels[size] if size < max_words else None, size, totals)
        found = part if found is None else found.unionByName(part)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of 64 parts of a language, then the best of these.
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
