"""Hierarchical Pitman-Yor language model over words.

Tokens are words (runs without ASCII white space, A-Z lowered) and one end a text. Every previous token has a
restaurant whose dishes are the tokens that follow it (before a text's first token: the end). These context
restaurants share one parent, the restaurant of all tokens, whose base is uniform over the V distinct training
tokens and one unknown token, so all unseen words are one outcome.

Seating. A dish has customers (training tokens) and tables; a context's tables are its customers in the parent. A
Gibbs sweep takes all customers of a dish out of its restaurant and seats them again one after another: customer
``i + 1`` opens a table with weight ``(theta + d * T) * p`` (T: tables of the restaurant, p: the parent's probability of the dish)
against ``i - d * t``. Dishes of a restaurant are seated side by side, given the others' tables of the
state before; beyond ``EXACT`` customers, blocks of a sixteenth of those already seated are drawn at once from
the binomial law of the block's first customer. The chain starts with the parent seated on all training tokens and the
contexts seated given that. A sweep makes the contexts' tables the parent's customers, seats the parent again, and then the
contexts given the parent. After ``burn`` sweeps of the parent the predictive probabilities are averaged over ``samples`` sweeps,
each from the contexts' tables and the parent that was seated on them.

Spread. Documents are dealt to shards. A shard sends its distinct words with training counts to word
buckets (a frequent word travels once a shard), which add them up, and its distinct word pairs with counts to pair buckets, dealt by context;
a context with very many different followers in a shard is split over buckets by the follower. Its parts stay one restaurant: their
customers and tables are added up in every sweep, and all parts are seated and normalised by the whole context's. Pair buckets add up and keep the state of their contexts. In a sweep they send the tables of each of
their words (partial sums) to the word buckets, which add them up, seat the parent's dishes and answer; the number of distinct
words and the tables of the whole parent are sums over all word buckets. At the end pair buckets answer the
shards, which sum over their documents. States and messages are written tables; those of a sweep go when the next one is written.
Words are told apart by a 64-bit hash.

Null text is empty: the end alone. Rows with a null doc_id are held out. Repeated rows count and are scored each.
Without training text every token is the unknown one. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm import bwt_dedup
from pitlane.llm.bwt_dedup import ROWS, out
from pitlane.llm.common import distinct, drop_landed, groups_for, land, recorded, text_bytes

EXACT = 64
#: Discounts of the parent and of the contexts, and their concentration.
PARENT_DISCOUNT, DISCOUNT, STRENGTH = 0.6, 0.8, 1.0
WIDE = 1 << 16  # different followers in one shard beyond which a context is split
PARTS = 64


#: What travels is compressed where it is made: Spark's shuffle knows repeats alone, not rare and frequent bytes.
CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string, after its size."""
    plain = bwt_dedup.pack(*arrays)
    return len(plain).to_bytes(8, "little") + CODEC.compress(plain, asbytes=True)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    """The arrays that ``pack`` was given."""
    return bwt_dedup.unpack(CODEC.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True), *types)


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value, -1 if absent."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[i] == wanted, i, -1)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and every value's number among them (``np.unique`` sorts stably for the places)."""
    order = np.argsort(values)
    in_order = values[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])[: len(order)]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return in_order[new], order[new], inverse


def cuts(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of every run."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])
    return list(zip(sorted_values[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_values)).tolist(), strict=True))


class Restaurants:
    """Dishes by restaurant: customers and tables."""

    def __init__(self, room: np.ndarray, customers: np.ndarray, rooms: int, discount: float):
        self.room, self.customers, self.rooms, self.d = room, customers.astype(np.int64), rooms, discount
        self.tables = np.ones(len(room), np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of every restaurant."""
        return np.bincount(self.room, self.customers, self.rooms), np.bincount(self.room, self.tables, self.rooms)

    def seat(self, p: np.ndarray, rng: np.random.Generator, others: int = 0) -> None:
        """Seat the customers of every dish again; ``others`` are tables of dishes that are kept elsewhere."""
        d = self.d
        several = np.flatnonzero(self.customers > 1)  # one customer has one table
        rest = (self.totals()[1][self.room] - self.tables + others)[several]
        order = np.argsort(-self.customers[several], kind="stable")
        several, rest = several[order], rest[order]
        c, p = self.customers[several], p[several]
        t, falling, i = np.ones(len(c)), -c, 1
        while True:
            live = int(np.searchsorted(falling, -i, side="left"))  # dishes with more than i customers
            if not live:
                break
            size = 1 if i < EXACT else i // 16
            new = (STRENGTH + d * (rest[:live] + t[:live])) * p[:live]
            share = new / (new + i - d * t[:live])
            if size == 1:
                t[:live] += rng.random(live) < share
            else:
                t[:live] += rng.binomial(np.minimum(size, c[:live] - i), share)
            i += size
        self.tables = np.ones(len(self.room), np.int64)
        self.tables[several] = t.astype(np.int64)

    def averaged_tables(self, p: np.ndarray, seed: int, burn: int, samples: int, others: int = 0) -> np.ndarray:
        """Tables of every dish, averaged over sweeps after the first ``burn``."""
        rng, total = np.random.default_rng(seed), np.zeros(len(self.room))
        for k in range(burn + samples):
            self.seat(p, rng, others)
            if k >= burn:
                total += self.tables
        return total / samples


def numbered(texts: list[bytes | None], block: int = 8 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as numbers in order of occurrence, the distinct words, and the number of words of each text."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    counts, chunks, ends = np.zeros(len(texts), np.int64), [], np.cumsum(sizes)
    at = 0
    while at < len(texts):
        hi = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + block, side="right")))
        data = np.frombuffer(b"".join(x for t in texts[at:hi] for x in ((t or b"").lower(), b"\n")), "u1")
        space = (data == 32) | (data - np.uint8(9) < 5)
        # where a word begins, and the space after it: a space follows every text
        bound = np.flatnonzero(np.diff(space, prepend=True))
        first = bound[::2]
        counts[at:hi] = np.diff(np.searchsorted(first, ends[at:hi] - ends[at] + sizes[at]), prepend=0)
        offsets = np.concatenate([[0], np.cumsum(bound[1::2] - first)]).astype(np.int32)
        chunks.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]))
        at = hi
    coded = pa.chunked_array(chunks, pa.binary()).dictionary_encode()
    words = coded.chunk(coded.num_chunks - 1).dictionary.to_numpy(zero_copy_only=False) if coded.num_chunks else []
    ids = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
    return np.concatenate([np.empty(0, np.int32), *ids]), words, counts


class Shard:
    """Texts as numbers of distinct words, in the order of the words' hashes; the end is the empty word."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.number = table.column("shard")[0].as_py()
        self.held = np.array(table.column("held_out").to_pylist(), bool)
        ids, words, counts = numbered(table.column("text").to_pylist())
        end = len(words)  # every word has a byte at least
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*words, b""]), np.uint64, end + 1)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.sizes = counts + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.full(self.sizes.sum(), place[end])
        self.tokens[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = place[ids]
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = place[end]
        self.pair_of = before << 32 | self.tokens  # the context's number, then the token's
        self.train = np.repeat(~self.held, self.sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.hashes))

    def words_by_bucket(self, buckets: int) -> dict[int, np.ndarray]:
        return by_hash(self.hashes, buckets)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (sorted) and their training counts."""
        in_order = np.sort(self.pair_of << 1 | self.train)
        pairs = in_order >> 1
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[first], np.add.reduceat(in_order & 1, first)

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (sorted), and the place of every token's pair among them."""
        pairs, _, inverse = ranked(self.pair_of)
        return pairs, inverse

    def wide(self) -> np.ndarray:
        """Marks words with more than ``WIDE`` different followers."""
        context = self.pair_of >> 32
        often = np.bincount(context, minlength=len(self.hashes)) > WIDE
        followers = distinct(self.pair_of[often[context]]) >> 32
        return np.bincount(followers, minlength=len(self.hashes)) > WIDE

    def pairs_by_bucket(self, pairs: np.ndarray, wide: set[int], buckets: int) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """The pairs of each bucket, by context key and follower hash; every pair's context key, and the context's hash if it is split (0 if not)."""
        context, word = pairs >> 32, pairs & 0xFFFFFFFF
        key = self.hashes[context]
        whole = np.zeros(len(key), np.uint64)
        if wide:
            # a part of a split context has a key of its own
            split = np.isin(key, np.fromiter(wide, np.uint64, len(wide)))
            part = self.hashes[word[split]] >> np.uint64(40) & np.uint64(PARTS - 1)
            whole[split] = key[split]
            key[split] = key[split] + (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        b = _short(key % np.uint64(buckets), buckets)
        # sorted pairs are in the order of the keys and the followers' hashes but for split contexts
        order = np.lexsort((self.hashes[word], key, b)) if whole.any() else np.argsort(b, kind="stable")
        return {k: order[lo:hi] for k, lo, hi in cuts(b[order])}, key, whole


def ask_words(table: pa.Table, buckets: int) -> pa.Table:
    """Distinct words of a shard with training counts, and whether a word has very many followers here."""
    s = Shard(table)
    counts = s.counts()
    wide = s.wide().astype(np.uint8)
    return out([(b, s.number, pack(*_steps(s.hashes[mine]), counts[mine].astype("<i8"), wide[mine])) for b, mine in s.words_by_bucket(buckets).items()])


def answer_words(table: pa.Table, shards: int, buckets: int, burn: int, samples: int, seed: int) -> pa.Table:
    """Counts, tables in the parent at the start, and split marks, for each asking shard; sums of the bucket for all shards."""
    bucket, asked = table.column("bucket")[0].as_py(), {}
    for shard, data in zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True):
        steps, counts, wide = unpack(data, "<u8", "<i8", "u1")
        asked[shard] = (_from_steps(steps), counts, wide)
    hashes, inverse = np.unique(np.concatenate([a[0] for a in asked.values()]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([a[1] for a in asked.values()]), len(hashes)).astype(np.int64)
    wide = np.bincount(inverse, np.concatenate([a[2] for a in asked.values()]), len(hashes)) > 0
    known, tables = np.flatnonzero(counts), np.zeros(len(hashes))
    if len(known):
        # only the start: the other buckets are taken to hold as many words, of one table each
        rest = len(known) * (buckets - 1)
        room = Restaurants(np.zeros(len(known), np.int64), counts[known], 1, PARENT_DISCOUNT)
        p = np.full(len(known), 1 / (len(known) + rest + 1))
        tables[known] = room.averaged_tables(p, seed + bucket, burn, samples, rest)
    sums = np.array([counts.sum(), len(known), tables.sum()], "<f8")
    none = (np.empty(0, np.uint64),) * 3
    rows = []
    for shard in range(shards):
        at = find(hashes, asked.get(shard, none)[0])
        rows.append((bucket, shard, pack(counts[at].astype("<i8"), tables[at].astype("<f4"), wide[at].astype(np.uint8), sums)))
    return out(rows)


class Parent:
    """What a shard knows of the parent from the word buckets' answers."""

    def __init__(self, s: Shard, answers: pa.Table, buckets: int):
        self.counts, self.tables = np.zeros(len(s.hashes), np.int64), np.zeros(len(s.hashes))
        wide, total, by = np.zeros(len(s.hashes), bool), np.zeros(3), s.words_by_bucket(buckets)
        for b, data in sorted(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)):
            counts, tables, marks, sums = unpack(data, "<i8", "<f4", "u1", "<f8")
            total += sums
            if len(counts):
                self.counts[by[b]], self.tables[by[b]], wide[by[b]] = counts, tables, marks
        self.n, self.distinct = int(total[0]), int(total[1])
        self.wide = set(s.hashes[wide].tolist())
        base = (STRENGTH + PARENT_DISCOUNT * total[2]) / (self.distinct + 1)
        self.p = (np.maximum(self.counts - PARENT_DISCOUNT * self.tables, 0) + base) / (STRENGTH + self.n)


def ask_pairs(left: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Distinct pairs of a shard with training counts and the parent's probability of the follower at the start."""
    if not left.num_rows:
        return out([])
    s = Shard(left)
    parent = Parent(s, answers, buckets)
    pairs, counts = s.pairs()
    by, key, whole = s.pairs_by_bucket(pairs, parent.wide, buckets)
    # the probability in steps of a sixth of a power of two: enough to start from
    level = np.clip(np.round(-6 * np.log2(parent.p)), 0, 255).astype("u1")
    rows = []
    for b, mine in by.items():
        words, at = np.unique(pairs[mine] & 0xFFFFFFFF, return_inverse=True)
        keys = key[mine]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        followers = np.diff(first, append=len(keys))
        rows.append((b, s.number, pack(*_steps(keys[first]), whole[mine][first], _planes(followers), *_steps(s.hashes[words]), _places(at, followers), *_small(counts[mine]), level[words])))
    return out(rows)


def _small(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whole numbers take a byte each, and those over it are listed."""
    large = np.flatnonzero(a > 254)
    return np.minimum(a, 255).astype("u1"), large.astype("<u4"), a[large].astype("<i8")


def _from_small(small: np.ndarray, large: np.ndarray, values: np.ndarray) -> np.ndarray:
    a = small.astype(np.int64)
    a[large] = values
    return a


def _planes(a: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """Numbers as byte planes: first the lowest bytes of all, then the next ones; the upper ones are mostly zero, which compression removes."""
    return np.ascontiguousarray(a.astype(kind).view("u1").reshape(-1, np.dtype(kind).itemsize).T).reshape(-1).view(kind)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.view("u1").reshape(planes.itemsize, -1).T).reshape(-1).view(planes.dtype)


def _places(at: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """Places of the followers, which ascend in every context: the first one, then differences."""
    first = np.cumsum(followers, dtype=np.int64) - followers
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    return _planes(steps)


def _from_places(planes: np.ndarray, followers: np.ndarray) -> np.ndarray:
    sums = np.cumsum(_from_planes(planes), dtype=np.int64)
    first = np.cumsum(followers, dtype=np.int64) - followers
    return sums - np.repeat(np.concatenate([[0], sums])[first], followers)


def _steps(hashes: np.ndarray) -> tuple[np.ndarray]:
    """Sorted hashes as differences."""
    return (_planes(np.diff(hashes, prepend=np.uint64(0)), "<u8"),)


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(_from_planes(steps), dtype=np.uint64)


SMALL = ("u1", "<u4", "<i8")


def _short(b: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers in few bytes, which sort faster."""
    return b.astype(np.min_scalar_type(buckets))


def by_hash(hashes: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Places of the hashes of each bucket."""
    if not len(hashes):
        return {}
    b = _short(hashes % np.uint64(buckets), buckets)
    order = np.argsort(b, kind="stable")
    return {k: order[lo:hi] for k, lo, hi in cuts(b[order])}


#: Probabilities travel as 16-bit logarithms, a 700th of a power of two apart.
def _to_log(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-700 * np.log2(np.maximum(p, 1e-30))), 0, 65535).astype("<u2")


def _from_log(steps: np.ndarray) -> np.ndarray:
    return 2.0 ** (steps / -700.0)


class Asked:
    """What the shards asked a pair bucket, added up; ``place`` has the entries of each shard's pairs."""

    def __init__(self, table: pa.Table):
        asked = [(s, unpack(d, "<u8", "<u8", "<u4", "<u8", "<u4", *SMALL, "u1")) for s, d in sorted(zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True))]
        self.shards = [s for s, _ in asked]
        contexts, first, room = ranked(np.concatenate([_from_steps(a[0]) for _, a in asked]))
        self.whole = np.concatenate([a[1] for _, a in asked])[first]
        followers = [_from_planes(a[2]) for _, a in asked]
        room = np.repeat(room, np.concatenate(followers))
        self.words, first, word = ranked(np.concatenate([_from_steps(a[3]) for _, a in asked]))
        self.start = 2.0 ** (np.concatenate([a[-1] for _, a in asked])[first] / -6.0)
        starts = np.cumsum([0, *(len(a[3]) for _, a in asked)])
        word = word[np.concatenate([_from_places(a[4], f) + at for (_, a), f, at in zip(asked, followers, starts, strict=False)])]
        entries, inverse = np.unique(room << 32 | word, return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([_from_small(*a[5:8]) for _, a in asked]), len(entries)).astype(np.int64)
        self.followers, self.at = np.bincount(entries >> 32, minlength=len(contexts)), entries & 0xFFFFFFFF
        self.place = np.split(inverse, np.cumsum([len(a[4]) for _, a in asked])[:-1])


class Contexts:
    """The state of a pair bucket: contexts with their followers' customers and tables, and averaged predictive probabilities.

    ``whole`` has the hash of the context of which a room is a part, 0 if it is not split.
    """

    #: What stays, and what a sweep changes.
    KEPT, TYPES = ("<u8", "<u4", "<u8", "<u4", *SMALL), (*SMALL, "<u2")
    kept: bytes | None = None

    def __init__(self, whole: np.ndarray, followers: np.ndarray, words: np.ndarray, at: np.ndarray, counts: np.ndarray, tables: np.ndarray, mean: np.ndarray):
        self.whole, self.followers, self.words, self.at, self.counts, self.tables, self.mean = whole, followers, words, at, counts, tables, mean
        self.rooms = len(followers)
        self.room = np.repeat(np.arange(self.rooms), followers)

    @classmethod
    def opened(cls, a: Asked) -> Contexts:
        return cls(a.whole, a.followers, a.words, a.at, a.counts, np.minimum(a.counts, 1), np.zeros(0))

    @classmethod
    def unpacked(cls, data: bytes) -> Contexts:
        size = int.from_bytes(data[:8], "little")
        kept = data[8 : 8 + size]
        whole, followers, words, at, *counts = unpack(kept, *cls.KEPT)
        *tables, mean = unpack(data[8 + size :], *cls.TYPES)
        followers = _from_planes(followers)
        c = cls(whole, followers, _from_steps(words), _from_places(at, followers), _from_small(*counts), _from_small(*tables), _from_log(_from_planes(mean)))
        c.kept = kept
        return c

    def packed(self) -> bytes:
        kept = self.kept or pack(self.whole, _planes(self.followers), *_steps(self.words), _places(self.at, self.followers), *_small(self.counts))
        return len(kept).to_bytes(8, "little") + kept + pack(*_small(self.tables), _planes(_to_log(self.mean), "<u2"))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of every room."""
        return np.bincount(self.room, self.counts, self.rooms), np.bincount(self.room, self.tables, self.rooms)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the split contexts of which parts are here, the rooms that are parts, and the place of each one's context."""
        rooms = np.flatnonzero(self.whole)
        hashes, place = np.unique(self.whole[rooms], return_inverse=True)
        return hashes, rooms, place

    def seat(self, p: np.ndarray, rng: np.random.Generator, tables: np.ndarray | None = None) -> None:
        """Seat all customers again, given the parent's probabilities of the words and the tables of every room's context (of the rooms alone if None)."""
        train = np.flatnonzero(self.counts)
        r = Restaurants(self.room[train], self.counts[train], self.rooms, DISCOUNT)
        r.tables = self.tables[train]
        elsewhere = 0 if tables is None else (tables - self.totals()[1])[r.room]
        r.seat(p[self.at[train]], rng, elsewhere)
        self.tables = self.tables.copy()
        self.tables[train] = r.tables

    def predict(self, p: np.ndarray, n: np.ndarray, t: np.ndarray, k: int) -> None:
        """Average the predictive probabilities of this state, the ``k``-th sample, given customers and tables of every room's context."""
        left = STRENGTH + DISCOUNT * t
        now = (self.counts - DISCOUNT * self.tables + left[self.room] * p[self.at]) / (STRENGTH + n)[self.room]
        self.mean = self.mean + (now - self.mean) / k if k > 1 else now

    def messages(self, buckets: int) -> list[tuple[int, bytes]]:
        """Partial sums, for word buckets: the tables of every word, customers and tables of every split context."""
        sums = np.bincount(self.at, self.tables, len(self.words)).astype(np.int64)
        hashes, rooms, place = self.parts()
        n, t = (np.bincount(place, x[rooms], len(hashes)) for x in self.totals())
        words, split = by_hash(self.words, buckets), by_hash(hashes, buckets)
        none = np.empty(0, np.int64)
        rows = []
        for b in sorted({*words, *split}):
            mine, whole = words.get(b, none), split.get(b, none)
            rows.append((b, pack(*_steps(self.words[mine]), *_small(sums[mine]), hashes[whole], n[whole], t[whole])))
        return rows


#: Rows of a sweep: kind 0 is the state of a bucket (with its tables and customers), kind 1 a message to ``bucket`` from bucket ``shard``,
#: kind 2 the places in ``bucket`` of what ``shard`` asked, kind 3 the averaged probabilities of a bucket.
SWEEP = "kind int, bucket int, shard int, data binary, tables double, customers double"
SWEEP_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), ("tables", pa.float64()), ("customers", pa.float64())])


def sweep_rows(rows: list[tuple[int, int, int, bytes, float, float]]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 6, SWEEP_ARROW, strict=True)], schema=SWEEP_ARROW)


def _context_rows(bucket: int, c: Contexts, buckets: int) -> pa.Table:
    return sweep_rows([(0, bucket, -1, c.packed(), 0.0, 0.0), *((1, b, bucket, m, 0.0, 0.0) for b, m in c.messages(buckets))])


def open_contexts(table: pa.Table, buckets: int, seed: int) -> pa.Table:
    """The contexts of a pair bucket, seated given the parent's start."""
    bucket, asked = table.column("bucket")[0].as_py(), Asked(table)
    c = Contexts.opened(asked)
    c.seat(asked.start, np.random.default_rng([seed, bucket, 0]))
    # a shard's pairs are in the order of the entries
    places = [(2, bucket, s, pack(*_small(np.diff(mine, prepend=0))), 0.0, 0.0) for s, mine in zip(asked.shards, asked.place, strict=True)]
    return pa.concat_tables([_context_rows(bucket, c, buckets), sweep_rows(places)])


def sweep_parent(asked: pa.Table, state: pa.Table, known: int, all_tables: float, seed: int, sweep: int) -> pa.Table:
    """Seat a word bucket's dishes of the parent on the contexts' tables (``all_tables`` are the whole parent's before); add up split contexts."""
    bucket, messages = asked.column("bucket")[0].as_py(), []
    for pair_bucket, data in sorted(zip(asked.column("shard").to_pylist(), asked.column("data").to_pylist(), strict=True)):
        steps, c, c_at, c_large, whole, n, t = unpack(data, "<u8", *SMALL, "<u8", "<f8", "<f8")
        messages.append((pair_bucket, _from_steps(steps), _from_small(c, c_at, c_large), whole, n, t))
    hashes, inverse = np.unique(np.concatenate([m[1] for m in messages]), return_inverse=True)
    customers = np.bincount(inverse, np.concatenate([m[2] for m in messages]), len(hashes)).astype(np.int64)
    tables = _from_small(*unpack(state.column("data")[0].as_py(), *SMALL)) if state.num_rows else np.minimum(customers, 1)
    train = np.flatnonzero(customers)
    r = Restaurants(np.zeros(len(train), np.int64), customers[train], 1, PARENT_DISCOUNT)
    r.tables = tables[train]
    r.seat(np.full(len(train), 1 / (known + 1)), np.random.default_rng([seed, bucket, sweep, 1]), all_tables - tables.sum())
    tables[train] = r.tables
    split, place = np.unique(np.concatenate([m[3] for m in messages]), return_inverse=True)
    n, t = (np.bincount(place, np.concatenate([m[i] for m in messages]), len(split)) for i in (4, 5))
    value = (customers - PARENT_DISCOUNT * tables).astype("<f4")
    rows = [(0, bucket, -1, pack(*_small(tables)), float(tables.sum()), float(customers.sum()))]
    at = at_split = 0
    for pair_bucket, words, _, whole, *_ in messages:
        theirs = place[at_split : at_split + len(whole)]
        rows.append((1, pair_bucket, bucket, pack(value[inverse[at : at + len(words)]], n[theirs], t[theirs]), 0.0, 0.0))
        at, at_split = at + len(words), at_split + len(whole)
    return sweep_rows(rows)


def sweep_contexts(state: pa.Table, replies: pa.Table, buckets: int, known: int, tables: float, customers: float, burn: int, samples: int, seed: int, sweep: int) -> pa.Table:
    """With the parent seated on the contexts' tables: average the predictive probabilities, and seat the contexts again."""
    bucket, c = state.column("bucket")[0].as_py(), Contexts.unpacked(state.column("data")[0].as_py())
    value, by = np.empty(len(c.words)), by_hash(c.words, buckets)
    hashes, rooms, place = c.parts()
    whole, split = np.empty((2, len(hashes))), by_hash(hashes, buckets)
    none = np.empty(0, np.int64)
    for b, data in zip(replies.column("shard").to_pylist(), replies.column("data").to_pylist(), strict=True):
        value[by.get(b, none)], whole[0, split.get(b, none)], whole[1, split.get(b, none)] = unpack(data, "<f4", "<f8", "<f8")
    n, t = c.totals()
    n[rooms], t[rooms] = whole[:, place]
    p = (value + (STRENGTH + PARENT_DISCOUNT * tables) / (known + 1)) / (STRENGTH + customers)
    if sweep > burn:
        c.predict(p, n, t, sweep - burn)
    if sweep == burn + samples:
        return sweep_rows([(3, bucket, -1, pack(_to_log(c.mean)), 0.0, 0.0)])
    c.seat(p, np.random.default_rng([seed, bucket, sweep]), t)
    return _context_rows(bucket, c, buckets)


def answer_places(places: pa.Table, means: pa.Table) -> pa.Table:
    """The averaged predictive probability of each pair that a shard asked."""
    (p,) = unpack(means.column("data")[0].as_py(), "<u2")
    bucket = means.column("bucket")[0].as_py()
    return out([(bucket, s, pack(p[np.cumsum(_from_small(*unpack(d, *SMALL)))])) for s, d in zip(places.column("shard").to_pylist(), places.column("data").to_pylist(), strict=True)])


def answer_pairs(table: pa.Table, burn: int, samples: int, seed: int) -> pa.Table:
    """The averaged predictive probability of each asked pair, for a bucket on its own: a chain under the parent's start."""
    bucket, asked = table.column("bucket")[0].as_py(), Asked(table)
    c, rng = Contexts.opened(asked), np.random.default_rng([seed, bucket])
    for k in range(1, burn + samples + 1):
        c.seat(asked.start, rng)
        if k > burn:
            c.predict(asked.start, *c.totals(), k - burn)
    p = _to_log(c.mean)
    return out([(bucket, s, pack(p[mine])) for s, mine in zip(asked.shards, asked.place, strict=True)])


#: Shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``land``, compressed, leaving no shuffle files."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return land(df, name, compression="zstd")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


FINAL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FINAL_ARROW = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in FINAL.split(", "))])


def finish(left: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Sums over each document of a shard; ``kind`` 1 are answers about words, 2 about pairs."""
    if not left.num_rows:
        return FINAL_ARROW.empty_table()
    s = Shard(left)
    kind = np.array(answers.column("kind").to_pylist())
    parent = Parent(s, answers.filter(pa.array(kind == 1)), buckets)
    pairs, inverse = s.distinct_pairs()
    by, _, _ = s.pairs_by_bucket(pairs, parent.wide, buckets)
    p = np.empty(len(pairs))
    second = answers.filter(pa.array(kind == 2))
    for b, data in zip(second.column("bucket").to_pylist(), second.column("data").to_pylist(), strict=True):
        p[by[b]] = _from_log(*unpack(data, "<u2"))
    logs = np.log10(p)
    score = np.add.reduceat(logs[inverse], s.starts)
    unigram = np.log10((parent.counts + 1.0) / (parent.n + parent.distinct + 1.0))
    base = np.add.reduceat(unigram[s.tokens], s.starts)
    known = np.add.reduceat((parent.counts > 0)[s.tokens].astype(np.int64), s.starts)
    cols = [left.column("doc_id").combine_chunks(), pa.array(s.held), pa.array(s.sizes), pa.array(known), pa.array(np.full(len(score), parent.n)), pa.array(base), pa.array(score)]
    return pa.table(cols, schema=FINAL_ARROW)


def held_out(divisor: int = 7, remainder: int = 2) -> Column:
    """The documents that training leaves out, by the crc32 of the doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(True))


def score_documents(docs: DataFrame, held: Column | None = None, burn: int = 2, samples: int = 4, seed: int = 11, shard_bytes: int = 12 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of every document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (held_out() if held is None else held).alias("held_out"))
    total = text_bytes(src)
    shards, buckets = groups_for(total, shard_bytes, 8), groups_for(total, bucket_bytes, 64)
    by_shard = src.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).groupBy("shard")

    def ask_words_(t: pa.Table) -> pa.Table:
        return ask_words(t, buckets)

    def answer_words_(t: pa.Table) -> pa.Table:
        return answer_words(t, shards, buckets, 0, 1, seed)

    def ask_pairs_(left: pa.Table, right: pa.Table) -> pa.Table:
        return ask_pairs(left, right, buckets)

    def open_contexts_(t: pa.Table) -> pa.Table:
        return open_contexts(t, buckets, seed)

    def known_words(t: pa.Table) -> pa.Table:
        return pa.table({"n": [int(unpack(t.column("data")[0].as_py(), "<i8", "<f4", "u1", "<f8")[3][1])]})

    def finish_(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left, right, buckets)

    def landed(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        paths: list[str] = []
        with recorded(paths):
            return written(df, name), paths

    words = written(by_shard.applyInArrow(ask_words_, ROWS).groupBy("bucket").applyInArrow(answer_words_, ROWS), "py-words")
    asks = by_shard.cogroup(words.groupBy("shard")).applyInArrow(ask_pairs_, ROWS)
    known = words.filter("shard = 0").groupBy("bucket").applyInArrow(known_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def part(df: DataFrame, kind: int):
        return df.filter(F.col("kind") == kind).groupBy("bucket")

    def parent_step(k: int, tables: float):
        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            return sweep_parent(left, right, known, tables, seed, k)

        return step

    def context_step(k: int, tables: float, customers: float):
        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            return sweep_contexts(left, right, buckets, known, tables, customers, burn, samples, seed, k)

        return step

    opened, old_opened = landed(asks.groupBy("bucket").applyInArrow(open_contexts_, SWEEP), "py-opened")
    # the first state goes after its sweep, the places stay
    places = written(opened.filter("kind = 2"), "py-places")
    contexts, old = opened, old_opened
    parent, old_parent, tables = docs.sparkSession.createDataFrame([], SWEEP), [], float(known)
    for k in range(1, burn + samples + 1):
        parent, new = landed(part(contexts, 1).cogroup(part(parent, 0)).applyInArrow(parent_step(k, tables), SWEEP), "py-parent")
        drop_landed(docs.sparkSession, old_parent)
        old_parent = new
        sums = parent.filter("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tables", "customers"))).first()
        tables = sums["tables"]
        contexts, new = landed(part(contexts, 0).cogroup(part(parent, 1)).applyInArrow(context_step(k, tables, sums["customers"]), SWEEP), "py-contexts")
        drop_landed(docs.sparkSession, old)
        old = new
    drop_landed(docs.sparkSession, old_parent)
    pairs = places.groupBy("bucket").cogroup(part(contexts, 3)).applyInArrow(answer_places, ROWS)
    answers = words.withColumn("kind", F.lit(1)).union(pairs.withColumn("kind", F.lit(2)))
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(finish_, FINAL)
