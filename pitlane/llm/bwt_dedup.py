"""Repeated substrings across documents by merging Burrows-Wheeler transforms.

A byte of a document is removed if a ``length``-byte string covers it that also starts in a
document with a smaller doc_id. Strings are judged on the input; matches never cross documents.

1. Texts are dealt to shards. Every window of ``length`` bytes has a minimizer, the least hash of its
   ``KMER``-byte substrings, and equal windows have equal minimizers. Shards send each distinct
   minimizer to its bucket, which answers which of them occur in several documents.
   All other windows are unique and go no further.
2. Shards send the strings around the remaining minimizers (runs of windows that share one; each
   distinct string once, with its least doc_id) to the minimizer's bucket. A minimizer with very many
   strings is split: its windows travel on their own, dealt by their own hash.
3. A bucket holds strings of many shards. It builds the Burrows-Wheeler transform of each shard's
   slice and merges them by interleave refinement: the interleave (which slice each merged suffix
   comes from) starts in slice order and is stable-sorted by the next transform symbols, once for each
   of ``length`` symbols, ending sooner when no block splits any more. A boundary that first
   shows in round k marks a common prefix of k - 1 bytes, so blocks after the last round are
   the intervals of suffixes that agree on ``length`` bytes. The merge sorts no suffix again. Strings whose minimizer no
   other distinct string shares have nothing to interleave with and skip the merge.
   Every interval yields the least doc_id of its windows, which goes back to the shards.
4. Shards mark the windows with an answer below their own doc_id and cut the bytes out.

Groups of copies meet only as one string per shard. Bucket sizes follow from the bytes a bucket is given, not
from how often a text is repeated.

Null text is empty; a null doc_id counts as smaller than all others; rows with equal doc_ids do
not remove from each other. Texts shorter than ``length`` bytes are kept. Empty tables give no rows.
Other columns are passed through by ``remove_repeats`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pitlane.llm.common import distinct, groups_for, nullable, text_bytes, whole_row

KMER = 24  # a multiple of eight
SLICES = 8  # transforms that a bucket merges
NO_DOC = np.iinfo(np.int64).min  # stands for a null doc_id
NOBODY = np.iinfo(np.int64).max
ROWS = "bucket int, shard int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: the number of bytes of each, then their bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    """The arrays that ``pack`` was given."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.frombuffer(data, t, int(s) // np.dtype(t).itemsize, int(e - s)) for s, e, t in zip(sizes, ends, types, strict=True)]


def out(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int32()), "data": pa.array(cols[2], pa.binary())})


class Shard:
    """The documents of one shard, in a fixed order, as one byte array."""

    def __init__(self, table: pa.Table, length: int):
        table = table.combine_chunks()
        self.number = table.column("shard")[0].as_py()
        texts = [x or b"" for x in table.column("text").to_pylist()]
        ids = [NO_DOC if x is None else x for x in table.column("doc_id").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.table, self.length = table, length
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.sizes = np.array(list(map(len, self.texts)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one minimizer: start, number of windows, minimizer, document.

        Documents are taken in blocks, so the work space doesn't grow with the shard.
        """
        found = []
        n = self.length
        step = 1 << 20
        for lo in range(0, max(0, len(self.bytes) - n + 1), step):
            m = sliding_min(kmer_hashes(self.bytes[lo : lo + step + n - 1]), n - KMER + 1)
            end = lo + len(m)
            # the block's documents, and in each the windows that end inside it
            a, z = np.searchsorted(self.starts, (lo, end - 1), side="right") - 1
            begin = np.maximum(self.starts[a : z + 1], lo)
            last = np.clip(self.starts[a : z + 1] + self.sizes[a : z + 1] - n + 1, begin, end)
            new = np.empty(len(m) + 1, bool)
            new[1:-1] = m[1:] != m[:-1]
            new[begin - lo] = new[last - lo] = new[-1] = True
            first = np.flatnonzero(new)
            size, first = np.diff(first), first[:-1]
            d = np.searchsorted(begin, first + lo, side="right") - 1
            ok = first + lo < last[d]
            found.append((first[ok] + lo, size[ok], m[first[ok]], d[ok] + a))
        if not found:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KMER bytes from each position on."""
    a = data.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    a = a[:-4] | a[4:] << np.uint64(32)
    n = len(data) - KMER + 1
    h = a[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(8, KMER, 8):
        h ^= h >> np.uint64(29)
        h += a[i : i + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each position on, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def strings_of(shard: Shard, hot: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """What a shard sends: (start, windows, key, bucket, document run) per run, hot runs window by window."""
    cool = ~hot
    each = np.where(hot, windows, 1)
    run = np.repeat(np.arange(len(start)), each)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
    s = start[run] + np.where(hot[run], nth, 0)
    w = np.where(hot[run], 1, windows[run])
    k = key[run].copy()
    if not cool.all():
        own = hot[run]
        k[own] = window_hashes(shard.bytes, s[own], shard.length)
    return s, w, k, (k % np.uint64(buckets)).astype(np.int64), run


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window at each start."""
    out_, raw = np.empty(len(starts), np.uint64), data.tobytes()
    for i, s in enumerate(starts.tolist()):
        out_[i] = int.from_bytes(hashlib.blake2b(raw[s : s + length], digest_size=8).digest(), "little")
    return out_


def ask_minimizers(table: pa.Table, length: int, buckets: int) -> pa.Table:
    """Step 1, shard side: distinct minimizers, whether several documents share them here, and their strings."""
    shard = Shard(table, length)
    start, windows, key, doc = shard.runs()
    if not len(start):
        return out([])
    order = np.lexsort((doc, key, key % np.uint64(buckets)))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    many = np.minimum(np.diff(np.append(first, len(key))), 65535).astype(np.uint16)
    ids = shard.ids[doc]
    shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    k = key[first]
    b = (k % np.uint64(buckets)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    rest = (k // np.uint64(buckets)).astype(np.uint32)
    rows = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows.append((int(b[lo]), shard.number, pack(rest[lo:hi], many[lo:hi], np.packbits(shared[lo:hi]))))
    return out(rows)


def answer_minimizers(table: pa.Table, hot_strings: int) -> pa.Table:
    """Step 1, bucket side: 0 unique, 1 shared, 2 shared by very many strings; for each asked minimizer."""
    asked = [(s, unpack(d, "<u4", "<u2", "u1")) for s, d in zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True)]
    flat = np.concatenate([a[0] for _, a in asked])
    many = np.concatenate([a[1] for _, a in asked]).astype(np.int64)
    shared = np.concatenate([np.unpackbits(a[2], count=len(a[0])) for _, a in asked]).astype(bool)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, many)
    flag = np.where((times > 1) | np.bincount(inverse, shared).astype(bool), np.where(total > hot_strings, 2, 1), 0).astype(np.uint8)
    reply, at, rows = flag[inverse], 0, []
    bucket = table.column("bucket")[0].as_py()
    for s, a in asked:
        mine = reply[at : at + len(a[0])]
        at += len(a[0])
        # two bits a minimizer
        rows.append((bucket, s, pack(np.packbits(mine & 1), np.packbits(mine >> 1))))
    return out(rows)


def candidates(shard: Shard, answers: pa.Table, buckets: int) -> tuple[np.ndarray, ...] | None:
    """The runs whose minimizer is shared, as the strings to send, from the bucket's answers."""
    start, windows, key, doc = shard.runs()
    if not len(start):
        return None
    unique = distinct(key)
    b = (unique % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((unique, b))
    flags = np.zeros(len(unique), np.uint8)
    cuts = {int(x): (int(lo), int(hi)) for x, lo, hi in zip(*_cuts(b[order]), strict=True)}
    for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        lo, hi = cuts[bucket]
        low, high = unpack(data, "u1", "u1")
        flags[order[lo:hi]] = np.unpackbits(low, count=hi - lo) | np.unpackbits(high, count=hi - lo) << 1
    flag = flags[np.searchsorted(unique, key)]
    live = flag > 0
    if not live.any():
        return None
    s, w, k, bk, run = strings_of(shard, flag[live] == 2, start[live], windows[live], key[live], buckets)
    return s, w, k, bk, doc[live][run]


def _cuts(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[first], first, np.append(first[1:], len(sorted_values))


def distinct_strings(shard: Shard, found: tuple[np.ndarray, ...]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings by bucket: text, which string each run is, and by string: bucket, key, least doc_id."""
    s, w, k, b, doc = found
    raw, number = shard.bytes.tobytes(), {}
    ends = s + w + shard.length - 1
    which = np.fromiter((number.setdefault(raw[x:y], len(number)) for x, y in zip(s.tolist(), ends.tolist(), strict=True)), np.int64, len(s))
    least = np.full(len(number), NOBODY)
    np.minimum.at(least, which, shard.ids[doc])
    bucket, key = np.empty(len(number), np.int64), np.empty(len(number), np.uint64)
    bucket[which], key[which] = b, k
    return list(number), which, bucket, key, least


def send_strings(left: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """Step 2, shard side."""
    if not left.num_rows:
        return out([])
    shard = Shard(left, length)
    found = candidates(shard, answers, buckets)
    if found is None:
        return out([])
    texts, _, bucket, key, least = distinct_strings(shard, found)
    order = np.argsort(bucket, kind="stable")
    rows = []
    for b, lo, hi in zip(*_cuts(bucket[order]), strict=True):
        mine = order[lo:hi]
        body = b"".join(texts[i] for i in mine.tolist())
        sizes = np.array([len(texts[i]) for i in mine.tolist()], "<u4")
        # 32 bits of the key tell strings apart that can't meet; more that seem to meet do no harm
        rows.append((int(b), shard.number, pack(np.frombuffer(body, np.uint8), sizes, (key[mine] >> np.uint64(32)).astype("<u4"), least[mine])))
    return out(rows)


def slice_transform(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order to ``length`` symbols and the Burrows-Wheeler transform of one slice's strings.

    ``symbols`` holds the strings, each ended by 0; other symbols are above 0.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length)[:n].copy()
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the string's end
    view[np.arange(length) >= left[:, None]] = 0
    order = np.argsort(view.view(f"S{length}").ravel(), kind="stable")
    return order, symbols[order - 1]


def merge_transforms(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms by the first ``length`` symbols of their suffixes, and common prefixes.

    Returns for every merged place its suffix (counted through the slices in order), and the
    length of the prefix that it shares with the place before it (``length`` if that or longer).
    """
    flat = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), list(map(len, transforms)))
    n = len(flat)
    common = np.full(n, length, np.int64)
    common[0] = 0
    block = np.zeros(n, np.int32)
    blocks = 1
    for k in range(length):
        # the j-th place of a slice reads the j-th symbol of its transform
        places = np.argsort(source, kind="stable")
        symbol = np.empty(n, np.uint8)
        symbol[places] = flat
        order = np.argsort(symbol, kind="stable")
        source, symbol, was = source[order], symbol[order], block[order]
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        common[cut & (common == length)] = k
        block = np.cumsum(cut, dtype=np.int32) - 1
        if block[-1] + 1 == blocks:  # no block was split, so none will be
            break
        blocks = block[-1] + 1
    merged = np.empty(n, np.int64)
    merged[np.argsort(source, kind="stable")] = np.arange(n)
    return merged, common


def repeated_intervals(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave's intervals that agree on ``length`` symbols and hold several suffixes.

    The same refinement as ``merge_transforms``, two symbols a round, on what can still matter: a block of one
    suffix stays alone, and so do the suffixes before it; a prefix that reaches its string's end is no
    window, nor are those before it. Both leave. Returns the suffixes, interval by interval, and the intervals' numbers.
    """
    flat = np.concatenate(transforms)
    before = np.empty(len(flat), np.int32)  # the suffix one symbol to the left
    at = 0
    for t in transforms:
        before[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        at += len(t)
    pair = flat[before].astype(np.uint16) << 8 | flat  # two symbols to the left, then one
    ended = (flat == 0) | (flat[before] == 0)
    twice = before[before]
    alive, block = np.arange(len(flat), dtype=np.int32), np.zeros(len(flat), np.int32)
    for k in [1] * (length % 2) + [2] * (length // 2):
        symbol, step, stop = (pair, twice, ended) if k == 2 else (flat, before, flat == 0)
        go = ~stop[alive]
        alive, block = alive[go], block[go]
        s = symbol[alive]
        order = np.argsort(s, kind="stable")
        s, block, alive = s[order], block[order], step[alive[order]]
        cut = np.empty(len(s) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        more = ~(cut[:-1] & cut[1:])
        block = np.cumsum(cut[:-1], dtype=np.int32)[more]
        alive = alive[more]
    return alive, block


def least_documents(texts: list[bytes], slices: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, string by string, the least document of all strings that hold the same window.

    Returns them in one array, and where each string's windows end.
    """
    order = np.argsort(slices, kind="stable")
    sizes = np.fromiter((len(texts[i]) + 1 for i in order.tolist()), np.int64, len(texts))
    # UTF-8 never holds FF: the end of a string becomes 0
    symbols = np.frombuffer(b"\xff".join([*(texts[i] for i in order.tolist()), b""]), np.uint8) + np.uint8(1)
    ends = np.cumsum(sizes)
    transforms, places = [], []
    for _, lo, hi in zip(*_cuts(slices[order]), strict=True):
        a, z = ends[lo] - sizes[lo], ends[hi - 1]
        suffixes, transform = slice_transform(symbols[a:z], length)
        transforms.append(transform)
        places.append(suffixes + a)
    alive, block = repeated_intervals(transforms, length)
    place = np.concatenate(places)[alive]
    owner = np.repeat(least[order], sizes)
    answer = owner.copy()
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        answer[place] = np.repeat(np.minimum.reduceat(owner[place], first), np.diff(np.append(first, len(place))))
    # back to the order of the strings, windows only
    count = np.maximum(sizes - length, 0)
    back = np.argsort(order)
    begin, n = (ends - sizes)[back], count[back]
    stop = np.cumsum(n)
    return answer[np.repeat(begin - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], stop


def answer_strings(table: pa.Table, length: int) -> pa.Table:
    """Step 3: for each string that a shard sent, runs of windows with one least document."""
    bucket = table.column("bucket")[0].as_py()
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True))
    number: dict[bytes, int] = {}
    least, key, source, sent = [], [], [], []
    for shard, data in rows:
        body, sizes, keys, docs = unpack(data, "u1", "<u4", "<u4", "<i8")
        raw, ends = body.tobytes(), np.cumsum(sizes, dtype=np.int64)
        mine = []
        for lo, hi, k, d in zip((ends - sizes).tolist(), ends.tolist(), keys.tolist(), docs.tolist(), strict=True):
            i = number.setdefault(raw[lo:hi], len(number))
            if i == len(least):
                least.append(d)
                key.append(k)
                source.append(shard % SLICES)
            elif d < least[i]:
                least[i] = d
            mine.append(i)
        sent.append((shard, np.array(mine)))
    texts = list(number)
    least, key, source = np.array(least, np.int64), np.array(key), np.array(source)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    met = times[inverse] > 1
    # runs (first window, last window + 1, least document), string by string; one run where no other string meets it
    windows = np.array([len(t) - length + 1 for t in texts], np.int64)
    runs = np.stack([np.zeros(len(texts), np.int64), windows, least], axis=1)
    of = np.arange(len(texts))
    if met.any():
        ids = np.flatnonzero(met)
        docs, stop = least_documents([texts[i] for i in ids.tolist()], source[ids], least[ids], length)
        new = np.concatenate([[True], docs[1:] != docs[:-1]])
        new[stop[:-1]] = True
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(docs))
        string = np.searchsorted(stop, lo, side="right")
        base = (stop - windows[ids])[string]
        of = np.concatenate([of[~met], ids[string]])
        order = np.argsort(of, kind="stable")
        runs = np.concatenate([runs[~met], np.stack([lo - base, hi - base, docs[lo]], axis=1)])[order]
        of = of[order]
    count = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(count) - count
    replies = []
    for shard, mine in sent:
        n = count[mine]
        at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        replies.append((bucket, shard, pack(n.astype("<i8"), runs[at])))
    return out(replies)


def removed_spans(left: pa.Table, right: pa.Table, length: int, buckets: int) -> tuple[Shard, list[list[tuple[int, int]]]]:
    """Step 4: the merged removed spans of each of the shard's documents."""
    shard = Shard(left, length)
    spans: list[list[tuple[int, int]]] = [[] for _ in shard.texts]
    first = right.filter(pc.equal(right.column("kind"), 1))
    found = candidates(shard, first, buckets)
    if found is None:
        return shard, spans
    _, which, bucket, _, _ = distinct_strings(shard, found)
    order = np.argsort(bucket, kind="stable")
    cuts = {int(b): order[lo:hi] for b, lo, hi in zip(*_cuts(bucket[order]), strict=True)}
    at, n = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    parts, total = [], 0
    second = right.filter(pc.equal(right.column("kind"), 2))
    for b, data in zip(second.column("bucket").to_pylist(), second.column("data").to_pylist(), strict=True):
        count, runs = unpack(data, "<i8", "<i8")
        n[cuts[b]], at[cuts[b]] = count, total + np.cumsum(count) - count
        parts.append(runs.reshape(-1, 3))
        total += len(parts[-1])
    runs = np.concatenate(parts)
    start, _, _, _, doc = found
    each = n[which]
    run = np.repeat(np.arange(len(start)), each)
    i = at[which][run] + np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
    hit = runs[i, 2] < shard.ids[doc[run]]
    run, i = run[hit], i[hit]
    # covered bytes: from the first window's start to the last window's end
    lo, hi, d = start[run] + runs[i, 0], start[run] + runs[i, 1] - 1 + length, doc[run]
    order = np.lexsort((hi, lo))
    for a, z, k in zip(lo[order].tolist(), hi[order].tolist(), d[order].tolist(), strict=True):
        base, mine = int(shard.starts[k]), spans[k]
        a, z = a - base, z - base
        if mine and a <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(z, mine[-1][1]))
        else:
            mine.append((a, z))
    return shard, spans


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cut."""
    done = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            done.append((a, b))
    return done


def _solve(docs: DataFrame, columns: list[str], make, schema: str | T.StructType, length: int, shard_bytes: int, bucket_bytes: int, hot_strings: int) -> DataFrame:
    total = text_bytes(docs)
    shards, buckets = groups_for(total, shard_bytes, 8), groups_for(total, bucket_bytes, 64)
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *columns)
    by_shard = texts.groupBy("shard")

    def ask(t: pa.Table) -> pa.Table:
        return ask_minimizers(t, length, buckets)

    def answer(t: pa.Table) -> pa.Table:
        return answer_minimizers(t, hot_strings)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        return send_strings(left, right, length, buckets)

    def solve(t: pa.Table) -> pa.Table:
        return answer_strings(t, length)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return make(*removed_spans(left, right, length, buckets)) if left.num_rows else make(None, [])

    shared = by_shard.applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(answer, ROWS)
    solved = by_shard.cogroup(shared.groupBy("shard")).applyInArrow(send, ROWS).groupBy("bucket").applyInArrow(solve, ROWS)
    replies = shared.withColumn("kind", F.lit(1)).union(solved.withColumn("kind", F.lit(2)))
    return by_shard.cogroup(replies.groupBy("shard")).applyInArrow(finish, schema)


def repeats(docs: DataFrame, length: int = 50, shard_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20, hot_strings: int = 5000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def make(shard: Shard | None, spans: list) -> pa.Table:
        if shard is None:
            return arrow.empty_table()
        ids = [None if i == NO_DOC else i for i in shard.ids.tolist()]
        return pa.table([
            pa.array(ids, pa.int64()), pa.array(shard.sizes), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(list(map(len, spans)), pa.int64()),
            pa.array([hashlib.sha256(kept(t, s)).hexdigest() for t, s in zip(shard.texts, spans, strict=True)], pa.string()),
        ], schema=arrow)

    return _solve(docs.select("doc_id", "text"), [], make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, shard_bytes, bucket_bytes, hot_strings)


def remove_repeats(docs: DataFrame, length: int = 50, shard_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20, hot_strings: int = 5000) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``.

    Characters that a cut would split are kept whole. Rows that lose their whole text are
    dropped; rows that had none stay as they are. ``n_chars`` follows the text where a text changed.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", whole_row(docs, ("doc_id", "text")).alias("__row") if others else F.lit(None).cast("struct<x:int>").alias("__row"))

    row = nullable(packed.schema["__row"].dataType)
    row_type = to_arrow_type(row)

    def make(shard: Shard | None, spans: list) -> pa.Table:
        if shard is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "__row": pa.array([], row_type), "__cut": pa.array([], pa.bool_())})
        cut = [whole_characters(t, s) for t, s in zip(shard.texts, spans, strict=True)]
        had = [shard.table.column("text")[i].is_valid for i in shard.order]
        text = [kept(t, s).decode() if h else None for t, s, h in zip(shard.texts, cut, had, strict=True)]
        return pa.table({
            "doc_id": pa.array([None if i == NO_DOC else i for i in shard.ids.tolist()], pa.int64()), "text": pa.array(text, pa.string()),
            "__row": shard.table.column("__row").combine_chunks().take(pa.array(shard.order)).cast(row_type), "__cut": pa.array(list(map(bool, cut)), pa.bool_()),
        })

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("__row", row), T.StructField("__cut", T.BooleanType())])
    done = _solve(packed, ["__row"], make, schema, length, shard_bytes, bucket_bytes, hot_strings)
    done = done.filter(~F.col("__cut") | (F.col("text") != ""))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), **{c: F.col(f"__row.`{c}`") for c in others}}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("__cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return done.select(*(new[c].alias(c) for c in names))
