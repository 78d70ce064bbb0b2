"""Suffix-array dedup: removal of every byte inside a ``length``-byte string that starts twice.

Every window of ``length`` bytes has a key, the smallest hash of its ``GRAM``-byte substrings. Runs
of windows whose key is the same substring at the same place are segments, some ``length`` windows
at most. Equal windows have equal keys in segments of their own, so only segments with a key that
another segment has can hold repeats. The steps:

1. Keys are counted in packed form; those of more than one segment set a filter of bounded size.
2. The segments that pass it are written with a hash of their bytes. Segments of equal key, bytes' hash
   and size repeat wholly; that is decided by these two 64-bit hashes.
3. Of the other keys with different segments, one segment of each content goes, with its bytes, to
   shards of whole key groups. A shard leaves out windows whose hash is alone, builds an enhanced suffix
   array (prefix doubling, common prefixes, preceding bytes), scans it with a stack for the tree of
   common-prefix intervals and keeps those with different preceding bytes: the maximal repeats with
   all their occurrences. What these cover is found by comparing bytes.
4. A key group of more than ``GROUP`` contents, which could outgrow a shard, is made smaller first. Hashes
   of its windows are counted in packed form over all tasks, and windows whose hash is alone are left
   out by a filter of bounded size, as a shard would do. What is then still larger is split by longer
   keys: the windows that hold at least half of what is missing behind the key's substring take these
   bytes into their key, the others those before it. Equal windows still have equal keys. Contents that
   have become equal repeat wholly, and one of them goes on. Groups that are still too large are split
   again; after eight rounds at most the key is the whole window.
5. The covered spans of each document are merged and cut out.

Texts are UTF-8 bytes and repeats never cross documents. Defined results: null or empty text has no
byte; a text shorter than ``length`` keeps all; a very long text is cut into segments like any other;
repeated rows repeat each other wholly; rows with equal ids and different texts are told apart by a hash
of the text; an empty table gives an empty result; other columns are not looked at. Kept bytes may be
cut inside a character (``cut_out`` returns them as binary).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, read, slices, small_batches
from .packed import bitmap, bitmap_bits, bucket_count, counts, in_bitmap

LENGTH = 200
GRAM = 64
SHARD_BYTES = 2_000_000
#: Contents of a key that fit into a shard; one has less than two windows' bytes.
GROUP = SHARD_BYTES // (2 * LENGTH)
#: Bytes of the list of segments to fetch that is broadcast; beyond it the texts are shuffled.
BROADCAST_BYTES = 64_000_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def rolling(data: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of every ``size``-byte substring, by doubling."""
    cur, have, out, done, n = _TABLE[data], 1, None, 0, len(data)
    with np.errstate(over="ignore"):
        for bit in bin(size)[:1:-1]:
            if bit == "1":
                m = n - (done + have) + 1
                out = cur[:m] if out is None else out[:m] * np.uint64(pow(base, have, 1 << 64)) + cur[done : done + m]
                done += have
            if done < size:
                m = n - 2 * have + 1
                cur = cur[:m] * np.uint64(pow(base, have, 1 << 64)) + cur[have : have + m]
                have *= 2
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, key, hash of the bytes) of the segments of all texts."""
    number = [i for i, t in enumerate(texts) if len(t) >= length]
    if not number:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    size = np.array([len(texts[i]) for i in number])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts[i] for i in number), np.uint8)
    gram = min(GRAM, length)
    h = rolling(data, gram)
    key = _smallest(h, length - gram + 1)
    windows = size - length + 1
    pos = np.arange(int(windows.sum())) + np.repeat(start - np.cumsum(windows) + windows, windows)
    k = key[pos]
    # a window that begins with its smallest substring is the last one that holds this occurrence
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (pos[1:] != pos[:-1] + 1) | (h[pos[:-1]] == k[:-1])])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(pos)))
    lo, owner = pos[first], np.searchsorted(start, pos[first], side="right") - 1
    with np.errstate(over="ignore"):
        # prefix sums of byte values times powers; a difference times the inverse power is a hash of the bytes between
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), _BASE, np.uint64)]))
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)]))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[:-1], dtype=np.uint64)])
        content = (upto[lo + count + length - 1] - upto[lo]) * inverse[lo]
        content = (content ^ (content >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.array(number)[owner], lo - start[owner], count, k[first], content ^ (content >> np.uint64(29))


def suffix_order(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of each suffix that stops at its ``end``; suffixes of different texts never tie.

    Prefix doubling from eight bytes on. A rank is the place of its tie group, so only tied suffixes
    are sorted again.
    """
    n = len(data)
    left = np.minimum(end - np.arange(n), 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        byte = padded[j : j + n].astype(np.uint64)
        word = word << np.uint64(8) | np.where(left > j, byte, np.uint64(0))
    order = np.lexsort((left, word))
    fresh = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (left[order][1:] != left[order][:-1])])
    head = np.flatnonzero(fresh)
    group = np.repeat(head, np.diff(np.append(head, n)))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = order[np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n)))]
    have = 8
    while len(tied):
        after = tied + have
        inside = after < end[tied]
        # what has ended comes first, told apart by where it ends
        second = np.where(inside, rank[np.minimum(after, n - 1)] + n + 1, end[tied])
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        old = rank[tied]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        head = np.flatnonzero(fresh)
        width = np.diff(np.append(head, len(tied)))
        base = np.flatnonzero(new_group)
        offset = np.repeat(head, width) - np.repeat(base, np.diff(np.append(base, len(tied))))
        rank[tied] = old + offset
        tied = tied[np.repeat(width > 1, width)]
        have *= 2
    return rank


def common_prefixes(data: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    most = np.minimum(end[a] - a, end[b] - b)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    at = 0
    while len(live):
        x, y = np.minimum(a[live] + at, len(data)), np.minimum(b[live] + at, len(data))
        same = word[x] == word[y]
        whole = same.all(axis=1)
        out[live] = np.minimum(at + np.where(whole, 8, same.argmin(axis=1)), most[live])
        live = live[whole & (out[live] < most[live])]
        at += 8
    return out


def repeat_intervals(common: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats in suffix order.

    ``common[i]`` is the common prefix of suffixes i and i + 1, ``before`` the symbol that precedes
    each suffix (a negative one differs from every other). A stack holds the open intervals of the
    common-prefix tree; each carries its preceding symbol, or -1 once two differ.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, first, preceding symbol
    values, symbols = common.tolist(), before.tolist()
    if not symbols:
        return out
    for i, value in enumerate([*values, 0]):
        first, symbol = i, symbols[i]
        if value < least:
            value = 0
        while stack and stack[-1][0] > value:
            top = stack.pop()
            top[2] = top[2] if top[2] == symbol and symbol >= 0 else -1
            if top[2] < 0:
                out.append((top[0], top[1], i))
            first, symbol = top[1], top[2]
        if stack and stack[-1][0] == value:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol and symbol >= 0 else -1
        elif value:
            stack.append([value, first, symbol])
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text number, start)]) of every maximal repeat of at least ``least`` bytes."""
    sa, common, before, owner, start = _enhanced(texts, least)
    return [(size, [(int(owner[p]), int(p - start[owner[p]])) for p in sa[a : b + 1]]) for size, a, b in repeat_intervals(common, before, least)]


def _enhanced(texts: list[bytes], least: int):
    """Suffix array of the places with ``least`` bytes left, their common prefixes and preceding bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size)
    end = (start + size)[owner] if len(data) else np.zeros(0, np.int64)
    rank = suffix_order(data, end)
    sa = np.empty(len(data), np.int64)
    sa[rank] = np.arange(len(data))
    sa = sa[end[sa] - sa >= least]
    common = common_prefixes(data, end, sa[:-1], sa[1:]) if len(sa) > 1 else np.zeros(0, np.int64)
    before = np.where(sa > start[owner[sa]], data[np.maximum(sa - 1, 0)].astype(np.int64), -1 - sa) if len(sa) else sa
    return sa, common, before, owner, start


def covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the mask of bytes inside maximal repeats of at least ``length`` bytes."""
    sa, common, before, owner, start = _enhanced(texts, length)
    reach = np.zeros(len(sa), np.int64)
    for size, a, b in sorted(repeat_intervals(common, before, length)):  # the longest of nested ones last
        reach[a : b + 1] = size
    edge = np.zeros(len(owner) + 1, np.int32)
    np.add.at(edge, sa[reach > 0], 1)
    np.add.at(edge, (sa + reach)[reach > 0], -1)
    mask = np.cumsum(edge)[:-1] > 0
    return [mask[s : s + len(t)] for s, t in zip(start.tolist(), texts, strict=True)]


def repeated_runs(texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(text number, start, end) of the runs of windows whose hash another window has: what else there
    is cannot repeat, and need not be sorted. Runs of a text overlap in less than ``length`` bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        return []
    pos = np.arange(int(windows.sum())) + np.repeat(start - np.cumsum(windows) + windows, windows)
    h = rolling(data, length)[pos]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(pos), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first = np.concatenate([[True], pos[1:] != pos[:-1] + 1])  # of a text's windows
    last = np.append(first[1:], True)
    lo = pos[again & (first | ~np.concatenate([[False], again[:-1]]))]
    hi = pos[again & (last | ~np.append(again[1:], False))] + length
    owner = np.searchsorted(start, lo, side="right") - 1
    return list(zip(owner.tolist(), (lo - start[owner]).tolist(), (hi - start[owner]).tolist(), strict=True))


def _spans(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def _raw(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in b.column("text").to_pylist()]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(d, t, s, e): covered byte spans; d and t are the id and the hash of the text."""
    with small_batches(docs.sparkSession):
        whole, parts, found = _segment_parts(_keyed(docs, text_col, id_col), length, group)
        out = whole.unionByName(_covered_spans(parts, length))
        return out if found is None else out.unionByName(found)


def repeat_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(size, occurrences): the groups of maximal repeats that the shards' trees give, as arrays of (d, t, s).

    A shard holds one segment for each content, so an occurrence stands for all copies of its segment.
    A repeat that is longer than a segment shows as one group for each key inside it.
    """
    with small_batches(docs.sparkSession):
        _, parts, _ = _segment_parts(_keyed(docs, text_col, id_col), length, group)

    def groups(table: pa.Table) -> pa.Table:
        d, t, lo = (table.column(c).to_pylist() for c in ("d", "t", "lo"))
        found = maximal_repeats(table.column("bytes").to_pylist(), length)
        places = [[{"d": d[i], "t": t[i], "s": lo[i] + at} for i, at in sorted(own)] for _, own in found]
        return pa.table({"size": pa.array([n for n, _ in found], pa.int32()), "occurrences": pa.array(places, pa.list_(pa.struct([("d", pa.int64()), ("t", pa.int64()), ("s", pa.int32())])))})

    return _in_shards(parts, groups, "size int, occurrences array<struct<d:long,t:long,s:int>>")


_PART = [("d", pa.int64()), ("t", pa.int64()), ("lo", pa.int32()), ("key", pa.int64()), ("open", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())]
_PART_DDL = "d long, t long, lo int, key long, open boolean, large boolean, bytes binary"


def _segment_parts(keyed: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(spans of segments that repeat wholly, segments to compare in groups of bounded size, spans found
    while large groups were split)."""
    spark = keyed.sparkSession
    buckets = bucket_count(keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in slices(batches):
            yield segments(_raw(b), length)[3]

    often = materialise(counts(keyed.select("text"), keys_of, buckets, 64, 1).select("token"), "repeated-keys")
    again = spark.sparkContext.broadcast(bitmap(often, "token", bitmap_bits(often.count(), 128, 30)))
    discard(often)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            number, lo, count, key, content = segments(_raw(b), length)
            keep = in_bitmap(again.value, key)
            number, lo, count, key, content = (x[keep] for x in (number, lo, count, key, content))
            cols = [b.column("d").take(pa.array(number)), b.column("t").take(pa.array(number)), pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["d", "t", "lo", "w", "key", "content"])

    found = materialise(keyed.mapInArrow(listed, "d long, t long, lo int, w int, key long, content long"), "segments")
    same = ["key", "content", "w"]
    contents = materialise(found.groupBy(same).agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo")).alias("first")), "contents")
    whole = found.join(contents.where("n > 1").select(same), same).select("d", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("w") + (length - 1)).alias("e"))
    sizes = contents.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    bits = (4 * length + 3).bit_length()  # a place, its windows and two flags in one number
    place = F.col("lo").cast("long") * (1 << bits) + F.col("w") * 4 + (F.col("n") == 1).cast("int") * 2 + (F.col("g") > group).cast("int")
    wanted = contents.join(sizes, "key").select("first.d", "first.t", "first.lo", "w", "n", "g", "key").select("d", "t", F.array(place, "key").alias("x"))
    # a document's list of segments is bounded by its length
    wanted = materialise(wanted.groupBy("d", "t").agg(F.flatten(F.collect_list("x")).alias("want")), "wanted")
    n_docs, n_values = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("want")), F.lit(0))).first()
    few = 64 * n_docs + 8 * n_values <= BROADCAST_BYTES

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for d, t, raw, want in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), _raw(b), b.column("want").to_pylist(), strict=True):
                for x, key in zip(want[::2], want[1::2], strict=True):
                    lo, w = x >> bits, (x & (1 << bits) - 1) >> 2
                    rows.append((d, t, lo, key, bool(x & 2), bool(x & 1), raw[lo : lo + w + length - 1]))
            yield _batch(rows, _PART)

    distinct = keyed if few else keyed.repartition("d", "t")
    parts = materialise(distinct.join(F.broadcast(wanted) if few else wanted, ["d", "t"]).mapInArrow(fetch, _PART_DDL), "segment-bytes")
    small, large = parts.where("not large"), parts.where("large")
    if not large.head(1):
        return whole, small, None
    more, spans = split_large(large, length, group)
    return whole, small.unionByName(more), spans


def _grown(raw: bytes, at: int, size: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, windows, place and size of the longer common part) of the halves of a segment whose
    windows all hold ``raw[at : at + size]``."""
    windows, rest = len(raw) - length + 1, length - size
    behind = -(-rest // 2)
    cut = min(max(at - (rest - behind), 0), windows)  # windows from here on have that much behind the part
    out = [(0, cut, at - (rest - behind + 1), size + rest - behind + 1)] if cut else []
    return out + ([(cut, windows - cut, at, size + behind)] if cut < windows else [])


def repeated_windows(parts: DataFrame, length: int) -> DataFrame:
    """The segments cut down to their windows whose hash another window has; a filter of bounded size
    tells, so some others stay. Copies that repeat wholly are elsewhere: one of each is here."""
    spark = parts.sparkSession

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in slices(batches):
            for raw in b.column("bytes").to_pylist():
                yield rolling(np.frombuffer(raw, np.uint8), length)

    size = parts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    often = materialise(counts(parts.select("bytes"), hashes_of, bucket_count(size), 64, 1).select("token"), "window-hashes")
    again = spark.sparkContext.broadcast(bitmap(often, "token", bitmap_bits(often.count(), 128, 30)))
    discard(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for d, t, lo, key, is_open, raw in zip(*(b.column(c).to_pylist() for c in ("d", "t", "lo", "key", "open", "bytes")), strict=True):
                keep = in_bitmap(again.value, rolling(np.frombuffer(raw, np.uint8), length))
                rows += [(d, t, lo + s, key, is_open, True, raw[s : e + length - 1]) for s, e in _spans(keep).tolist()]
            yield _batch(rows, _PART)

    return parts.select("d", "t", "lo", "key", "open", "bytes").mapInArrow(run, _PART_DDL)


def split_large(parts: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(segments in groups of at most ``group`` contents, whole spans that repeat) of segments in larger ones."""
    gram = min(GRAM, length)
    kinds = [("d", pa.int64()), ("t", pa.int64()), ("lo", pa.int32()), ("key", pa.int64()), ("open", pa.bool_()), ("at", pa.int32()), ("size", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("bytes", pa.binary())]
    ddl = "d long, t long, lo int, key long, open boolean, at int, size int, c1 long, c2 long, bytes binary"

    def content(raw: bytes) -> tuple[int, int]:
        c = xxhash.xxh3_128_intdigest(raw)
        return (c >> 64) - (1 << 63), (c & _MASK) - (1 << 63)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for r in b.to_pylist():
                windows = len(r["bytes"]) - length + 1
                h = rolling(np.frombuffer(r["bytes"], np.uint8), gram)[windows - 1 :]
                at = windows - 1 + int(np.argmax(h == np.uint64(r["key"] % (1 << 64))))
                rows.append((r["d"], r["t"], r["lo"], r["key"], r["open"], at, gram, *content(r["bytes"]), r["bytes"]))
            yield _batch(rows, kinds)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for r in b.to_pylist():
                for first, windows, at, size in _grown(r["bytes"], r["at"], r["size"], length):
                    raw = r["bytes"][first : first + windows + length - 1]
                    key = xxhash.xxh3_64_intdigest(raw[at - first : at - first + size], 2 * size + (at == r["at"])) - (1 << 63)
                    rows.append((r["d"], r["t"], r["lo"] + first, key, r["open"], at - first, size, *content(raw), raw))
            yield _batch(rows, kinds)

    rows = repeated_windows(parts, length).mapInArrow(located, ddl)
    done = spans = None
    own = ["key", "c1", "c2"]
    while True:
        sub = materialise(rows, "parts-of-large")
        same = materialise(sub.groupBy(own).agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo")).alias("first")), "part-contents")
        again = sub.where("open").join(same.where("n > 1").select(own), own)
        again = again.select("d", "t", F.col("lo").alias("s"), (F.col("lo") + F.octet_length("bytes")).cast("int").alias("e"))
        groups = materialise(same.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), "part-groups")
        kept = sub.join(same, own).where(F.struct("d", "t", "lo") == F.col("first")).withColumn("open", F.col("open") & (F.col("n") == 1)).drop("n", "first")
        kept = materialise(kept.join(groups, "key"), "kept-parts")
        more = kept.where(F.col("g") <= group).select("d", "t", "lo", "key", "open", F.lit(False).alias("large"), "bytes")
        done = more if done is None else done.unionByName(more)
        spans = again if spans is None else spans.unionByName(again)
        large = kept.where(F.col("g") > group).select("d", "t", "lo", "open", "bytes", "at", "size")
        if not large.head(1):
            return done, spans
        rows = large.mapInArrow(halves, ddl)


def _in_shards(parts: DataFrame, of_shard, schema: str) -> DataFrame:
    total = parts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / SHARD_BYTES))
    return parts.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(lambda t: of_shard(t), schema)


def _covered_spans(parts: DataFrame, length: int) -> DataFrame:
    def shard(table: pa.Table) -> pa.Table:
        rows = []
        open_, lo = table.column("open").to_pylist(), table.column("lo").to_pylist()
        texts = table.column("bytes").to_pylist()
        runs = repeated_runs(texts, length)
        for (i, at, _), mask in zip(runs, covered([texts[i][a:b] for i, a, b in runs], length), strict=True):
            if open_[i]:
                rows += [(i, lo[i] + at + s, lo[i] + at + e) for s, e in _spans(mask).tolist()]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"d": table.column("d").take(at), "t": table.column("t").take(at), "s": pa.array([r[1] for r in rows], pa.int32()), "e": pa.array([r[2] for r in rows], pa.int32())})

    return _in_shards(parts, shard, "d long, t long, s int, e int")


def _merged(spans: list[dict], size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    if spans:
        np.add.at(edge, [x["s"] for x in spans], 1)
        np.add.at(edge, [x["e"] for x in spans], -1)
    return np.cumsum(edge)[:-1] > 0


def cut_out(docs: DataFrame, spans: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row, with ``kept`` on request."""
    lists = spans.distinct().groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = _keyed(docs, text_col, id_col).withColumn("id", F.when(F.col("d") != F.lit(-(1 << 63)), F.col("d"))).join(lists, ["d", "t"], "left")
    kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * keep_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for ident, raw, own in zip(b.column("id").to_pylist(), _raw(b), b.column("spans").to_pylist(), strict=True):
                mask = _merged(own or [], len(raw))
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if own else raw
                out.append((ident, len(raw), len(raw) - len(kept), len(_spans(mask)), hashlib.sha256(kept).hexdigest(), kept))
            yield _batch(out, kinds)

    return rows.select("id", "text", "spans").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def op10_suffix_array_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_out(docs, repeated_spans(docs)).withColumnRenamed("id", "doc_id")
