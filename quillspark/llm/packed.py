"""Counting 64-bit tokens in packed form: tasks combine, sort and compress before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a task holds before it combines and sends them.
FLUSH = 500_000


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as compressed differences."""
    d = np.diff(values)
    kind = np.dtype(np.uint32 if not len(d) or int(d.max()) < 1 << 32 else np.uint64)
    head = np.array([len(values), kind.itemsize], np.int64).tobytes() + values[:1].astype(np.uint64).tobytes()
    return head + squeeze(d.astype(kind))


def unpack(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw, np.int64, 2).tolist()
    if not n:
        return np.zeros(0, np.uint64)
    d = spread(raw[24:], n - 1, {4: np.uint32, 8: np.uint64}[size]).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1, 16), d]), dtype=np.uint64)


def squeeze(a: np.ndarray) -> bytes:
    """Any array, byte planes compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def spread(raw: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bucket_count(text_bytes: int) -> int:
    """A power of two that follows the data, so that a bucket's size does not: one for 4 MB of text,
    and from 64 GB on, where a task's packed rows get short, one for up to 64 MB."""
    return 1 << math.ceil(math.log2(max(64, min(text_bytes / 4e6, 16384), text_bytes / 64e6)))


def by_bucket(rows: DataFrame, buckets: int):
    """Rows grouped by bucket, over as many partitions as that needs if the session has fewer."""
    if buckets > 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(buckets // 4, "bucket")
    return rows.groupBy("bucket")


def cut(values: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the filled ranges of sorted tokens of ``bits`` bits."""
    shift = np.uint64(bits - int(math.log2(buckets)))
    place = np.searchsorted(values >> shift, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)) if b > a]


def counts(rows: DataFrame, tokens_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], buckets: int, bits: int, over: int) -> DataFrame:
    """(token, n) of the tokens that occur more than ``over`` times.

    ``tokens_of`` gives arrays of tokens below 2 ** bits for the batches of a task. A token comes to
    its bucket once for each flush of a task, whatever its count.
    """

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        found = [(k, pack(values[a:b]), squeeze(n[a:b].astype(np.uint32))) for k, a, b in cut(values, buckets, bits)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for t in tokens_of(batches):
            parts.append(t)
            held += len(t)
            if held > FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    def merge(table: pa.Table) -> pa.Table:
        values = [unpack(t) for t in table.column("tokens").to_pylist()]
        n = [spread(c, len(v), np.uint32) for c, v in zip(table.column("counts").to_pylist(), values, strict=True)]
        v, c = np.concatenate(values), np.concatenate(n)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        total = np.add.reduceat(c.astype(np.int64), first)
        keep = total > over
        return pa.table({"token": v[first][keep].view(np.int64), "n": total[keep]})

    return by_bucket(rows.mapInArrow(run, "bucket int, tokens binary, counts binary"), buckets).applyInArrow(merge, "token long, n long")


def bitmap(tokens: DataFrame, column: str, bits: int = 27) -> np.ndarray:
    """A table of 2 ** bits bits, set at the upper bits of each 64-bit token: a filter of bounded size
    with false positives. Its 64 slices are made in Spark."""
    slices = 6

    def run(table: pa.Table) -> pa.Table:
        t = table.column("token").to_numpy().view(np.uint64)
        flags = np.zeros(1 << (bits - slices), bool)
        flags[(t >> np.uint64(64 - bits)) & np.uint64(len(flags) - 1)] = True
        return pa.table({"slice": pa.array([int(t[0] >> np.uint64(64 - slices))], pa.int32()), "flags": pa.array([zstandard.compress(np.packbits(flags).tobytes(), 1)], pa.binary())})

    keyed = tokens.select(F.col(column).alias("token"), F.shiftrightunsigned(column, 64 - slices).alias("slice"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = len(out) >> slices
    for k, flags in keyed.groupBy("slice").applyInArrow(lambda t: run(t.select(["token"])), "slice int, flags binary").collect():
        out[k * step : (k + 1) * step] = np.frombuffer(zstandard.decompress(flags), np.uint8)
    return out


def bitmap_bits(tokens: int, each: int = 16, most: int = 29) -> int:
    """Bits for a filter with a false positive for some ``each`` tokens that aren't in it, at most
    2 ** ``most`` (64 MB); beyond that there are more."""
    return min(most, max(20, math.ceil(math.log2(max(tokens, 1) * each))))


def in_bitmap(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    bits = int(math.log2(len(table))) + 3
    place = tokens >> np.uint64(64 - bits)
    return (table[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
