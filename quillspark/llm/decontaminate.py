"""Benchmark decontamination: broadcast n-gram table, window scan, verification, removal.

Both sides are normalised alike: A-Z lower-cased, words are runs of ASCII letters, digits and
non-ASCII characters. An item yields every window of ``n`` consecutive words; an item with fewer
words (but some) is one window. The windows are broadcast in blocks whose size is bounded by
``block_chars`` characters of benchmark text, so what a worker holds does not grow with the
benchmark; with several blocks the texts are scanned once for each, only findings are written, and
these are merged by row.

Defined results: null or empty text has no words and no hit; null or wordless items have no
window; equal windows of several items count for each item; items with a null id count as one item
with a null id; a very long text is one row of one task, worked on in bounded gathers; repeated document
rows are judged one by one; empty tables give empty or clean results. ``scan`` replaces input columns
that bear a name of an output column; ``remove`` keeps every column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, read, slices, small_batches, without

N = 10
#: Characters of benchmark text whose windows are broadcast at a time: some 350,000 windows.
BLOCK_CHARS = 2_000_000


def _folded(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 32
    return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20


_FOLD = bytes(_folded(b) for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.encode().translate(_FOLD).split() if text else []


def in_order(items: set) -> list:
    """Sorted, null last."""
    return sorted(items, key=lambda x: (True,) if x is None else (False, x))


class WindowIndex:
    """Windows of a block of benchmark items, by length, in sorted hash order."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.tables = {}
        for size, windows in found.items():
            rows = np.array(list(windows), dtype=np.int64)
            owners = [in_order(x) for x in windows.values()]
            base = _MIX
            while len(np.unique(h := self._hash(rows.ravel(), size, base)[::size])) < len(rows):
                base = base * _MIX + np.uint64(2)
            order = np.argsort(h)
            self.tables[size] = (h[order], rows[order], [owners[i] for i in order], base)

    @staticmethod
    def _hash(ids: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
        """Polynomial hash of each window of ``size`` ids."""
        count = len(ids) - size + 1
        out = np.zeros(max(count, 0), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size if count > 0 else 0):
                out = out * base + ids[j : j + count].astype(np.uint64)
        return out

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, list[int]]]:
        """For each text: number of words, mask of hit words, items with an occurring window."""
        lists = [words(t) for t in texts]
        gap = max(self.tables, default=1)
        starts, flat, at = [], [], 0
        get = self.vocabulary.get
        for ws in lists:
            starts.append(at)
            flat.append(np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
            flat.append(np.zeros(gap, dtype=np.int64))
            at += len(ws) + gap
        ids = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
        edge = np.zeros(len(ids) + 1, dtype=np.int32)
        first = np.array(starts, dtype=np.int64)
        items: list[set[int]] = [set() for _ in texts]
        for size, (hashes, rows, owners, base) in self.tables.items():
            h = self._hash(ids, size, base)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            pos = np.flatnonzero(hashes[slot] == h)
            slot = slot[pos]
            for lo in range(0, len(pos), 100_000):  # bounded gather
                p, s = pos[lo : lo + 100_000], slot[lo : lo + 100_000]
                same = (ids[p[:, None] + np.arange(size)] == rows[s]).all(axis=1)
                p, s = p[same], s[same]
                np.add.at(edge, p, 1)
                np.add.at(edge, p + size, -1)
                doc = np.searchsorted(first, p, side="right") - 1
                for key in np.unique(doc * len(rows) + s).tolist():
                    items[key // len(rows)].update(owners[key % len(rows)])
        hit = np.cumsum(edge)[:-1] > 0
        return [(len(ws), hit[a : a + len(ws)], in_order(i)) for a, ws, i in zip(starts, lists, items, strict=True)]


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbouring hit words."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            out.append(raw[at : spans[i][0]])
            at, i = spans[j][1], j
        i += 1
    return b"".join([*out, raw[at:]]).decode()


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded text, streamed through the driver one block at a time."""
    block, size = [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        block.append((item, text))
        size += len(text or "")
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _bits(hit: np.ndarray) -> bytes:
    return np.packbits(hit).tobytes()


def _unbits(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=count).astype(bool)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", n: int = N, block_chars: int = BLOCK_CHARS, keep_text: bool = True) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``items`` (ids of items with occurring windows)
    and ``hit_bits`` (a bit for each word). ``keep_text=False`` leaves the text out."""
    spark = docs.sparkSession
    out = without(docs, "n_words", "n_hit", "items", "hit_bits")
    items_type = T.ArrayType(benchmark.schema[id_col].dataType)
    kept = [f for f in out.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", items_type), T.StructField("hit_bits", T.BinaryType())])
    names, item_kind = [f.name for f in kept], to_arrow_type(items_type)

    def finished(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        cols = [b.column(b.schema.get_field_index(c)) for c in names]
        cols += [pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[1].sum()) for f in found], pa.int64()), pa.array([f[2] for f in found], item_kind), pa.array([_bits(f[1]) for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_hit", "items", "hit_bits"])

    queue = blocks(benchmark, id_col, item_text_col, block_chars)
    block, following = next(queue, []), next(queue, None)
    if following is None:
        index = spark.sparkContext.broadcast(WindowIndex(block, n))

        def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = index.value
            for b in slices(batches):
                yield finished(b, table.scan(b.column(b.schema.get_field_index(text_col)).to_pylist()))

        return out.mapInArrow(in_one, schema)

    row = "row_" + "_".join(out.columns)  # longer than any column's name
    numbered = materialise(out.withColumn(row, F.monotonically_increasing_id()), "documents")
    findings = None
    while block is not None:
        index = spark.sparkContext.broadcast(WindowIndex(block, n))

        def hits(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            table = index.value
            for b in slices(batches):
                found = [(r, _bits(f[1]), f[2]) for r, f in zip(b.column(0).to_pylist(), table.scan(b.column(1).to_pylist()), strict=True) if f[2]]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.binary(), item_kind))], ["r", "bits", "items"])

        with small_batches(spark):
            more = materialise(numbered.select(row, text_col).mapInArrow(hits, T.StructType([T.StructField("r", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("items", items_type)])), "findings")
        index.unpersist()
        findings = more if findings is None else findings.unionByName(more)
        block, following = following, next(queue, None)
    # one finding for each row and block at most
    merged = findings.groupBy("r").agg(F.collect_list(F.struct("bits", "items")).alias("parts_" + row)).withColumnRenamed("r", "r_" + row)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for text, parts in zip(b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index("parts_" + row)).to_pylist(), strict=True):
                count = len(words(text))
                hit, items = np.zeros(count, bool), set()
                for p in parts or []:
                    hit |= _unbits(p["bits"], count)
                    items.update(p["items"])
                found.append((count, hit, in_order(items)))
            yield finished(b, found)

    return numbered.join(merged, numbered[row] == merged["r_" + row], "left").mapInArrow(joined, schema)


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", max_hit: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """Clean documents: ``spans`` cuts the hit words and drops documents with a hit share above
    ``max_hit``; ``documents`` drops every document with a hit. Same columns as ``docs``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("_row"), F.col(text_col).alias("_text"))
    found = scan(packed, benchmark, text_col="_text", **options)
    if mode == "documents":
        return found.where("n_hit = 0").select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    found = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("_text").to_pylist()
            bits, words_, hits = (b.column(c).to_pylist() for c in ("hit_bits", "n_words", "n_hit"))
            new = [cut(t, _unbits(x, k)) if h else t for t, x, k, h in zip(texts, bits, words_, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(new, pa.string())], ["_row", "_text"])

    clean = found.mapInArrow(run, T.StructType([found.schema["_row"], T.StructField("_text", T.StringType())]))
    return clean.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op9_benchmark_decontamination(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
