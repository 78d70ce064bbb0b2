"""Line dedup by content-defined chunks of lines, and by what is left of repeated runs at their ends.

A rolling hash over the hashes of two lines chooses the boundaries of chunks: a line with a word ends its
chunk if the hash of it and the one before is divisible by ``CUT``. So an inserted or deleted line
changes only the chunks around it. Chunks of two or more lines are counted over all documents by a 128-bit
hash; of those that occur again, the one with the smallest (id, place) stays.

A repeated run rarely begins and ends at boundaries, and with some three to seven lines for a document
most repeated runs hold no whole chunk. So every chunk is followed up by its pairs of adjacent lines and
the pair across its end, and these are counted in the same way; what lies inside a repeated copy of a chunk
needs no count, as the copy that stays holds the same pairs. Together chunks and pairs cover exactly the
runs of two or more adjacent lines that a document before has too. The bytes of every copy, chunk or pair,
are compared with the one that stays before it is removed, with its line ends. A text that has only one
line with a word is compared as that line.

Defined results: null or empty text has no line and stays as it is; blank lines inside a removed run go
with it, those behind it too, and so do those before it at the text's beginning; a single repeated
line among others stays, and so does a text of one line that is a line of a longer text; a very long
text is one row, its spans are found in one pass; repeated rows (equal id and text) are one document and
keep the same lines; rows with equal ids and different texts are told apart by a hash of the text; null ids
come first in order; an empty table gives an empty result. Columns named like the counts are replaced, all
others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read, slices, small_batches, without

#: One of so many lines ends its chunk.
CUT = 4
#: Bytes of the list of spans to compare that is broadcast; beyond it the texts are shuffled.
BROADCAST_BYTES = 64_000_000
COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = re.compile(rb"\s*")


def full_lines(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the lines with a word, as byte places without the line ends."""
    out, at = [], 0
    for line in raw.split(b"\n"):
        if line.strip():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _chunks(raw: bytes, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) line of each chunk."""
    out, first, before = [], 0, 0
    for i, (s, e) in enumerate(lines):
        own = xxhash.xxh3_64_intdigest(raw[s:e])
        rolled = (before * _BASE + own) & _MASK  # of two lines: what is older has left it
        if i and (rolled ^ (rolled >> 33)) * 0xFF51AFD7ED558CCD % (1 << 64) >> 32 < (1 << 32) // CUT or i == len(lines) - 1:
            out.append((first, i))
            first = i + 1
        before = own
    return out


def chunks(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of the chunks of a text; lines without a word don't count."""
    lines = full_lines(raw)
    return [(lines[a][0], lines[b][1], a, b) for a, b in _chunks(raw, lines)]


def runs(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, lines) of what to remove for spans (start, end): overlapping ones are joined, and
    the blank lines around them added."""
    joined: list[list[int]] = []
    for s, e in sorted(spans):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    out = []
    for s, e in joined:
        s = s if out or raw[:s].strip() else 0
        behind = _SPACE.match(raw, e).end()
        e = len(raw) if behind == len(raw) else raw.rfind(b"\n", e, behind) + 1
        out.append((s, e, raw.count(b"\n", s, e) + (e == len(raw))))
    return out


def _rest(raw: bytes, found: list[tuple[int, int, int]]) -> str:
    at, parts = 0, []
    for s, e, _ in found:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]).decode()


def _hash(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & _MASK) - (1 << 63)


def _pairs(raw: bytes) -> Iterator[tuple]:
    """(s, e, h1, h2, cs, ce, c1, c2, head) of each pair of adjacent lines with its chunk, if that holds both
    lines (else cs is -1); ``head`` marks one pair of each such chunk. One line alone is its own pair."""
    lines = full_lines(raw)
    if len(lines) == 1:
        yield (*lines[0], *_hash(raw[slice(*lines[0])]), -1, 0, 0, 0, False)
        return
    for a, b in _chunks(raw, lines):
        if a < b:
            cs, ce = lines[a][0], lines[b][1]
            own = (cs, ce, *_hash(raw[cs:ce]))
            for i in range(a, b):
                s, e = lines[i][0], lines[i + 1][1]
                yield (s, e, *(own[2:] if b == a + 1 else _hash(raw[s:e])), *own, i == a)
        if b + 1 < len(lines):
            s, e = lines[b][0], lines[b + 1][1]
            yield (s, e, *_hash(raw[s:e]), -1, 0, 0, 0, False)


_ROW = [("s", pa.int32()), ("e", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("cs", pa.int32()), ("ce", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("head", pa.bool_())]


def _again(rows: DataFrame, name: str) -> DataFrame:
    """The spans (d, t, s, e, h1, h2) whose hash occurs more than once, with ``is_first``. Both sides of the
    join are shuffled for it, so that a hot hash's rows can be split over tasks at run time."""
    firsts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "s")).alias("first")).where("n > 1").select("h1", "h2", "first")
    return rows.join(materialise(firsts, name), ["h1", "h2"]).select("d", "t", "s", "e", "h1", "h2", (F.struct("d", "t", "s") == F.col("first")).alias("is_first"))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"), row.alias("row"))


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(d, t, s, e): spans to remove, as byte places; d and t are the id and the text's hash."""
    with small_batches(docs.sparkSession):
        return _repeated_spans(_keyed(docs, text_col, id_col).select("d", "t", "text"))


def _repeated_spans(keyed: DataFrame) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for row in _pairs((text or "").encode()):
                    at.append(i)
                    rows.append(row)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("d").take(take), b.column("t").take(take), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_ROW))], ["d", "t", *(c for c, _ in _ROW)])

    found = materialise(keyed.mapInArrow(listed, "d long, t long, s int, e int, h1 long, h2 long, cs int, ce int, c1 long, c2 long, head boolean"), "lines")
    chunks_ = found.where("head").select("d", "t", F.col("cs").alias("s"), F.col("ce").alias("e"), F.col("c1").alias("h1"), F.col("c2").alias("h2"))
    by_chunk = materialise(_again(chunks_, "repeated-chunks"), "chunks")
    copies = by_chunk.where("not is_first").select("d", "t", F.col("s").alias("cs")).distinct()
    by_pair = _again(found.join(copies, ["d", "t", "cs"], "left_anti").select("d", "t", "s", "e", "h1", "h2"), "repeated-pairs")
    # s and e are below 2 ** 31: a span and its flag in one number; a document's list is bounded by its length
    span = F.shiftleft(F.col("s").cast("long"), 32) + (F.col("e") - F.col("s")).cast("long") * 2 + F.col("is_first").cast("long")
    wanted = by_chunk.unionByName(by_pair).distinct().select("d", "t", F.array(span, "h1", "h2").alias("x"))
    wanted = materialise(wanted.groupBy("d", "t").agg(F.flatten(F.collect_list("x")).alias("want")), "wanted")
    n_docs, n_values = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("want")), F.lit(0))).first()
    few = 64 * n_docs + 8 * n_values <= BROADCAST_BYTES

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, rows = [], []
            for i, (text, want) in enumerate(zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True)):
                raw = text.encode()
                for x, h1, h2 in zip(want[::3], want[1::3], want[2::3], strict=True):
                    s, e = x >> 32, (x >> 32) + ((x & 0xFFFFFFFF) >> 1)
                    at.append(i)
                    rows.append((s, e, h1, h2, bool(x & 1), raw[s:e]))
            take = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("d").take(take), b.column("t").take(take), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["d", "t", "s", "e", "h1", "h2", "is_first", "bytes"])

    parts = keyed.join(F.broadcast(wanted) if few else wanted, ["d", "t"]).mapInArrow(fetch, "d long, t long, s int, e int, h1 long, h2 long, is_first boolean, bytes binary")
    parts = materialise(parts, "span-bytes")
    kept = parts.where("is_first").select("h1", "h2", F.col("bytes").alias("kept"))  # a row for each level that has the hash
    return parts.where("not is_first").join(kept, ["h1", "h2"]).where("bytes = kept").select("d", "t", "s", "e").distinct()


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with repeated runs of lines removed from their texts, and ``n_lines``,
    ``n_removed_lines`` and ``n_removed_chunks`` (removed runs)."""
    docs = without(docs, *COUNTS)
    lists = repeated_spans(docs, text_col, id_col).groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("cut"))
    rows = _keyed(docs, text_col, id_col).join(lists, ["d", "t"], "left").select("row", "text", "cut")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts = [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column("cut").to_pylist(), strict=True):
                n = text.count("\n") + 1 if text else 0
                found = []
                if cut:
                    raw = text.encode()
                    found = runs(raw, [(c["s"], c["e"]) for c in cut])
                    text = _rest(raw, found)
                texts.append(text)
                counts.append((n, sum(lines for _, _, lines in found), len(found)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], ["row", "text", *COUNTS])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *COUNTS)


def op5_line_dedup(spark, sf_dir):
    """Digest of each document: lines, removed lines and runs, SHA-256 of the text that is left."""
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
