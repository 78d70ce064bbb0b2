"""N-gram Jaccard self-join by a grouped prefix join, and the components of its links.

A document's set is its distinct n-word shingles as 64-bit hashes; two documents link when
100 * |A and B| >= percent * |A or B|. The steps:

1. Equal sets are one class (128-bit signature and size); only its smallest id goes on.
2. The global token order puts tokens that more than ``hot_df`` documents contain last, and orders
   by hash otherwise. Any order that all documents share is exact, so hot tokens are told by a filter of
   bounded size with false positives, and the limit is the same however many there are: no list of a token
   that is not hot is longer. Document frequencies are counted over all documents, combined in each
   task and packed before their shuffle.
3. A class's prefix is its first n - ceil(percent * n) + 1 tokens. Classes with the same size and
   prefix are one group. Lists of the groups with a token give group pairs, filtered by their
   sizes and by how many prefix tokens they have in common; what is left is expanded to pairs of
   members and verified with whole sets.
4. A list of a hot token, or a group of several classes, may be long. No such list is expanded into
   all its pairs: its first member is compared with all others, then what is not in one component
   gets another pivot, and what is still outside its list's main component is compared, in bounded
   blocks with an inverted index, with all members of such lists. Pairs inside a component need no
   check, so no link between components is lost.
5. Components by alternating large-star and small-star steps on the verified links.

Defined results: null, empty or wordless text has size 0 and is alone; a text with fewer than n
words is one shingle; repeated rows share a component; rows with the same id are one node; a row with a
null id gets the component of the documents it links to, null if there are none; a very long text
is one row of one task; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read, slices, small_batches
from .packed import FLUSH, bitmap, bitmap_bits, bucket_count, by_bucket, counts, cut, in_bitmap, pack, spread, squeeze, unpack

N = 4
PERCENT = 85
HOT_DF = 16
#: Ids of documents to verify are broadcast up to this number; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of packed sets that are compared with all members of open lists at a time.
BLOCK_BYTES = 32_000_000
_P = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class _Hashes(dict):
    """Word to hash, emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def tokens(text: str | None, hashes: dict, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split fold and cut at ASCII only."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h + w[j : j + len(h)]) * _P[j % len(_P)]
            h ^= h >> np.uint64(29)
        return np.unique(_mix(h))


def hot_tokens(docs: DataFrame, text_col: str, n: int, bits: int, buckets: int, hot_df: int) -> np.ndarray:
    """Filter of the tokens (by their upper ``bits`` bits) that more than ``hot_df`` documents contain."""
    shift = np.uint64(64 - bits)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hashes = _Hashes()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                yield tokens(text, hashes, n) >> shift

    found = materialise(counts(docs.select(text_col), tokens_of, buckets, bits, hot_df).select(F.shiftleft("token", 64 - bits).alias("token")), "hot-tokens")
    table = bitmap(found, "token", bitmap_bits(found.count()))
    discard(found)
    return table


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def prefixes(docs: DataFrame, hot, bits: int, text_col: str, id_col: str, n: int, percent: int) -> DataFrame:
    """(doc, n, s1, s2, prefix, n_hot): set size, signature, and the prefix with its hot tokens last."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _Hashes(), hot.value
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = tokens(text, hashes, n)
                if not len(t):
                    rows.append((doc, 0, 0, 0, b"", 0))
                    continue
                with np.errstate(over="ignore"):
                    s1, s2 = int(_mix(t ^ _P[1]).sum(dtype=np.uint64)), int(_mix(t + _P[2]).sum(dtype=np.uint64))
                size = prefix_length(len(t), percent)
                is_hot = in_bitmap(table, t)
                cold = t[~is_hot][:size]
                head = np.concatenate([cold, t[is_hot][: size - len(cold)]])
                rows.append((doc, len(t), s1 - (1 << 63), s2 - (1 << 63), head.tobytes(), len(head) - len(cold)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc", "n", "s1", "s2", "prefix", "n_hot"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(run, "doc long, n int, s1 long, s2 long, prefix binary, n_hot int")


def _runs_to_pairs(token: np.ndarray, gid: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int) -> pa.Table:
    """Pairs of different ids with common tokens and fitting sizes, and the number of the tokens."""
    order = np.argsort(token, kind="stable")
    token, gid, n, hot = token[order], gid[order], n[order], hot[order]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    starts, sizes = edge[:-1], np.diff(edge)
    ids, first, own = np.unique(gid, return_index=True, return_inverse=True)
    keys = [np.zeros(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        run = starts[sizes == size]
        step = max(1, 250_000 // len(i))
        for lo in range(0, len(run), step):
            a, b = (run[lo : lo + step, None] + i).ravel(), (run[lo : lo + step, None] + j).ravel()
            small, large = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
            fit = (100 * small >= percent * large) & (own[a] != own[b])
            x, y = own[a[fit]], own[b[fit]]
            keys.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
    key, common = np.unique(np.concatenate(keys), return_counts=True)
    a, b = key // len(ids), key % len(ids)
    n, hot = n[first], hot[first]
    return pa.table({"a": ids[a], "b": ids[b], "na": n[a], "nb": n[b], "hot": np.minimum(hot[a], hot[b]), "common": common.astype(np.int64)})


def cold_pairs(groups: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs (a, b) of groups that share a token of their prefixes that isn't hot, and may link.

    Of two sets, let x be the one whose prefix ends first in the token order. What they have in common
    of x's prefix lies in both prefixes; so no more can be common than the common prefix tokens and
    the rest of x. Common hot ones are not counted here and add the smaller number of them at most.
    """

    def flush(parts) -> pa.RecordBatch:
        t, g, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(t)
        t, g, n, h = t[order], g[order], n[order], h[order]
        rows = [(k, pack(t[a:b]), squeeze(g[a:b]), squeeze(n[a:b]), squeeze(h[a:b])) for k, a, b in cut(t, buckets, 64)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), *[pa.binary()] * 4))], ["bucket", "t", "g", "n", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for gid, n, prefix, hot in zip(*(b.column(c).to_pylist() for c in ("gid", "n", "prefix", "n_hot")), strict=True):
                t = np.frombuffer(prefix, np.uint64)[: len(prefix) // 8 - hot]
                parts.append((t, np.full(len(t), gid, np.int64), np.full(len(t), n, np.int32), np.full(len(t), hot, np.int32)))
                held += len(t)
            if held > FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    def meet(table: pa.Table) -> pa.Table:
        t = [unpack(x) for x in table.column("t").to_pylist()]
        g, n, h = ([spread(x, len(v), k) for x, v in zip(table.column(c).to_pylist(), t, strict=True)] for c, k in (("g", np.int64), ("n", np.int32), ("h", np.int32)))
        return _runs_to_pairs(np.concatenate(t), np.concatenate(g), np.concatenate(n), np.concatenate(h), percent)

    packed = groups.select("gid", "n", "prefix", "n_hot").mapInArrow(run, "bucket int, t binary, g binary, n binary, h binary")
    found = by_bucket(packed, buckets).applyInArrow(meet, "a long, b long, na int, nb int, hot int, common long")
    found = found.groupBy("a", "b", "na", "nb", "hot").agg(F.sum("common").alias("common"))

    def rest(size):  # of a set behind its prefix
        return F.floor((size.cast("long") * percent + 99) / 100) - 1

    most = F.col("common") + F.col("hot") + F.greatest(rest(F.col("na")), rest(F.col("nb")))
    return found.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def hot_lists(groups: DataFrame) -> DataFrame:
    """(list, gid, n): the groups of each hot token of a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for gid, n, prefix, hot in zip(*(b.column(c).to_pylist() for c in ("gid", "n", "prefix", "n_hot")), strict=True):
                rows += [(t, gid, n) for t in np.frombuffer(prefix, np.int64)[len(prefix) // 8 - hot :].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["list", "gid", "n"])

    return groups.where("n_hot > 0").select("gid", "n", "prefix", "n_hot").mapInArrow(run, "list long, gid long, n int")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): label is the smallest node of the component.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller ones;
    together they reach stars in a number of rounds that grows with the logarithm of the size.
    """
    pairs = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows=links.count())
    state, size = None, pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, pairs = pairs, materialise(small, "star", rows=2 * size)
        discard(before)
        now = pairs.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, size = now, now[0]
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label")))


def whole_sets(ids: DataFrame, docs: DataFrame, text_col: str, id_col: str, n: int) -> DataFrame:
    """(doc, set): the packed shingles of the documents in ``ids`` (doc, and what else it has)."""
    few, names = ids.count() <= BROADCAST_IDS, ids.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches):
            sets = [tokens(t, hashes, n).tobytes() for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_col).join(F.broadcast(ids) if few else ids, "doc")
    schema = ", ".join(f"{c} {t}" for c, t in ids.dtypes)
    return materialise(texts.mapInArrow(run, f"{schema}, set binary"), "sets")


def verify(pairs: DataFrame, docs: DataFrame, text_col: str, id_col: str, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    ids = materialise(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "to-verify", rows=2 * pairs.count())
    sets = whole_sets(ids, docs, text_col, id_col, n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    left, right = sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
    return materialise(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"), "verified")


class Block:
    """Inverted index of a bounded number of sets with their labels."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.doc = np.array([r[0] for r in rows], np.int64)
        self.label = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        token, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.token, self.start, self.count = np.unique(token[order], return_index=True, return_counts=True)

    def links(self, label: int, own: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets under other labels that are similar enough to ``own``."""
        at = np.minimum(np.searchsorted(self.token, own), len(self.token) - 1)
        at = at[self.token[at] == own]
        if not len(at):
            return at
        width = self.count[at]
        place = np.arange(int(width.sum())) + np.repeat(self.start[at] - np.cumsum(width) + width, width)
        both = np.bincount(self.owner[place], minlength=len(self.doc))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.size + len(own) - both)) & (self.label != label))


def block_links(outside: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, id_col: str, n: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of ``outside`` and of ``members``, both (doc, label), under different
    labels. ``outside`` goes to the workers in blocks of ``BLOCK_BYTES``, all members pass each block;
    a task returns a link once for each set of the block and label of the member."""
    spark = docs.sparkSession
    queue = whole_sets(outside, docs, text_col, id_col, n).toLocalIterator()
    rows = whole_sets(members, docs, text_col, id_col, n)
    found = None
    while True:
        block, held = [], 0
        for r in queue:
            block.append((r["doc"], r["label"], np.frombuffer(r["set"], np.uint64)))
            held += len(r["set"])
            if held >= BLOCK_BYTES:
                break
        if not block:
            return found if found is not None else spark.createDataFrame([], "a long, b long")
        shared = spark.sparkContext.broadcast(Block(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                pairs = []
                for doc, label, own in zip(*(b.column(c).to_pylist() for c in ("doc", "label", "set")), strict=True):
                    for k in shared.value.links(label, np.frombuffer(own, np.uint64), percent).tolist():
                        if (k, label) not in seen:
                            seen.add((k, label))
                            pairs.append((doc, int(shared.value.doc[k])))
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

        more = materialise(rows.mapInArrow(run, "a long, b long"), "block-links")
        found = more if found is None else found.unionByName(more)


def fitting(a, b, percent: int):
    return F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * percent


def join_links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT, hot_df: int = HOT_DF) -> tuple[DataFrame, DataFrame]:
    """(members, labels): members has a row for each document (doc, n, cid), cid its class's smallest
    id, null for an empty set; labels (node, label) has the component of the linked classes."""
    with small_batches(docs.sparkSession):
        return _join_links(docs, text_col, id_col, n, percent, hot_df)


def _join_links(docs: DataFrame, text_col: str, id_col: str, n: int, percent: int, hot_df: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    buckets = bucket_count(size)
    bits = min(64, max(32, math.ceil(math.log2(max(rows, 1) * 1000)) + 8))
    hot = spark.sparkContext.broadcast(hot_tokens(docs, text_col, n, bits, buckets, hot_df))
    sets = materialise(prefixes(docs, hot, bits, text_col, id_col, n, percent), "prefixes")
    full = sets.where("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc").alias("cid"), F.first("prefix").alias("prefix"), F.first("n_hot").alias("n_hot"))
    classes = materialise(classes.where(F.col("cid").isNotNull()), "classes")
    keyed = classes.select("cid", "n", F.xxhash64("prefix").alias("p1"), F.xxhash64("prefix", F.lit(1)).alias("p2"))
    groups = keyed.groupBy("n", "p1", "p2").agg(F.min("cid").alias("gid"), F.count("*").alias("size"))
    several = materialise(keyed.join(groups.where("size > 1"), ["n", "p1", "p2"]).select("gid", "cid", "n"), "groups", rows=classes.count())
    # a group of one class bears its class's id; others are led by their smallest member
    heads = classes.join(several.where("cid <> gid").select("cid"), "cid", "left_anti").withColumnRenamed("cid", "gid")
    heads = materialise(heads.select("gid", "n", "prefix", "n_hot"), "heads")
    pairs = cold_pairs(heads, buckets, percent)
    more = several.select(F.col("gid").alias("g"), "cid")  # members beside the head, for expansion
    pairs = materialise(pairs, "group-pairs")
    if several.head(1):
        wide = pairs.join(more.withColumnRenamed("g", "a").withColumnRenamed("cid", "ca"), "a", "left").join(more.withColumnRenamed("g", "b").withColumnRenamed("cid", "cb"), "b", "left")
        pairs = materialise(wide.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "pairs")
    links = verify(pairs, docs, text_col, id_col, n, percent)
    lists = hot_lists(heads)
    if several.head(1):
        lists = lists.join(several.select("gid", "cid"), "gid", "left").select("list", F.coalesce("cid", "gid").alias("gid"), "n").unionByName(several.select("gid", "cid", "n").select(F.xxhash64("gid", F.lit("group")).alias("list"), F.col("cid").alias("gid"), "n"))
    # the joins below have a shuffle on either side, so that a long list is split over tasks at run time
    sizes = materialise(lists.groupBy("list").agg(F.count("*").alias("m")).where("m > 1"), "list-sizes")
    lists = materialise(lists.join(sizes.select("list"), "list"), "lists")
    labels = materialise(components(links), "labels", rows=2 * links.count())
    if not lists.head(1):
        return sets_with_class(sets, classes), labels
    for round_ in ("first", "largest", "rest"):
        now = lists.join(labels, lists["gid"] == labels["node"], "left").select("list", "gid", "n", F.coalesce("label", "gid").alias("c"))
        span = now.groupBy("list").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("c", "gid", "n")).alias("first"), F.max(F.struct("n", "gid", "c")).alias("largest")).where("c0 <> c1")
        now = materialise(now.join(materialise(span, "spans", rows=lists.count()), "list"), "open-lists")
        if not now.head(1):
            break
        if round_ == "rest":
            outside = materialise(now.where("c <> c0").select(F.col("gid").alias("doc"), F.col("c").alias("label")).distinct(), "outside", rows=now.count())
            members = materialise(now.select(F.col("gid").alias("doc"), F.col("c").alias("label")).distinct(), "members", rows=now.count())
            links = links.unionByName(block_links(outside, members, docs, text_col, id_col, n, percent))
        else:
            pivot = F.col(round_)
            found = now.where((pivot["c"] != F.col("c")) & fitting(pivot["n"], F.col("n"), percent)).select(pivot["gid"].alias("a"), F.col("gid").alias("b"))
            found = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "list-pairs", rows=now.count())
            links = links.unionByName(verify(found, docs, text_col, id_col, n, percent))
        labels = materialise(components(links), "labels", rows=2 * links.count())
    return sets_with_class(sets, classes), labels


def sets_with_class(sets: DataFrame, classes: DataFrame) -> DataFrame:
    return sets.select("doc", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "cid"), ["n", "s1", "s2"], "left").select("doc", "n", "cid")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc, n, component): the size of each document's set and its component's smallest id."""
    members, labels = join_links(docs, **options)
    return members.join(labels, members["cid"] == labels["node"], "left").select("doc", "n", F.coalesce("label", "cid", "doc").alias("component"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
