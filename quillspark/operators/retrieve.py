"""Candidate pools, fusion, the dense channel, unions and the fill to a full answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANSWER, DIGITS, RRF_OFFSET, SERVICE_CATEGORY, SearchConfig
from . import geo as geo_op
from . import index

GLOBAL, CELL, DENSE = 500, 100, 500
FILL_FROM = 100
#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 4096


def with_items(scored: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """Scored pairs with what ranking needs of either side."""
    q = queries.select("query_id", "search_location_id")
    return scored.join(items.select("item_pos", "location_id", "category_id", "microcat_id"), "item_pos").join(q, "query_id")


def service_factor(config: SearchConfig) -> Column:
    return F.when(F.col("category_id") == SERVICE_CATEGORY, F.lit(float(config.service))).otherwise(1.0)


def stratified(scored: DataFrame, weighted: bool = False) -> DataFrame:
    """The pool of (query_id, item_pos, score, location_id, category_id, search_location_id): the best
    500, the best 100 of each cell of (same location, service), and, with a column ``weighted``, the
    best 500 by it. One partitioning by query serves all three orders."""
    local = F.coalesce(F.col("location_id") == F.col("search_location_id"), F.lit(False))
    rows = scored.withColumn("is_local", local).withColumn("is_service", F.col("category_id") == SERVICE_CATEGORY)
    order = [F.desc("score"), F.col("item_pos")]
    rows = rows.withColumn("_g", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    rows = rows.withColumn("_c", F.row_number().over(Window.partitionBy("query_id", "is_local", "is_service").orderBy(*order)))
    keep = (F.col("_g") <= GLOBAL) | (F.col("_c") <= CELL)
    if weighted:
        rows = rows.withColumn("_w", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weighted"), "item_pos")))
        keep = keep | (F.col("_w") <= GLOBAL)
    return rows.where(keep).drop("_g", "_c", "_w")


def reciprocal(rank: Column) -> Column:
    return 1.0 / (RRF_OFFSET + rank)


def fuse(pools: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, item_pos, rrf) of (channel, query_id, item_pos, score, factor): ranks by score times
    factor within each channel, then the weighted sum of reciprocal ranks."""
    order = Window.partitionBy("channel", "query_id").orderBy(F.desc(F.round(F.col("score") * F.col("factor"), DIGITS)), "item_pos")
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(w))) for c, w in config.channels.items()], F.lit(0.0))
    rows = pools.where("score > 0").withColumn("r", F.row_number().over(order))
    return rows.groupBy("query_id", "item_pos").agg(F.sum(weight / (RRF_OFFSET + F.col("r"))).alias("rrf"))


def boosted(fused: DataFrame, prior: DataFrame, items: DataFrame, strength: float) -> DataFrame:
    """The fused score times 1 + strength * p / max p."""
    best = prior.groupBy("query_id").agg(F.max("p").alias("pmax"))
    rows = fused.join(items.select("item_pos", "microcat_id"), "item_pos").join(best, "query_id", "left")
    p = prior.select(F.col("query_id").alias("_q"), F.col("item_microcat_id").alias("_m"), "p")
    rows = rows.join(p, (rows["query_id"] == p["_q"]) & (rows["microcat_id"] == p["_m"]), "left").drop("_q", "_m")
    relative = F.coalesce("p", F.lit(0.0)) / F.greatest(F.coalesce("pmax", F.lit(0.0)), F.lit(1e-12))
    return rows.select("query_id", "item_pos", (F.col("rrf") * (1 + F.lit(strength) * relative)).alias("rrf"))


def union_candidates(pools: DataFrame, queries: DataFrame, items: DataFrame, least: int = ANSWER) -> DataFrame:
    """(query_id, item_pos): distinct positive candidates; a query with fewer than ``least`` also gets
    the first ``least`` positions."""
    found = pools.where("score > 0").select("query_id", "item_pos").distinct()
    size = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").join(size, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("query_id")
    first = items.where(F.col("item_pos") < least).select("item_pos")
    return found.unionByName(short.crossJoin(F.broadcast(first))).distinct()  # at most ``least`` rows


def fill(answers: DataFrame, queries: DataFrame, items: DataFrame, size: int = ANSWER, first: int = FILL_FROM) -> DataFrame:
    """(query_id, item_pos, rank): answers (with rank) filled up with the lowest positions not chosen."""
    counts = answers.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < size)
    spare = short.crossJoin(F.broadcast(items.where(F.col("item_pos") < first).select("item_pos")))  # at most ``first`` rows
    spare = spare.join(answers, ["query_id", "item_pos"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("item_pos"))
    more = spare.withColumn("rank", (F.col("n") + place).cast("int")).where(F.col("rank") <= size).select("query_id", "item_pos", "rank")
    return answers.select("query_id", "item_pos", F.col("rank").cast("int").alias("rank")).unionByName(more)


def search(pools: DataFrame, items: DataFrame, queries: DataFrame, config: SearchConfig, prior: DataFrame | None = None, model=None) -> DataFrame:
    """(query_id, item_pos, rank): the answer of at most 50. ``pools`` is (channel, query_id, item_pos,
    score). One channel alone is ranked by its own scores, without fusion, prior or fill."""
    rows = geo_op.with_factor(with_items(pools.where(F.col("channel").isin(*config.channels)), items, queries), items, model, config)
    rows = rows.withColumn("factor", F.col("factor") * service_factor(config))
    if len(config.channels) == 1:
        return index.top(rows.withColumn("score", F.round(F.col("score") * F.col("factor"), DIGITS)), ANSWER).select("query_id", "item_pos", F.col("rank").cast("int").alias("rank"))
    fused = fuse(rows, config)
    if prior is not None and config.prior:
        fused = boosted(fused, prior, items, config.prior)
    best = index.top(fused.withColumn("rrf", F.round("rrf", 12)), ANSWER, by="rrf")
    return fill(best, queries, items)


def _blocks(query_vectors: DataFrame, block: int) -> list[DataFrame]:
    """The queries in parts of about ``block`` by their hash."""
    n = max(1, -(-query_vectors.count() // block))
    return [query_vectors] if n == 1 else [query_vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _best(scores: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores, equal ones by place."""
    if k >= len(scores):
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([over, tied[np.argsort(place[tied])[: k - len(over)]]])


def _factors(part: DataFrame, vectors: DataFrame, model, config: SearchConfig) -> dict[int, dict[int, float]]:
    """Factors other than 1 by source and destination, for the sources of a block of queries."""
    sources = part.select("search_location_id").distinct()
    pairs = sources.join(model.counts.select("search_location_id", F.col("item_location_id").alias("location_id")), "search_location_id")
    pairs = pairs.unionByName(sources.withColumn("location_id", F.col("search_location_id"))).where("search_location_id is not null").distinct()
    out: dict[int, dict[int, float]] = {}
    for r in geo_op.with_factor(pairs, vectors, model, config).select("search_location_id", "location_id", "factor").collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


DENSE_ROW = "query_id string, item_pos long, kind string, score double, cosine double, factor double"


def dense(query_vectors: DataFrame, vectors: DataFrame, k: int = DENSE, model=None, config: SearchConfig | None = None, digits: int = 4, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, item_pos, kind, score, cosine, factor): each task's best k for each query, from a stated
    query set against all rows, in blocks of queries that are broadcast one by one.

    A batch of vectors is one matrix product, and only the best k so far are held. Kind ``global`` orders
    by cosine; with a location model and its settings there is kind ``geo`` too, by cosine and the
    factor of the query's ``search_location_id`` and the row's ``location_id``. ``index.top`` merges the tasks.
    """
    spark = vectors.sparkSession
    given = vectors.select("item_pos", "vector", *(["location_id"] if model else []))
    out = None
    for part in _blocks(query_vectors, block):
        rows = part.select("query_id", "vector", *(["search_location_id"] if model else [])).collect()  # a block
        factors = _factors(part, vectors, model, config) if model else {}
        matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], matrix, [factors.get(r["search_location_id"], {}) for r in rows] if model else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, own = shared.value
            held: dict[tuple[int, str], list[np.ndarray]] = {}
            for b in batches:
                if not names or not b.num_rows:
                    continue
                place = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                cos = np.round(q @ v.T, digits) + 0.0
                locations, of = np.unique(np.array(b.column(2).to_pylist(), object).astype(str), return_inverse=True) if own else (None, None)
                for i in range(len(names)):
                    factor = np.ones(len(place))
                    kinds = [("global", cos[i])]
                    if own:
                        known = {str(x): f for x, f in own[i].items()}
                        factor = np.array([known.get(x, 1.0) for x in locations])[of]
                        kinds.append(("geo", np.round(cos[i] + config.e5_geo * np.log(factor), digits) + 0.0))
                    for kind, score in kinds:
                        at = _best(score, place, k)
                        new = [score[at], place[at], cos[i, at], factor[at]]
                        if (i, kind) in held:
                            new = [np.concatenate(x) for x in zip(held[i, kind], new, strict=True)]
                            at = _best(new[0], new[1], k)
                            new = [x[at] for x in new]
                        held[i, kind] = new
            for (i, kind), (score, place, c, factor) in held.items():
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * n, pa.string()), pa.array(place, pa.int64()), pa.array([kind] * n, pa.string()), pa.array(score), pa.array(c), pa.array(factor)], ["query_id", "item_pos", "kind", "score", "cosine", "factor"])

        found = given.mapInArrow(run, DENSE_ROW)
        out = found if out is None else out.unionByName(found)
    return out


def semantic_score(cos: Column, factor: Column, config: SearchConfig) -> Column:
    return cos + F.lit(config.e5_geo) * F.log(factor)


def dense_top(found: DataFrame, k: int = DENSE) -> DataFrame:
    """(query_id, item_pos, kind, score, rank, cosine, factor): the best k of each query and kind of ``dense``."""
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "item_pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_pos", "kind", "score", "rank", "cosine", "factor")
