"""The two-stage search as one lazy plan: candidates, features, model, blend, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ANSWER, SearchConfig
from .functions.text import cosine
from .operators import blend, features, geo, index, prior, ranker, retrieve, sampling
from .sources.store import scratch_table as keep


@dataclass(frozen=True)
class Prepared:
    candidates: DataFrame  # query_id, item_pos, in_text
    pools: DataFrame  # channel, query_id, item_pos, score
    core: DataFrame
    fields: DataFrame
    embedding: DataFrame | None = None

    def rows(self) -> DataFrame:
        out = self.candidates.join(self.core, ["query_id", "item_pos"]).join(self.fields, ["query_id", "item_pos"])
        return out if self.embedding is None else out.join(self.embedding, ["query_id", "item_pos"])

    @property
    def names(self) -> list[str]:
        return [*features.CORE, *features.FIELD, *(features.EMBEDDING if self.embedding is not None else ())]


def lexical_pools(items: DataFrame, queries: DataFrame, counts: DataFrame, n: int, config: SearchConfig, model: geo.GeoModel | None = None) -> DataFrame:
    """(channel, query_id, item_pos, score) of the stem and character channels; ``counts`` are the joint
    ones of stems."""
    terms = keep(index.stem_terms(queries))
    grams = keep(index.gram_counts(items, "item_pos", "title", 3, 5))
    vocabulary = keep(index.tfidf(grams, n, index.MAX_GRAMS))
    own = keep(index.project(index.gram_counts(queries, "query_id", "search_query", 3, 5), "query_id", vocabulary).select("query_id", "term", F.col("w").alias("qw")))
    out = None
    by_gram = index.score(own, index.project(grams, "item_pos", vocabulary, terms=own), F.col("w") * F.col("qw"))
    for channel, scored in (("stem", index.score(terms, index.bm25(counts, n, terms=terms))), ("char", by_gram)):
        rows = geo.with_factor(retrieve.with_items(scored, items, queries), items, model, config)
        rows = rows.withColumn("weighted", F.round(F.col("score") * F.col("factor") * retrieve.service_factor(config), 6))
        pool = retrieve.stratified(rows, weighted=model is not None).select(F.lit(channel).alias("channel"), "query_id", "item_pos", "score")
        out = pool if out is None else out.unionByName(pool)
    return keep(out)


def stem_counts(items: DataFrame) -> DataFrame:
    """(item_pos, field, term, tf) of the stems of all terms within the cap: the index of each field over
    the vocabulary that all of them share."""
    counts = keep(index.term_counts(items))
    frequent = index.capped(index.joint(counts), index.MAX_TERMS)
    return keep(index.stemmed(counts, keep(index.stems_of(frequent))))


def prepare(items: DataFrame, queries: DataFrame, pairs: DataFrame, config: SearchConfig, item_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> Prepared:
    """Candidates and feature blocks of searches, from training pairs that hold none of their texts.
    With vectors (item_pos, vector) and (query_id, vector) the dense channel adds candidates and columns."""
    # each table here is read several times below: written once
    model = geo.from_counts(keep(geo.fit(pairs).counts))
    items, queries = keep(items), keep(queries)
    n = items.count()
    p = keep(prior.prior(pairs, queries.select("query_id", "search_query")))
    fields = stem_counts(items)
    counts = keep(index.joint(fields))
    pools = lexical_pools(items, queries, counts, n, config, model)
    found = text = retrieve.union_candidates(pools, queries, items).withColumn("in_text", F.lit(True))
    near = None
    if item_vectors is not None:
        located = keep(item_vectors.join(items.select("item_pos", "location_id"), "item_pos"))
        asked = keep(query_vectors.join(queries.select("query_id", "search_location_id"), "query_id"))
        near = keep(retrieve.dense_top(retrieve.dense(asked, located, model=model, config=config)))
        found = text.unionByName(near.select("query_id", "item_pos", F.lit(False).alias("in_text"))).groupBy("query_id", "item_pos").agg(F.max("in_text").alias("in_text"))
    found = keep(found)
    core = keep(features.core(found, pools, items, queries, model, p, counts, config))
    block = keep(features.field(found, items, queries, fields, n))
    if near is None:
        return Prepared(found, pools, core, block)
    with_rrf = found.join(core.select("query_id", "item_pos", "prior_relative", F.col("search_rrf").alias("text_rrf")), ["query_id", "item_pos"])
    pairs_ = found.join(asked, "query_id").join(located.withColumnRenamed("vector", "item_vector"), "item_pos")
    scored = geo.with_factor(pairs_.select("query_id", "item_pos", "search_location_id", "location_id", F.round(cosine(F.col("vector"), F.col("item_vector")), 4).alias("cosine")), items, model, config)
    return Prepared(found, pools, core, block, keep(features.embedding(with_rrf, scored.select("query_id", "item_pos", "cosine", "factor"), near, config)))


def training_rows(prepared: Prepared, items: DataFrame, gold: DataFrame, seed: int) -> DataFrame:
    """Selected rows with y. ``gold`` has query_id, gold and known_positives."""
    rows = prepared.rows().join(items.select("item_pos", "item_id"), "item_pos").join(gold.select("query_id", "gold", "known_positives"), "query_id")
    rows = rows.withColumn("is_gold", F.array_contains("gold", F.col("item_id"))).withColumn("is_known", F.array_contains("known_positives", F.col("item_id"))).withColumn("rrf", F.col("search_rrf"))
    kept = sampling.training_selection(rows.select("query_id", "item_pos", "rrf", "is_gold", "is_known"), seed).select("query_id", "item_pos", F.col("is_gold").cast("int").alias("y"))
    return prepared.rows().join(kept, ["query_id", "item_pos"])


def answer(prepared: Prepared, model, weight: float | None = None, trees: int | None = None, text_only: bool = False, k: int = ANSWER) -> DataFrame:
    """(query_id, item_pos, rank): the blend of the model's and the search's order. The weight and the
    number of trees are those noted in the model, if they aren't given."""
    rows = model.predict(prepared.rows(), trees)
    rrf = "hybrid_rrf" if prepared.embedding is not None else "search_rrf"
    rows = rows.select("query_id", "item_pos", "prediction", F.col(rrf).alias("rrf"), "in_text")
    return blend.blend(rows, model.weight if weight is None else weight, k, mask="in_text" if text_only else None).select("query_id", "item_pos", F.col("rank").cast("int").alias("rank"))


def predict(prepared: Prepared, model_or_path, weight: float | None = None, trees: int | None = None, **options) -> DataFrame:
    """``answer`` of a model or of the folder of a stored one; it must find its features in the blocks."""
    model = model_or_path
    if isinstance(model, str):
        model = ranker.Boosted.load(prepared.core.sparkSession, model)
    missing = set(model.features) - set(prepared.names)
    if missing:
        raise ValueError(f"the model needs features that the blocks lack: {sorted(missing)}")
    return answer(prepared, model, weight, trees, **options)
