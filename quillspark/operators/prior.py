"""Category prior: class shares of the nearest known texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIGITS
from ..sources.store import scratch_table as keep
from . import index

NEIGHBOURS, LEAST_COSINE = 10, 0.2


def distribution(pairs: DataFrame) -> DataFrame:
    """(query_norm, item_microcat_id, share): class shares of each text."""
    counts = pairs.groupBy("query_norm", "item_microcat_id").agg(F.count("*").cast("double").alias("c"))
    return counts.select("query_norm", "item_microcat_id", (F.col("c") / F.sum("c").over(Window.partitionBy("query_norm"))).alias("share"))


def prior(pairs: DataFrame, queries: DataFrame, leave_out_self: bool = False) -> DataFrame:
    """(query_id, item_microcat_id, p) for queries (query_id, search_query in normal form).

    Squared cosines of the nearest texts weigh their class shares; a class that isn't listed has 0.
    """
    texts = pairs.select("query_norm").distinct()
    counts = keep(index.gram_counts(texts, "query_norm", "query_norm", 2, 5))
    vocabulary = keep(index.tfidf(counts, texts.count(), index.MAX_PRIOR_GRAMS))
    own = keep(index.project(index.gram_counts(queries, "query_id", "search_query", 2, 5), "query_id", vocabulary).select("query_id", "term", F.col("w").alias("qw")))
    postings = index.project(counts, "query_norm", vocabulary, terms=own)
    scored = index.score(own, postings, F.col("w") * F.col("qw"), target="query_norm")
    if leave_out_self:
        scored = scored.where("query_id <> query_norm")
    near = index.top(scored, NEIGHBOURS, tie="query_norm").where(F.col("score") >= LEAST_COSINE).withColumn("sq", F.col("score") * F.col("score"))
    total = near.groupBy("query_id").agg(F.sum("sq").alias("total"))
    shares = near.join(distribution(pairs), "query_norm").groupBy("query_id", "item_microcat_id").agg(F.sum(F.col("sq") * F.col("share")).alias("s"))
    return shares.join(total, "query_id").select("query_id", "item_microcat_id", F.round(F.col("s") / F.col("total"), DIGITS).alias("p"))


def summary(p: DataFrame) -> DataFrame:
    """(query_id, prior_max, prior_entropy)."""
    return p.where("p > 0").groupBy("query_id").agg(F.max("p").alias("prior_max"), F.round(F.sum(-F.col("p") * F.log("p")), DIGITS).alias("prior_entropy"))
