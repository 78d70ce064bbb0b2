"""Location statistics: transition counts of training pairs, their signal, and the location factor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig


@dataclass(frozen=True)
class GeoModel:
    counts: DataFrame  # search_location_id, item_location_id, count
    support: DataFrame  # search_location_id, support
    background: DataFrame  # item_location_id, background


def context_weights(pairs: DataFrame) -> DataFrame:
    """Distinct (text, source, item) pairs, each context with a total weight of 1.

    Of repeated pairs the smallest destination stays.
    """
    keys = ["query_norm", "search_location_id", "item_id"]
    distinct = pairs.groupBy(*keys).agg(F.min("item_location_id").alias("item_location_id"))
    context = Window.partitionBy("query_norm", "search_location_id")
    return distinct.withColumn("weight", 1.0 / F.count("*").over(context))


def fit(pairs: DataFrame) -> GeoModel:
    weights = context_weights(pairs)
    return from_counts(weights.groupBy("search_location_id", "item_location_id").agg(F.sum("weight").alias("count")))


def from_counts(counts: DataFrame) -> GeoModel:
    """The model of transition counts."""
    support = counts.groupBy("search_location_id").agg(F.sum("count").alias("support"))
    total = counts.agg(F.sum("count").alias("total"))
    background = counts.groupBy("item_location_id").agg(F.sum("count").alias("c")).crossJoin(F.broadcast(total))  # one row
    return GeoModel(counts, support, background.select("item_location_id", (F.col("c") / F.col("total")).alias("background")))


def signal(model: GeoModel, alpha: float, beta: float) -> DataFrame:
    """(source, destination, signal): conditional share over background ** beta, as a part of the
    source's best, shrunk by support / (support + alpha). What is missing counts as 0."""
    rows = model.counts.join(model.support, "search_location_id").join(model.background, "item_location_id")
    adjusted = F.col("count") / F.col("support") / F.pow("background", F.lit(float(beta)))
    best = F.max("adjusted").over(Window.partitionBy("search_location_id"))
    rows = rows.withColumn("adjusted", adjusted)
    return rows.select("search_location_id", "item_location_id", (F.col("adjusted") / best * (F.col("support") / (F.col("support") + F.lit(float(alpha))))).alias("signal"))


def factor(same: Column, signal_: Column, present: Column, config: SearchConfig) -> Column:
    """Bonus for the same location plus the learned signal.

    With scope ``missing`` the signal counts only for sources that the catalogue doesn't have.
    """
    base = F.when(same, F.lit(float(config.location))).otherwise(1.0)
    if not config.geo_strength:
        return base
    learned = F.lit(float(config.geo_strength)) * F.coalesce(signal_, F.lit(0.0))
    return base + (learned if config.scope == "all" else F.when(present, 0.0).otherwise(learned))


def with_factor(rows: DataFrame, locations: DataFrame, model: GeoModel | None, config: SearchConfig) -> DataFrame:
    """Adds source_present, signal and factor to rows with search_location_id and location_id.

    ``locations`` are the catalogue's distinct ones (location_id).
    """
    present = locations.select(F.col("location_id").alias("_p")).distinct()
    rows = rows.join(present, rows["search_location_id"] == present["_p"], "left").withColumn("source_present", F.col("_p").isNotNull()).drop("_p")
    if model is None:
        rows = rows.withColumn("signal", F.lit(0.0))
    else:
        s = signal(model, config.alpha, config.beta).select(F.col("search_location_id").alias("_s"), F.col("item_location_id").alias("_d"), "signal")
        rows = rows.join(s, (rows["search_location_id"] == s["_s"]) & (rows["location_id"] == s["_d"]), "left").drop("_s", "_d").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    same = F.coalesce(F.col("search_location_id") == F.col("location_id"), F.lit(False))
    return rows.withColumn("factor", factor(same, F.col("signal"), F.col("source_present"), config if model is not None else SearchConfig(location=config.location, geo_strength=0.0)))
