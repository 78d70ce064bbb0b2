"""Ordinal ranks and the blend of model and search order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANSWER, RRF_OFFSET


def ordinal(score: str, tie: str = "item_pos", group: str = "query_id") -> Column:
    """1-based place by score down, position up."""
    return F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))


def blend(rows: DataFrame, weight: float, k: int = ANSWER, mask: str | None = None) -> DataFrame:
    """(…, rank) of rows with ``prediction`` and ``rrf``: the k best by the mixed reciprocal ranks.

    Weight 1 is the model's order, 0 the search's. With ``mask``, ranks are taken over all candidates
    and then only those with a true mask stay.
    """
    if weight == 1:
        rows = rows.withColumn("mixed", F.col("prediction").cast("double"))
    elif weight == 0:
        rows = rows.withColumn("mixed", F.col("rrf").cast("double"))
    else:
        model, found = ordinal("prediction"), ordinal("rrf")
        rows = rows.withColumn("mixed", F.lit(float(weight)) / (RRF_OFFSET + model) + F.lit(1.0 - weight) / (RRF_OFFSET + found))
    if mask:
        rows = rows.where(F.col(mask))
    return rows.withColumn("rank", ordinal("mixed")).where(F.col("rank") <= k)


def grid(rows: DataFrame, predictions: list[str], weights: list[float], k: int = ANSWER) -> DataFrame:
    """(model, weight, query_id, item_pos, rank): the blends of every prediction column, as of a number of
    trees, with every weight, in one job. The points are few and fixed; the ranks that don't depend on the
    weight are taken once for each model."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("prediction")) for m in predictions])
    each = rows.select("query_id", "item_pos", F.col("rrf").cast("double").alias("rrf"), F.explode(models).alias("x")).select("query_id", "item_pos", "rrf", "x.model", "x.prediction")
    by = Window.partitionBy("model", "query_id")
    model, found = F.row_number().over(by.orderBy(F.desc("prediction"), "item_pos")), F.row_number().over(by.orderBy(F.desc("rrf"), "item_pos"))
    each = each.withColumn("_m", model).withColumn("_f", found)

    def mixed(weight: float) -> Column:
        if weight in (0, 1):
            return F.col("prediction") if weight else F.col("rrf")
        return F.lit(float(weight)) / (RRF_OFFSET + F.col("_m")) + F.lit(1.0 - weight) / (RRF_OFFSET + F.col("_f"))

    points = F.array(*[F.struct(F.lit(float(w)).alias("weight"), mixed(w).alias("mixed")) for w in weights])
    each = each.select("model", "query_id", "item_pos", F.explode(points).alias("x")).select("model", "x.weight", "query_id", "item_pos", "x.mixed")
    place = F.row_number().over(Window.partitionBy("model", "weight", "query_id").orderBy(F.desc("mixed"), "item_pos"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).drop("mixed")
