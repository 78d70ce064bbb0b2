"""Loading of training pairs, catalogues and searches, pruned to the columns in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.quality import dedup_catalogue

#: Columns of the files, in their order.
SEARCH = ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category")
ITEM = ("item_id", "item_title_raw", "item_description_raw", "item_infm_params_text", "item_location_id", "item_microcat_id", "item_category_id", "item_rating", "item_rating_reviews_count")
PAIR = ("item_id", "item_location_id", "item_microcat_id", "item_category_id")
DESCRIPTION = 2000


def train_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SEARCH, *PAIR).withColumn("query_norm", normalize(F.col("search_query")))


def items(spark: SparkSession, benchmark: str, train: str | None = None) -> DataFrame:
    """The benchmark catalogue and, with ``train``, the training items it lacks; texts in normal form."""
    rows = spark.read.parquet(benchmark).select(*ITEM)
    if train:
        more = spark.read.parquet(train).select(*ITEM)
    else:
        more = rows.where("false")
    # of one source's rows with an id, the one with the smallest hash of all values stays
    rows, more = (x.withColumn("_order", F.xxhash64(*ITEM)) for x in (rows, more))
    rows = dedup_catalogue(rows, more, "item_id", "_order").drop("priority", "_order")

    def text(c: str):
        return normalize(F.coalesce(F.col(c), F.lit("")))

    return rows.select(
        F.col("item_id").cast("string").alias("item_id"), text("item_title_raw").alias("title"), text("item_infm_params_text").alias("params"),
        F.substring(text("item_description_raw"), 1, DESCRIPTION).alias("description"), F.col("item_location_id").cast("long").alias("location_id"),
        F.col("item_microcat_id").cast("long").alias("microcat_id"), F.col("item_category_id").cast("long").alias("category_id"),
        F.col("item_rating").try_cast("double").alias("rating"), F.col("item_rating_reviews_count").try_cast("double").alias("reviews"),
    )


def searches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("query_id", *SEARCH)


def schema(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
