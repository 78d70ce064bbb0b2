"""Data checks and profiles of the catalogue and of the training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, rows), one scan for all columns."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.column", "x.nulls", F.col("_n").alias("rows"))


def checks(items: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of counts of values out of range."""
    bad = items.agg(
        F.count_if(F.col("reviews") < 0).alias("negative_reviews"),
        F.count_if((F.col("rating") < 0) | (F.col("rating") > 5)).alias("rating_out_of_range"),
        F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("empty_titles"),
        (F.count("*") - F.count_distinct("item_id")).alias("duplicate_ids"),
    )
    away = queries.join(items.select("location_id").distinct(), queries["search_location_id"] == F.col("location_id"), "left_anti").agg(F.count("*").alias("sources_not_in_catalogue"))
    return bad.crossJoin(away)  # one row each


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and for each column its distinct values and repeats."""
    return df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"{c}_distinct") for c in columns], *[(F.count(c) - F.count_distinct(c)).alias(f"{c}_repeats") for c in columns])


def shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").cast("double").alias("_n"))
    return counts.select(column, (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("share"))


def dedup_catalogue(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Union of two catalogues; of equal keys the first one's row with the lowest order stays."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_p", order)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("_p", "priority")
