"""Splits, contexts, training selection and pairs. Random choices are orders by md5 of a seed and a
key, so they are the same on any number of executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalogue import SEARCH

HARD, RANDOM, PAIR_WEIGHT = 128, 64, 192.0


def shuffle_key(seed: int | str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def first_by_hash(texts: DataFrame, n: int, seed: int, column: str = "query_norm") -> DataFrame:
    """The first n texts in the seed's order."""
    return texts.orderBy(shuffle_key(seed, column), column).limit(n)


def split(texts: DataFrame, seed: int, previous: tuple[int, ...] = (), size: int = 800, gone: int = 1600) -> DataFrame:
    """(query_norm, split): val and test of ``size`` texts each, fit for the rest. Earlier seeds take
    ``gone`` texts each, one after the other from what is left (split ``previous``)."""
    rest = texts.select("query_norm").distinct()
    taken = None
    for old in previous:
        part = first_by_hash(rest, gone, old)
        rest = rest.join(part, "query_norm", "left_anti")
        part = part.withColumn("split", F.lit("previous"))
        taken = part if taken is None else taken.unionByName(part)
    chosen = first_by_hash(rest, 2 * size, seed)
    # a bounded number of rows is numbered in one task
    place = F.row_number().over(Window.orderBy(shuffle_key(seed, "query_norm"), "query_norm"))
    held = chosen.withColumn("split", F.when(place <= size, "val").otherwise("test"))
    fit = rest.join(chosen, "query_norm", "left_anti").withColumn("split", F.lit("fit"))
    out = held.unionByName(fit)
    return out if taken is None else out.unionByName(taken)


def folds(fit: DataFrame, seed: int, n: int = 3) -> DataFrame:
    """Adds ``fold`` by the hash of the text."""
    return fit.withColumn("fold", F.pmod(F.conv(F.substring(shuffle_key(seed, "query_norm"), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def select_contexts(pairs: DataFrame, texts: DataFrame, split_name: str, seed: int, search: tuple[str, ...] = SEARCH) -> DataFrame:
    """One distinct context of each text, with ``gold`` (its items) and ``known_positives`` (the text's).

    Null and empty values are equal in matching contexts.
    """
    rows = pairs.join(texts.select("query_norm"), "query_norm", "left_semi")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_norm"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in search]))
    rows = rows.withColumn("_k", key)
    chosen = rows.groupBy("query_norm").agg(F.min("_k").alias("_c"), F.array_sort(F.collect_set("item_id")).alias("known_positives"))
    own = rows.join(chosen, "query_norm").where("_k = _c")
    firsts = [F.min(c).alias(c) for c in search]
    out = own.groupBy("query_norm", "known_positives").agg(*firsts, F.array_sort(F.collect_set("item_id")).alias("gold"))
    return out.withColumn("split", F.lit(split_name)).withColumn("query_id", F.concat(F.lit(f"{split_name}_"), F.md5("query_norm")))


def assert_disjoint(queries: DataFrame, fit: DataFrame) -> None:
    """Evaluation texts must not be training texts."""
    if not queries.join(fit, "query_norm", "left_semi").isEmpty():
        raise ValueError("evaluation texts occur among the training texts")


def training_selection(rows: DataFrame, seed: int, hard: int = HARD, random: int = RANDOM) -> DataFrame:
    """Rows to train on, of (query_id, item_pos, rrf, is_gold, is_known): all positives, the ``hard``
    best negatives and ``random`` others. A known positive of another context is no negative; queries
    without a positive or without a negative have no row."""
    rows = rows.withColumn("kind", F.when(F.col("is_gold"), "positive").when(~F.col("is_known"), "negative")).where(F.col("kind").isNotNull())
    by_rrf = Window.partitionBy("query_id", "kind").orderBy(F.desc("rrf"), "item_pos")
    rows = rows.withColumn("_h", F.row_number().over(by_rrf))
    by_hash = Window.partitionBy("query_id", "kind", F.col("_h") <= hard).orderBy(shuffle_key(seed, "query_id", "item_pos"), "item_pos")
    rows = rows.withColumn("_r", F.row_number().over(by_hash))
    keep = rows.where((F.col("kind") == "positive") | (F.col("_h") <= hard) | (F.col("_r") <= random))
    both = F.size(F.collect_set("kind").over(Window.partitionBy("query_id"))) == 2
    return keep.withColumn("_b", both).where("_b").drop("_h", "_r", "_b")


def balanced_pairs(rows: DataFrame, total: float = PAIR_WEIGHT) -> DataFrame:
    """(query_id, winner, loser, weight): positives with negatives of one query; each query's weights
    sum to ``total``. Selection has bounded the rows of a query."""
    a = rows.where("y = 1").select("query_id", F.col("item_pos").alias("winner"))
    b = rows.where("y = 0").select("query_id", F.col("item_pos").alias("loser"))
    count = F.count("*").over(Window.partitionBy("query_id"))
    return a.join(b, "query_id").withColumn("weight", F.lit(total) / count)
