"""Recall, coverage, losses, slices, grids, paired differences and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER

REPEATS = 3000


def recall(predicted: Column, gold: Column, k: int | None = ANSWER) -> Column:
    """Share of the gold items among the first k predicted; 0 without gold."""
    head = predicted if k is None else F.slice(predicted, 1, k)
    known = F.array_distinct(gold)
    return F.when(F.size(known) > 0, F.size(F.array_intersect(head, known)) / F.size(known)).otherwise(0.0)


def losses(answer: Column, candidates: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(recall, ranking loss, retrieval loss): they sum to 1 where there is gold."""
    hit, held = recall(answer, gold), recall(candidates, gold, None)
    return hit, held - hit, F.when(F.size(gold) > 0, 1.0 - held).otherwise(0.0)


def by_slice(rows: DataFrame, flag: str, value: str) -> DataFrame:
    return rows.groupBy(flag).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def grid_best(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """The grid point with the largest value, the first of equal ones in the order given."""
    return rows.orderBy(F.desc(value), *order).limit(1)


def paired_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_delta, wins, losses) of b against a."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))


def bootstrap(rows: DataFrame, value: str, seed: int = 20260928, repeats: int = REPEATS) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles of the means of resamples; null without rows.

    A resample draws Poisson(1) copies of each row, and so Poisson(n) of a value that n rows have. The
    draws are seeded by the value, so they are the same on any number of executors; a task adds up
    its own, and only one (sum, count) for each repeat and task is shuffled.
    """
    counts = rows.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, drawn = np.zeros(repeats), np.zeros(repeats, np.int64)
        for b in batches:
            v, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for x, bits, times in zip(v, (v + 0.0).view(np.uint64).tolist(), n, strict=True):
                copies = np.random.Generator(np.random.Philox(key=[seed, bits])).poisson(times, repeats)
                total += x * copies
                drawn += copies
        yield pa.RecordBatch.from_arrays([pa.array(range(repeats), pa.int32()), pa.array(total), pa.array(drawn)], ["rep", "s", "c"])

    sums = counts.mapInArrow(run, "rep int, s double, c long").groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    means = sums.select(F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def paired_interval(a: DataFrame, b: DataFrame, key: str, value: str, **options) -> DataFrame:
    """``paired_delta`` with the bootstrap interval (low, high) of the mean difference."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select((F.col("y") - F.col("x")).alias("d"))
    return paired_delta(a, b, key, value).crossJoin(bootstrap(d, "d", **options))  # one row each
