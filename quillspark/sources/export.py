"""The answer file and the metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER


def answers(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, answer): item ids by rank, joined by blanks."""
    lists = ranked.join(items.select("item_pos", "item_id"), "item_pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return lists.select("query_id", F.array_join(F.transform("l", lambda x: x["item_id"]), " ").alias("answer"))


def check(out: DataFrame, queries: DataFrame, size: int = ANSWER) -> None:
    """Raises ValueError unless each search has one row of ``size`` distinct well-formed ids."""
    ids = F.split("answer", " ")
    checked = out.agg(
        F.count("*").alias("rows"),
        F.count_distinct("query_id").alias("distinct"),
        F.count_if(~F.col("query_id").rlike("^[0-9A-Za-z]{16}$")).alias("bad_query"),
        F.count_if((F.size(ids) != size) | (F.size(F.array_distinct(ids)) != size)).alias("bad_size"),
        F.count_if(F.exists(ids, lambda x: ~x.rlike("^[0-9a-f]{16}$"))).alias("bad_item"),
    ).first()
    expected = queries.count()
    if checked["rows"] != expected or checked["distinct"] != expected or checked["bad_query"] or checked["bad_size"] or checked["bad_item"]:
        raise ValueError(f"the answer breaks its contract: {checked.asDict()}, {expected} searches")


def write(ranked: DataFrame, items: DataFrame, queries: DataFrame, path: str) -> None:
    out = answers(ranked, items)
    check(out, queries)
    out.write.mode("overwrite").option("header", True).csv(path)


def metrics_json(rows: DataFrame, seconds: float) -> str:
    """Mean recall by split as JSON; ``rows`` has split and recall."""
    means = {r["split"]: r["m"] for r in rows.groupBy("split").agg(F.avg("recall").alias("m")).collect()}
    return json.dumps({"recall_at_50": means, "seconds": round(seconds, 3)}, sort_keys=True)
