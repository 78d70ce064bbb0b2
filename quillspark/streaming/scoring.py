"""Extension: searches from a stream, answered batch by batch with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def answer_stream(searches: DataFrame, postings: DataFrame, out: str, checkpoint: str, k: int = 50) -> StreamingQuery:
    """Best k items by BM25 for each search of the stream, written as Parquet by batch.

    A batch's folder is overwritten if the batch is run again, so a restart repeats nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        scored = index.score(index.query_terms(batch), postings)
        index.top(scored, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return searches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
