"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by the hash of their id and repeated up to ``max_repeats``
times. A copy's virtual finish time is the source's cumulative tokens up to and with it, divided by
the source's target; all copies are ordered by (finish time, source, hash, id) and the order is cut
at the total budget. The cumulative sums are two-level: hash prefixes cut every source, however
hot, into buckets whose totals are summed first. The global order is ranged over bins of virtual
time, whose sums are searched level by level (some thousand ranges of bins at a time), so that no task
sees all bins; only the bin that crosses the budget is ranked row by row.

Targets: weights share the total; a source stops at ``max_repeats`` times its own size, and what is
above is shared again by weight. This is water filling: with the sources in order of cap over
weight, those below the water line are full, the rest share what is left by weight.

Defined results: null text counts no word, and a document without words takes none; null source is a
source of its own, last in order; repeated rows count each; a total of 0 gives targets of 0; an
empty table gives an empty result; a very long text only counts its words. Columns with the names of
the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read, rows_under, without, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
RESULTS = ("size", "source_size", "target", "taken", "copies")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (skey, source, source_size): a row for each source, in one sort."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("all_weight"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    full = F.col("cap") / F.col("weight") <= (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)).withColumn("rest_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest").cast("double") / F.col("rest_weight"))
    return rows.select("skey", "source", "source_size", target.alias("target"))


def crossing_bin(copies: DataFrame, last: int, budget: int, fan: int = 11) -> tuple[int, int] | None:
    """(bin, tokens in the bins before it) of the first bin whose running sum is above the budget.

    Bins from 0 to ``last`` are searched in levels of at most 2 ** ``fan`` ranges and some.
    """
    shift, before = fan * (max(last.bit_length() - 1, 0) // fan), 0
    rows = copies.select("bin", "size")
    while True:
        upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy(F.shiftright("bin", shift).alias("at")).agg(F.sum("size").alias("n"))
        found = sums.select("at", "n", (F.sum("n").over(upto) + F.lit(before)).alias("upto")).where(F.col("upto") > budget).orderBy("at").first()
        if found is None:
            return None
        before = found["upto"] - found["n"]
        if not shift:
            return found["at"], before
        rows, shift = rows.where(F.shiftright("bin", shift) == found["at"]), shift - fan


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """(doc_id, source, size) with source_size, target, copies and taken.

    ``budget`` is the total number of tokens, by default that of the targets.
    """
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = materialise(sized.select("doc_id", "source", "size", key.alias("skey"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total if budget is None else budget
    digits = min(6, max(3, math.ceil(math.log(max(n, 1) / 64, 16))))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    goal = targets(totals.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")).join(goal.drop("source"), "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("run", F.sum("size").over(within)).join(offsets, ["skey", "bucket"])
    placed = materialise(placed.select("doc_id", "source", "size", "source_size", "target", "skey", "h", (F.col("offset") + F.col("run")).alias("done")), "placed")

    def finish(epoch):
        return (epoch * F.col("source_size") + F.col("done")).cast("double") / F.col("target")

    bins = 1024 * 2 ** max(0, math.ceil(math.log2(max(n, 1) / 1e6)))
    copies = placed.where("size > 0").select("doc_id", "size", "skey", "h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), finish)).alias("finish"))
    reach = max(budget / total, 1e-9) if total else 1.0  # where the cut lies in virtual time
    copies = copies.withColumn("bin", F.least(F.floor(F.col("finish") / reach * bins), F.lit(2 * bins)))
    crossing = crossing_bin(copies, 2 * bins, budget)
    if crossing is None:
        number = F.when(F.col("size") > 0, F.lit(max_repeats)).otherwise(0)
    else:
        order = Window.orderBy("finish", "skey", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("bin") == crossing[0])
        first_out = edge.withColumn("upto", F.sum("size").over(order) + F.lit(crossing[1])).where(F.col("upto") > budget).orderBy("upto").first()
        cut = F.struct(F.lit(first_out["finish"]), F.lit(first_out["skey"]), F.lit(first_out["h"]), F.lit(first_out["doc_id"]).cast(dict(placed.dtypes)["doc_id"]))

        def kept(epoch):
            return F.struct(finish(epoch), F.col("skey"), F.col("h"), F.col("doc_id")) < cut

        number = sum((F.when((F.col("size") > 0) & kept(F.lit(e)), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    placed = placed.withColumn("copies", number)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (how often) and the other results.

    Rows with equal ids, sources and sizes, if there are any, are told apart by their order.
    """
    docs = without(docs, *RESULTS)
    same = ["doc_id", "source", "size"]
    left = rows_under(docs, "row", F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.col("text"))
    found = mix(left.select(*same), **options)
    repeated = not found.groupBy(*same).count().where("count > 1").isEmpty()
    found = found.where("copies > 0").select(*[F.col(c).alias(f"own_{c}") for c in same], "source_size", "target", "taken", "copies")
    match = left["doc_id"].eqNullSafe(found["own_doc_id"]) & left["source"].eqNullSafe(found["own_source"]) & (left["size"] == found["own_size"])
    if repeated:
        left = left.withColumn("twin", F.row_number().over(Window.partitionBy(*same).orderBy("text")))
        found = found.withColumn("other", F.row_number().over(Window.partitionBy("own_doc_id", "own_source", "own_size").orderBy(F.desc("copies"))))
        match = match & (left["twin"] == found["other"])
    return left.join(found, match).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "size", "source_size", "target", "taken", "copies")


def op2_weighted_fair_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS skey FROM documents),
s AS (SELECT source, skey, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
w AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
b AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight <= (total - cap_before) / (all_weight - weight_before) AS is_full FROM b),
g AS (SELECT *, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT AS rest,
             sum(CASE WHEN is_full THEN 0e0 ELSE weight END) OVER () AS rest_weight FROM f),
t AS (SELECT skey, source_size, total, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * rest::DOUBLE / rest_weight END AS target FROM g),
p AS (SELECT d.*, source_size, total, target,
             (sum(size) OVER (PARTITION BY d.skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS done
      FROM d JOIN t USING (skey)),
c AS (SELECT p.*, (e * source_size + done)::DOUBLE / target AS finish FROM p, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE upto <= total GROUP BY 1)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id)
"""
