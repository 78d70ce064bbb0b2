"""``python -m quillspark.cli predict|evaluate|train`` over Parquet files of the documented schemas.

Families: ``text`` ranks candidates of the lexical channels by 57 features; ``e5`` adds candidates of
the dense channel; ``e5-features`` adds their nine columns too. The dense families need ``--encoder
module:name``, a callable that returns an encoder, and ``--vectors``, the folder of its stored vectors.
``predict`` and ``evaluate`` follow what was noted in the model: settings, family, trees and weight.
"""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .config import SearchConfig
from .functions.text import encoder_text, normalize
from .operators import encoder as encoders
from .operators import features, metrics, ranker, sampling
from .sources import catalogue, export, store
from .sources.views import positions

PREVIOUS = (20260927, 2026092705, 2026092806)
SEED = 20260928
FAMILIES = ("text", "e5", "e5-features")


def _place(items):
    """Positions by id, written once: every join below goes by them."""
    return store.scratch_table(positions(items, "item_id", bucket=F.substring("_key", 1, 4)))


def _searches(queries):
    """Searches under the names that the operators use."""
    return queries.select(
        "query_id", normalize(F.col("search_query")).alias("search_query"), F.col("search_location_id").cast("long").alias("search_location_id"),
        F.col("search_is_delivery_search").alias("delivery"), F.col("search_infm_params_text").alias("search_params"), F.col("search_category").cast("long").alias("search_category"),
    )


class Dense:
    """Vectors of items and searches by a given encoder, from its store or made now."""

    def __init__(self, args: argparse.Namespace):
        if not args.encoder or not args.vectors:
            raise SystemExit("a dense family needs --encoder and --vectors")
        module, _, name = args.encoder.partition(":")
        self.encoder, self.store = getattr(importlib.import_module(module), name)(), args.vectors

    def items(self, items: DataFrame) -> DataFrame:
        texts = items.select("item_pos", encoder_text(F.col("title"), F.col("params")).alias("text"))
        return encoders.embeddings(texts, "text", "passage: ", self.encoder, self.store).select("item_pos", "vector")

    def queries(self, queries: DataFrame) -> DataFrame:
        return encoders.embeddings(queries.select("query_id", "search_query"), "search_query", "query: ", self.encoder, self.store).select("query_id", "vector")


def _prepared(items, searches, pairs, config, dense: Dense | None) -> pipeline.Prepared:
    if dense is None:
        return pipeline.prepare(items, searches, pairs, config)
    return pipeline.prepare(items, searches, pairs, config, dense.items(items), dense.queries(searches))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=("predict", "evaluate", "train"))
    out.add_argument("--train", required=True)
    out.add_argument("--items", required=True)
    out.add_argument("--queries")
    out.add_argument("--model", required=True)
    out.add_argument("--out")
    out.add_argument("--family", choices=FAMILIES, default="text", help="what to train")
    out.add_argument("--encoder")
    out.add_argument("--vectors")
    out.add_argument("--rounds", type=int, default=100)
    out.add_argument("--trees", type=int, help="instead of the number noted in the model")
    out.add_argument("--weight", type=float, help="instead of the weight noted in the model")
    return out


def train(spark: SparkSession, args: argparse.Namespace, pairs: DataFrame) -> None:
    config, dense = SearchConfig(), Dense(args) if args.family != "text" else None
    items = _place(catalogue.items(spark, args.items, args.train))
    parts = sampling.split(pairs, SEED, PREVIOUS)
    fit = sampling.folds(pairs.join(parts.where("split = 'fit'"), "query_norm", "left_semi"), SEED)
    rows = None
    for fold in range(3):
        own = fit.where(F.col("fold") == fold)
        contexts = store.scratch_table(sampling.select_contexts(own, sampling.first_by_hash(own.select("query_norm").distinct(), 2000, SEED), f"train{fold}", SEED))
        prepared = _prepared(items, _searches(contexts), fit.where(F.col("fold") != fold), config, dense)
        part = store.scratch_table(pipeline.training_rows(prepared, items, contexts, SEED))
        rows = part if rows is None else rows.unionByName(part)
    names = [*features.CORE, *features.FIELD, *(features.EMBEDDING if args.family == "e5-features" else ())]
    chosen = sampling.balanced_pairs(rows.select("query_id", "item_pos", "y"))
    model = ranker.fit_boosted(rows, chosen, names, rounds=args.rounds, materialise=store.scratch_table)
    trees = args.trees or min(args.rounds, 500 if args.family == "text" else 100)
    model.choose(trees, 0.5 if args.weight is None else args.weight, vars(config), semantic=dense is not None).save(spark, args.model)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark, began = SparkSession.builder.getOrCreate(), time.time()
    pairs = catalogue.train_pairs(spark, args.train)
    if args.command == "train":
        train(spark, args, pairs)
        return
    model = ranker.Boosted.load(spark, args.model)
    dense = Dense(args) if model.semantic else None
    if args.command == "predict":
        items, queries = _place(catalogue.items(spark, args.items)), _searches(catalogue.searches(spark, args.queries))
        found = pipeline.predict(_prepared(items, queries, pairs, model.config, dense), model, args.weight, args.trees)
        export.write(found, items, queries, args.out)
        return
    items = _place(catalogue.items(spark, args.items, args.train))
    parts = sampling.split(pairs, SEED, PREVIOUS)
    fit = pairs.join(parts.where("split = 'fit'"), "query_norm", "left_semi")
    contexts = None
    for name in ("val", "test"):
        part = sampling.select_contexts(pairs, parts.where(F.col("split") == name), name, SEED)
        contexts = part if contexts is None else contexts.unionByName(part)
    contexts = store.scratch_table(contexts)
    sampling.assert_disjoint(contexts, fit)
    found = pipeline.predict(_prepared(items, _searches(contexts), fit, model.config, dense), model, args.weight, args.trees)
    ids = found.join(items.select("item_pos", "item_id"), "item_pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    judged = contexts.join(ids, "query_id", "left").select("split", metrics.recall(F.coalesce(F.transform("l", lambda x: x["item_id"]), F.lit([]).cast("array<string>")), F.col("gold")).alias("recall"))
    print(export.metrics_json(judged, time.time() - began))


if __name__ == "__main__":
    main()
