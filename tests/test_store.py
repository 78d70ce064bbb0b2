import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import encoder, ranker
from quillspark.sources import export, store
from quillspark.streaming import scoring


class Counting(encoder.HashEncoder):
    """Notes its calls in a folder, and may fail once there are so many."""

    def __init__(self, folder, fail_at=None, salt=""):
        super().__init__(8, salt)
        self.folder, self.fail_at = str(folder), fail_at

    def encode(self, texts, prefix):
        import os
        import uuid

        if self.fail_at is not None and len(os.listdir(self.folder)) >= self.fail_at:
            raise RuntimeError("stopped")
        open(f"{self.folder}/{uuid.uuid4()}", "w").close()
        return super().encode(texts, prefix)


def test_embeddings_encode_each_text_once_and_resume(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = spark.createDataFrame([(i, str(i % 300)) for i in range(330)], "n int, text string")
    path = str(tmp_path / "vectors")
    first = encoder.embeddings(texts.where("n < 100"), "text", "query: ", Counting(calls), path)
    assert first.count() == 100
    with pytest.raises(Exception, match="stopped"):
        encoder.embeddings(texts, "text", "query: ", Counting(calls, fail_at=0), path)
    out = encoder.embeddings(texts, "text", "query: ", Counting(calls), path)
    assert out.count() == 330 and out.select(F.hash("vector")).distinct().count() <= 300
    n = len(list(calls.iterdir()))
    assert encoder.embeddings(texts, "text", "query: ", Counting(calls, fail_at=0), path).count() == 330
    assert len(list(calls.iterdir())) == n
    with pytest.raises(ValueError):
        encoder.embeddings(texts, "text", "query: ", Counting(calls, salt="2"), path, rebuild=False)


def test_pool_is_masked_and_unit():
    hidden = np.array([[[3.0, 4.0], [9.0, 9.0]]])
    assert encoder.pool(hidden, np.array([[1, 0]])) == pytest.approx(np.array([[0.6, 0.8]]))


def test_stored_tables_are_checked(spark, tmp_path):
    items = spark.createDataFrame([(0, "a"), (1, "b")], "item_pos long, item_id string")
    q = spark.createDataFrame([(0, "x", None), (1, "y", 3)], "query_pos long, search_query string, search_location_id long")
    key, path = store.key_of(items, q, {"a": 1}), str(tmp_path / "f")
    rows = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 2.0)], "query_id string, item_pos long, f double")
    store.save(rows, path, key)
    assert store.load(spark, path, key).count() == 2
    with pytest.raises(ValueError):
        store.load(spark, path, store.key_of(items, q, {"a": 2}))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "none"), key)
    store.check_queries(q, q)
    for other in (q.withColumn("query_pos", 1 - F.col("query_pos")), q.withColumn("search_location_id", F.lit(4).cast("long")), q.where("query_pos = 0")):
        with pytest.raises(ValueError):
            store.check_queries(q, other)
    store.check_features(rows, items, ["f"])
    for bad, names in ((rows.unionByName(rows), ["f"]), (rows.withColumn("item_pos", F.col("item_pos") + 9), ["f"]), (rows, ["g"])):
        with pytest.raises(ValueError):
            store.check_features(bad, items, names)
    turned = items.withColumn("item_pos", 1 - F.col("item_pos"))
    assert store.frame_digest(items, "item_pos") != store.frame_digest(turned, "item_pos")
    assert store.frame_digest(items) == store.frame_digest(items.orderBy(F.desc("item_id")))


def test_block_keys_follow_what_counts(spark):
    from quillspark.config import SearchConfig

    items = spark.createDataFrame([(0, "a")], "item_pos long, item_id string")
    q = spark.createDataFrame([("q", ["a"])], "query_id string, gold array<string>")
    other = spark.createDataFrame([("q", ["b"])], "query_id string, gold array<string>")

    def key(searches, encoder=None, fold=None, **settings):
        return store.block_inputs(items, searches, items, SearchConfig(**settings), encoder, fold).key()

    assert key(q) == key(other, e5_weight=2.0, max_length=9) and key(q) != key(q, alpha=2.0)
    assert key(q, fold=(1, 0)) != key(other, fold=(1, 0)) and key(q, fold=(1, 0)) != key(q, fold=(1, 1))
    assert len({key(q), key(q, "hash-8"), key(q, "hash-9"), key(q, "hash-8", e5_weight=2.0)}) == 4
    inputs = store.block_inputs(items, q, items, SearchConfig())
    assert inputs.key() != dataclasses.replace(inputs, code="other").key()


def test_joins_that_must_not_multiply(spark):
    rows = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, item_pos long")
    block = rows.withColumn("x", F.lit(1.0))
    assert store.add_columns(rows, block).count() == 2
    for wrong in (block.unionByName(block), block.where("item_pos = 1"), block.unionByName(block.withColumn("item_pos", F.col("item_pos") + 9))):
        with pytest.raises(ValueError):
            store.add_columns(rows, wrong)
    assert store.many_to_one(rows, spark.createDataFrame([("q", "a")], "query_id string, t string"), ["query_id"]).count() == 2


def test_encoding_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = spark.createDataFrame([(str(i),) for i in range(200)], "text string").coalesce(1)
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception, match="stopped"):
        encoder.embeddings(texts, "text", "query: ", Counting(calls, fail_at=3), path, block=50)
    stored = spark.read.parquet(path).count()
    assert 0 < stored < 200
    out = encoder.embeddings(texts, "text", "query: ", Counting(calls), path, block=50)
    assert out.where("vector is not null").count() == 200 and spark.read.parquet(path).count() == 200


def test_export_contract(spark, tmp_path):
    items = spark.range(60).select(F.col("id").alias("item_pos"), F.lpad(F.lower(F.hex("id")), 16, "0").alias("item_id"))
    q = spark.createDataFrame([("a" * 16,)], "query_id string")
    ranked = spark.range(50).select(F.lit("a" * 16).alias("query_id"), F.col("id").alias("item_pos"), (50 - F.col("id")).cast("int").alias("rank"))
    export.write(ranked, items, q, str(tmp_path / "answer"))
    row = spark.read.option("header", True).csv(str(tmp_path / "answer")).first()
    assert row["answer"].split(" ")[0] == "0000000000000031" and len(row["answer"].split(" ")) == 50
    with pytest.raises(ValueError):
        export.check(export.answers(ranked.where("rank < 50"), items), q)
    with pytest.raises(ValueError):
        export.check(export.answers(ranked, items), q.unionByName(spark.createDataFrame([("b" * 16,)], "query_id string")))


@pytest.fixture(scope="module")
def training(spark):
    rows = [(f"q{g}", g * 10 + i, float((g * 7 + i * 3) % 5), float(i == 0) + 0.1 * ((g + i) % 3), int(i == 0)) for g in range(8) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id string, item_pos long, noise double, good double, y int")
    a, b = df.where("y = 1"), df.where("y = 0")
    pairs = a.select("query_id", F.col("item_pos").alias("winner")).join(b.select("query_id", F.col("item_pos").alias("loser")), "query_id").withColumn("weight", F.lit(48.0))
    return df, pairs


def test_rankers_learn_and_reload(spark, training, tmp_path):
    df, pairs = training
    w = ranker.fit_linear(df, pairs, ["noise", "good"])
    assert w[1] > abs(w[0])
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    model = ranker.fit_boosted(df, pairs, ["noise", "good"], rounds=3, depth=2, key="k")
    out = {r["item_pos"]: (r["prediction"], r["y"]) for r in model.predict(df).collect()}
    assert min(p for p, y in out.values() if y) > max(p for p, y in out.values() if not y)
    model.choose(2, 0.5, {"alpha": 5}).save(spark, str(tmp_path / "model"))
    again = ranker.Boosted.load(spark, str(tmp_path / "model"), "k")
    assert again.metadata["selected_trees"] == "2"
    assert (again.weight, again.config.alpha) == (0.5, 5)
    assert {r["item_pos"]: r["prediction"] for r in again.predict(df, trees=3).collect()} == pytest.approx({k: p for k, (p, _) in out.items()})
    assert [r["prediction"] for r in again.predict(df).orderBy("item_pos").collect()] == [r["prediction"] for r in model.predict(df, trees=2).orderBy("item_pos").collect()]
    assert again.predict(df, trees=1).agg(F.max("prediction")).first()[0] < model.predict(df, trees=3).agg(F.max("prediction")).first()[0]
    with pytest.raises(ValueError):
        ranker.Boosted.load(spark, str(tmp_path / "model"), "other")


def test_stream_of_searches(spark, tmp_path):
    postings = spark.createDataFrame([(0, "red", 2.0), (1, "red", 1.0), (1, "chair", 3.0)], "item_pos long, term string, w double")
    spark.createDataFrame([("q1", "red chair"), ("q2", "nothing")], "query_id string, search_query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, search_query string").parquet(str(tmp_path / "in"))
    scoring.answer_stream(stream, postings, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()
    assert [(r["query_id"], r["item_pos"]) for r in got] == [("q1", 1), ("q1", 0)]
