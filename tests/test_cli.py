import random

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import ranker
from quillspark.sources import views


def test_positions_by_string_ids(spark):
    ids = [f"{random.Random(i).getrandbits(64):016x}" for i in range(200)]
    got = views.positions(spark.createDataFrame([(x,) for x in ids], "item_id string"), "item_id", bucket=F.substring("_key", 1, 2)).collect()
    assert {r["item_id"]: r["item_pos"] for r in got} == {x: i for i, x in enumerate(sorted(ids))}


def hash_encoder():
    from quillspark.operators.encoder import HashEncoder

    return HashEncoder(32)


@pytest.mark.parametrize("family", cli.FAMILIES)
def test_train_then_predict(spark, tmp_path, monkeypatch, family):
    rng = random.Random(2)
    words = "ремонт стрижка маникюр уборка доставка сварка массаж урок переезд дизайн".split()
    pairs, items = [], []
    for i in range(90):
        w = words[i % len(words)]
        items.append((f"{i:016x}", f"{w} недорого {i}", f"вид {w}", f"{w} на дому", i % 5, i % 7, 114, 4.5 if i % 2 else None, 3.0))
    for i in range(60):
        w = words[i % len(words)]
        match = [x for x in items if x[1].startswith(w)]
        pairs.append((f"{w} {i}", i % 5, False, "", 114, *rng.choice(match)))
    item_schema = "item_id string, item_title_raw string, item_infm_params_text string, item_description_raw string, item_location_id long, item_microcat_id long, item_category_id long, item_rating double, item_rating_reviews_count double"
    search_schema = "search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long"
    spark.createDataFrame(items, item_schema).write.parquet(str(tmp_path / "items.parquet"))
    spark.createDataFrame(pairs, f"{search_schema}, {item_schema}").write.parquet(str(tmp_path / "train.parquet"))
    spark.createDataFrame([("q" * 16, "ремонт", 1, False, "", 114), ("r" * 16, "неизвестно", 9, True, "рейтинг пользователя 4", 0)], f"query_id string, {search_schema}").write.parquet(str(tmp_path / "queries.parquet"))
    monkeypatch.setattr(cli, "PREVIOUS", ())
    monkeypatch.setattr(cli.sampling, "split", lambda t, *a, **k: t.select("query_norm").distinct().withColumn("split", F.lit("fit")))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    base = ["--train", str(tmp_path / "train.parquet"), "--items", str(tmp_path / "items.parquet"), "--model", str(tmp_path / "model")]
    base += ["--encoder", "test_cli:hash_encoder", "--vectors", str(tmp_path / "vectors")]
    cli.main(["train", *base, "--rounds", "2", "--family", family, "--weight", "0.25"])
    model = ranker.Boosted.load(spark, str(tmp_path / "model"))
    assert (model.metadata["selected_trees"], model.weight, model.semantic, len(model.features)) == ("2", 0.25, family != "text", 66 if family == "e5-features" else 57)
    cli.main(["predict", *base, "--queries", str(tmp_path / "queries.parquet"), "--out", str(tmp_path / "answer")])
    rows = {r["query_id"]: r["answer"].split(" ") for r in spark.read.option("header", True).csv(str(tmp_path / "answer")).collect()}
    assert set(rows) == {"q" * 16, "r" * 16} and all(len(set(v)) == 50 for v in rows.values())
    assert int(rows["q" * 16][0], 16) % 10 == 0
