import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import pipeline
from quillspark.config import SearchConfig
from quillspark.operators import blend, geo, index, metrics, prior, quality, retrieve, sampling


def test_docs_are_found_and_index_follows_the_catalogue(spark):
    schema = "item_pos long, title string, params string, description string"
    q = spark.createDataFrame([("q", "ремонт")], "query_id string, search_query string")
    for texts, best in ((("ремонт", "маникюр"), 0), (("маникюр", "ремонт"), 1)):
        items = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], schema)
        w = index.bm25(index.joint(pipeline.stem_counts(items)), items.count())
        assert [r["item_pos"] for r in index.top(index.score(index.stem_terms(q), w), 5).collect()] == [best]


def test_bm25_by_hand(spark):
    items = spark.createDataFrame([(0, "aa", "", "bb"), (1, "bb", "", ""), (2, "", "", "")], "item_pos long, title string, params string, description string")
    import math

    got = {(r["item_pos"], r["term"]): r["w"] for r in index.bm25(index.joint(index.term_counts(items)), 3).collect()}
    mean = max((4 + 3 + 0) / 3, 1)

    def weight(tf, length, df):
        return 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * length / mean)) * math.log1p((3 - df + 0.5) / (df + 0.5))

    assert got == pytest.approx({(0, "aa"): weight(3, 4, 1), (0, "bb"): weight(1, 4, 2), (1, "bb"): weight(3, 3, 2)})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("a", 10, "x", 1), ("a", 10, "y", 2), ("b", 10, "z", 2), ("c", 20, "u", 1), ("d", 20, "v", 1)]
    return spark.createDataFrame(rows, "query_norm string, search_location_id long, item_id string, item_location_id long")


def test_geo_counts_and_repeats(spark, labels):
    for pairs in (labels, labels.unionByName(labels.where("item_id = 'x'").crossJoin(spark.range(99)).drop("id"))):
        got = {(r[0], r[1]): r[2] for r in geo.fit(pairs).counts.collect()}
        assert got == pytest.approx({(10, 1): 0.5, (10, 2): 1.5, (20, 1): 2.0})


def test_geo_signal(spark, labels):
    got = {(r[0], r[1]): r[2] for r in geo.signal(geo.fit(labels), 2, 0).collect()}
    assert got[(10, 2)] == pytest.approx(0.5) and (99, 1) not in got and (10, 99) not in got


def factors(spark, labels, locations, catalogue, config):
    rows = spark.createDataFrame([(10, x) for x in locations], "search_location_id long, location_id long")
    here = spark.createDataFrame([(x,) for x in catalogue], "location_id long")
    got = {r["location_id"]: r["factor"] for r in geo.with_factor(rows, here, geo.fit(labels), config).collect()}
    return [got[x] for x in locations]


def test_location_factor_prefers_what_was_learned(spark, labels):
    a, b, c = factors(spark, labels, [2, 1, 99], [1, 2, 99], SearchConfig(alpha=2, geo_strength=32))
    assert a > b > c


def test_location_factor_for_missing_sources_only(spark, labels):
    assert factors(spark, labels, [10, 2, 99], [10, 2, 99], SearchConfig(alpha=2, geo_strength=32, scope="missing")) == [8, 1, 1]


def catalogue(spark, n=60):
    return spark.range(n).select(F.col("id").alias("item_pos"), F.lpad(F.lower(F.hex("id")), 16, "0").alias("item_id"), F.lit(1).cast("long").alias("location_id"), F.lit(114).cast("long").alias("category_id"), F.lit(7).cast("long").alias("microcat_id"))


def test_empty_search_falls_back_to_the_first_positions(spark):
    q = spark.createDataFrame([("q", 2)], "query_id string, search_location_id long")
    pools = spark.createDataFrame([(c, "q", i, 0.0) for c in ("stem", "char") for i in range(3)], "channel string, query_id string, item_pos long, score double")
    p = spark.createDataFrame([("q", 7, 0.4)], "query_id string, item_microcat_id long, p double")
    got = retrieve.search(pools, catalogue(spark), q, SearchConfig(), prior=p).orderBy("rank").collect()
    assert [r["item_pos"] for r in got] == list(range(50))


def test_single_channel_has_no_fill(spark):
    q = spark.createDataFrame([("q", 2)], "query_id string, search_location_id long")
    pools = spark.createDataFrame([("stem", "q", 4, 1.0), ("stem", "q", 5, 2.0)], "channel string, query_id string, item_pos long, score double")
    got = retrieve.search(pools, catalogue(spark), q, SearchConfig(channels={"stem": 1.0})).orderBy("rank").collect()
    assert [r["item_pos"] for r in got] == [5, 4]


def test_union_of_empty_pools(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    pools = spark.createDataFrame([("q", 4, 0.0), ("q", 5, 0.0)], "query_id string, item_pos long, score double")
    got = retrieve.union_candidates(pools, q, catalogue(spark, 100))
    assert sorted(r["item_pos"] for r in got.collect()) == list(range(50))


def test_training_selection(spark):
    rows = [("q", i, float(i), i == 0, i in (0, 1)) for i in range(6)]
    schema = "query_id string, item_pos long, rrf double, is_gold boolean, is_known boolean"
    got = sampling.training_selection(spark.createDataFrame(rows, schema), 1)
    assert sorted(r["item_pos"] for r in got.collect()) == [0, 2, 3, 4, 5]
    nothing = [("q", i, float(i), False, False) for i in range(3)]
    assert sampling.training_selection(spark.createDataFrame(nothing, schema), 1).count() == 0


def test_balanced_pairs(spark):
    y = [("a", 0, 1), ("a", 1, 0), ("b", 2, 1), ("b", 3, 1), ("b", 4, 0), ("b", 5, 0), ("b", 6, 0), ("c", 7, 1)]
    got = sampling.balanced_pairs(spark.createDataFrame(y, "query_id string, item_pos long, y int")).collect()
    total = {}
    for r in got:
        total[r["query_id"]] = total.get(r["query_id"], 0) + r["weight"]
    assert total == pytest.approx({"a": 192, "b": 192}) and len(got) == 7


def test_recall(spark):
    rows = [(["a", "a", "x"], ["a", "b", "outside"]), (["x"] * 50 + ["a"], ["a"]), (["a"], [])]
    got = spark.createDataFrame(rows, "p array<string>, g array<string>").select(metrics.recall(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in got] == pytest.approx([1 / 3, 0, 0])


@pytest.mark.parametrize(("weight", "order"), [(1, [1, 2, 0]), (0, [0, 1, 2])])
def test_blend_ends(spark, weight, order):
    rows = spark.createDataFrame([("q", 0, 0.0, 3.0), ("q", 1, 1.0, 2.0), ("q", 2, 1.0, 1.0)], "query_id string, item_pos long, prediction double, rrf double")
    assert [r["item_pos"] for r in blend.blend(rows, weight).orderBy("rank").collect()] == order


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 0.5, 1.0, 2.0]), min_size=1, max_size=12), st.integers(1, 12))
def test_top_breaks_ties_by_position(spark, scores, k):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores)], "query_id string, item_pos long, score double")
    got = [r["item_pos"] for r in index.top(rows, k).orderBy("rank").collect()]
    assert got == sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k]


def test_prior_is_a_share(spark):
    pairs = spark.createDataFrame([("blue chair", 1), ("blue chair", 2), ("blue table", 1), ("red lamp", 3)], "query_norm string, item_microcat_id long")
    q = spark.createDataFrame([("q", "blue chairs"), ("z", "xyz")], "query_id string, search_query string")
    got = prior.prior(pairs, q)
    assert got.groupBy("query_id").agg(F.sum("p").alias("s")).where("s > 1.00001").count() == 0 and got.where("query_id = 'z'").count() == 0
    assert got.orderBy(F.desc("p")).first()["item_microcat_id"] == 1


def test_splits_are_disjoint_and_contexts_match(spark):
    texts = spark.range(60).select(F.col("id").cast("string").alias("query_norm"))
    got = sampling.split(texts, 1, previous=(2,), size=10, gone=15)
    counts = {r[0]: r[1] for r in got.groupBy("split").count().collect()}
    assert counts == {"previous": 15, "val": 10, "test": 10, "fit": 25} and got.select("query_norm").distinct().count() == 60
    pairs = spark.createDataFrame([("t", "t", 1, None, "", 5, "a"), ("t", "t", 1, None, None, 5, "b"), ("t", "t", 2, None, "", 5, "c")], "query_norm string, search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long, item_id string")
    row = sampling.select_contexts(pairs, pairs.select("query_norm").distinct(), "val", 3).first()
    assert row["known_positives"] == ["a", "b", "c"] and row["gold"] in (["a", "b"], ["c"])
    with pytest.raises(ValueError):
        sampling.assert_disjoint(pairs, pairs)


def test_bootstrap_holds_the_mean(spark):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("v"))
    low, high = metrics.bootstrap(rows, "v", repeats=300).first()
    assert low < 4.5 < high and high - low < 1.2


@pytest.mark.parametrize("values", [[0.0, 1.0], [3.0]])
def test_bootstrap_of_equal_rows(spark, values):
    rows = spark.range(400).select(F.element_at(F.lit(values), (F.col("id") % len(values) + 1).cast("int")).alias("v"))
    low, high = metrics.bootstrap(rows, "v", repeats=500).first()
    mean = sum(values) / len(values)
    assert low <= mean <= high and (high - low < 0.15 if len(values) > 1 else low == high)
    assert tuple(metrics.bootstrap(rows.repartition(7), "v", repeats=500).first()) == pytest.approx((low, high))
    assert tuple(metrics.bootstrap(rows.where("false"), "v", repeats=5).first()) == (None, None)


def test_paired_interval(spark):
    a = spark.range(300).select("id", F.lit(0.5).alias("v"))
    r = metrics.paired_interval(a, a.withColumn("v", F.col("v") + (F.col("id") % 3) / 10), "id", "v", repeats=400).first()
    assert r["n"] == 300 and r["mean_delta"] == pytest.approx(0.1) and r["low"] < 0.1 < r["high"] and r["high"] - r["low"] < 0.05


def test_quality(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2), ("a", "y", 3)], "item_id string, t string, n int")
    assert {r["column"]: r["nulls"] for r in quality.null_counts(df).collect()} == {"item_id": 0, "t": 1, "n": 0}
    kept = quality.dedup_catalogue(df.where("n = 3"), df.where("n < 3"), "item_id", "n").collect()
    assert {(r["item_id"], r["n"]) for r in kept} == {("a", 3), ("b", 2)}


def test_views_hold_whole_texts(spark, tmp_path):
    from quillspark.sources import views

    first = "Title " + "word " * 30 + "end"
    long = "\n" + first + "\n" + "more " * 600 + "last"
    question = "a question that is well above thirty characters long"
    rows = [(1, long, "en", "src1", 5), (2, "x " + question + " y", "en", "src1", 5), (3, question[:40], "en", "src1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_pos"]: r for r in views.items(spark, str(tmp_path)).collect()}
    assert got[0]["title"] == first.lower() and got[0]["description"] == " ".join(long.lower().split())
    assert [r["item_id"] for r in views.gold(spark, str(tmp_path)).collect()] == ["0" * 15 + "2"]


def test_dense_searches_grow_with_the_table(spark, tmp_path):
    from quillspark.plans import ranking

    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(101)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["query_id"] for r in ranking.cosine_topk(spark, str(tmp_path)).collect()} == {f"q{i}" for i in range(0, 101, 20)}


def test_queries_run_over_whole_tables(spark, tmp_path):
    from quillspark.operators import blend, features, quality, retrieve
    from quillspark.plans import lexical, ranking
    from quillspark.sources import views

    d = str(tmp_path)
    rows = [(i, f"alpha{i} beta{i} gamma", "en", "src1", 5) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(5, "alpha7 beta8 gamma"), (6, "alpha7 nowhere")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # searches and filters, "alpha7 beta8 gamma" with "en src1" and "alpha7 nowhere" with none
    assert [round(r["query_oov_fraction"], 6) for r in lexical.oov_fraction(spark, d).orderBy("query_id").collect()] == [0.0, 0.5]
    got = ranking.dedup_catalogue(spark, d).collect()
    assert sum(r["priority"] == 0 and r["title_md5"] != "later" for r in got) == 24 and sum(r["priority"] == 1 for r in got) == 24
    filled = ranking.fallback_fill(spark, d).where(f"query_id = '{5:016x}'").orderBy("rank").collect()
    assert [r["item_pos"] for r in filled][:2] == [7, 8] and len(filled) == 24
    # the half catalogues that the queries had: unknown terms, a second source, a short answer
    items = views.items(spark, d)
    half = items.where("item_pos % 2 = 0")
    vocabulary = lexical.index.term_counts(half)
    assert {round(r["query_oov_fraction"], 3) for r in features.oov_fraction(views.queries(spark, d), vocabulary).collect()} == {0.333, 1.0}
    assert quality.dedup_catalogue(half, items, "item_id", "item_pos").where("priority = 1").count() == 12
    short = lexical.bm25_topk(spark, d).where("item_pos % 3 = 0").withColumn("rank", blend.ordinal("score"))
    assert retrieve.fill(short, views.queries(spark, d), items).groupBy("query_id").count().where("count = 24").count() == 2


def test_the_first_fifty_are_judged_against_the_whole_pool(spark, tmp_path, monkeypatch):
    from quillspark.plans import ranking
    from quillspark.sources import views

    d = str(tmp_path)
    text = "one question that all of these documents hold"
    rows = [(i, text, "en", "src1", 5) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(5, text)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, columns in (("orders", "o_orderkey long, o_custkey long"), ("lineitem", "l_orderkey long, l_suppkey long"), ("customer", "c_custkey long, c_nationkey int"), ("supplier", "s_suppkey long, s_nationkey int, s_acctbal double")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{name}.parquet")
    r = ranking.loss_decomposition(spark, d).first()
    assert (r["recall"], r["ranking_loss"], r["retrieval_loss"]) == (0.125, 0.875, 0.0)
    assert ranking.candidate_coverage(spark, d).first()["coverage"] == 1.0
    one = views.gold(spark, d).where(f"item_id <> '{0:016x}'").limit(1)
    monkeypatch.setattr(views, "gold", lambda *_: one)
    assert ranking.negative_sampling(spark, d).count() > 14


def test_dense_search_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50] = v[60] = v[70]
    items = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "item_pos long, vector array<double>, location_id long").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v[i].tolist(), i % 3) for i in range(0, 300, 50)], "query_id string, vector array<double>, search_location_id long")
    pairs = spark.createDataFrame([(f"t{i}", i % 3, f"{i}", (i * 7) % 4) for i in range(60)], "query_norm string, search_location_id long, item_id string, item_location_id long")
    model, config = geo.fit(pairs), SearchConfig()
    for block in (2, 100):
        found = retrieve.dense_top(retrieve.dense(q, items, 20, model=model, config=config, block=block), 20)
        got = {}
        for r in found.collect():
            got.setdefault((r["query_id"], r["kind"]), []).append((r["rank"], r["item_pos"]))
        rows = geo.with_factor(q.select("query_id", "search_location_id").crossJoin(items.select("item_pos", "location_id")), items, model, config)
        factor = {(r["query_id"], r["item_pos"]): r["factor"] for r in rows.collect()}
        for i in range(0, 300, 50):
            cos = np.round(v @ v[i], 4)
            geo_score = np.round(cos + config.e5_geo * np.log([factor[f"q{i}", j] for j in range(300)]), 4)
            for kind, score in (("global", cos), ("geo", geo_score)):
                assert [p for _, p in sorted(got[f"q{i}", kind])] == sorted(range(300), key=lambda j: (-score[j], j))[:20]


def test_stems_join_the_fields_vocabulary(spark):
    """An inflected search meets another form in one field; the other fields lack the stem but know it."""
    import math

    from quillspark.operators import features

    items = spark.createDataFrame([(0, "ремонт вагона", "", "старый", 4.5), (1, "старая", "", "дом", 4.0)], "item_pos long, title string, params string, description string, rating double")
    q = spark.createDataFrame([("q", "вагонов", "рейтинг пользователя 4,5 звезды и выше старые", 1)], "query_id string, search_query string, search_params string, n int")
    counts = pipeline.stem_counts(items)
    assert features.oov_fraction(q, index.joint(counts)).first()["query_oov_fraction"] == 0
    r = {x["item_pos"]: x for x in features.field(spark.createDataFrame([("q", 0), ("q", 1)], "query_id string, item_pos long"), items, q, counts, 2).collect()}
    idf = math.log1p((2 - 1 + 0.5) / 1.5)
    w = 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5)) * idf
    assert r[0]["title_log_bm25"] == pytest.approx(math.log1p(w)) and r[0]["title_normalized_bm25"] == pytest.approx(w / idf) and r[0]["title_query_coverage"] == 1
    assert r[0]["description_normalized_bm25"] == 0 and r[1]["title_log_bm25"] == 0 and r[0]["params_filter_log_bm25"] == 0
    assert (r[0]["rating_filter_match"], r[1]["rating_filter_match"]) == (1, -1) and r[1]["rating_filter_gap"] == -0.5
