"""Queries against their SQL over more distinct words than the cap of the stored pipeline's index."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark.operators import index
from quillspark.plans import lexical, ranking
from quillspark.plans.corpus import Corpus
from quillspark.sources import views

SMALL = "/root/testdata/sf0.001"
QUERIES = ["bm25_topk", "answer_lines", "field_bm25", "grid_best", "location_factor", "loss_decomposition", "masked_blend", "rating_filter", "search_answer", "stem_bm25_topk", "term_idf", "balanced_pairs", "blend_rank", "bm25_weights"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Words of documents 0 to 375 stand twice, so that a cap would cut those of the last ones, which the searches ask for."""
    d = tmp_path_factory.mktemp("words")
    for f in os.listdir(SMALL):
        if f not in ("documents.parquet", "benchmark.parquet"):
            os.symlink(f"{SMALL}/{f}", d / f)
    words = [[f"w{i}x{j}" for j in range(100, 900)] for i in range(100, 520)]
    rows = []
    for i, own in enumerate(words):
        text = " ".join([*own, *own] if i < 376 else [*own, *words[i - 1][:3]])
        rows.append((i, f"Plain title\n{text}", "en", f"src{i % 20}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sum(map(len, words)) > index.MAX_TERMS
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, " ".join(words[400 + i][:10])) for i in range(12)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def shared():
    """One corpus for all queries, whose tables are written once."""
    made = {}
    with pytest.MonkeyPatch.context() as m:
        for module in (lexical, ranking):
            m.setattr(module, "Corpus", lambda spark, d, cyrillic=False: made.setdefault((d, cyrillic), Corpus(spark, d, cyrillic)))
        yield


def compare(spark, name, folder, out):
    __spark_entry__.queries()[name](spark, folder).write.parquet(out)
    c = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    c.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    names = ", ".join(r[0] for r in c.execute("DESCRIBE want").fetchall())
    c.execute(f"CREATE TABLE got AS SELECT {names} FROM read_parquet('{out}/*.parquet')")
    assert c.execute("SELECT count(*) FROM want").fetchall()[0][0] > 0
    assert c.execute("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []
    assert c.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []


@pytest.mark.parametrize("name", QUERIES)
def test_no_word_is_cut(spark, folder, shared, tmp_path, name):
    compare(spark, name, folder, f"{tmp_path}/out")


def test_no_gram_is_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MAX_GRAMS", 500)
    compare(spark, "char_tfidf_topk", SMALL, f"{tmp_path}/out")


def test_pairs_alone_are_judged(spark, tmp_path, monkeypatch):
    """Gold among given pairs, without a loop over all texts; shuffled where there are many pairs."""
    spark.createDataFrame([(1, "x one two"), (2, "two"), (3, None), (4, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two"), (8, "two"), (9, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked = [(f"{q:016x}", f"{i:016x}") for q, i in ((7, 1), (7, 2), (7, 3), (8, 2), (9, 4))]
    pairs = spark.createDataFrame(asked, "query_id string, item_id string")
    every = {tuple(r) for r in views.gold(spark, str(tmp_path)).collect()}
    assert len(every) == 5
    for most in (views.BROADCAST_PAIRS, 1):
        monkeypatch.setattr(views, "BROADCAST_PAIRS", most)
        got = views.gold(spark, str(tmp_path), pairs)
        assert sorted(map(tuple, got.collect())) == sorted(every & set(asked))
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_lengths_at_hand_give_the_same_weights(spark):
    items = spark.createDataFrame([(0, "aa cc", "", "bb bb"), (1, "bb", "dd", "cc"), (2, "", "", "")], "item_pos long, title string, params string, description string")
    counts, terms = index.term_counts(items), spark.createDataFrame([("bb",), ("dd",)], "term string")
    lengths = index.field_lengths(counts)
    asked = counts.join(terms, "term", "left_semi")
    for want, got in (
        (index.bm25(index.joint(counts), 3, terms=terms), index.bm25(index.joint(asked), 3, lengths=index.joint_lengths(lengths))),
        (index.bm25(counts, 3, ("field",), terms=terms), index.bm25(asked, 3, ("field",), lengths=lengths)),
    ):
        assert want.count() > 0 and sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_a_model_is_trained_without_judging_all_pairs(spark, folder, shared, monkeypatch):
    calls = []
    plain = views.gold
    monkeypatch.setattr(views, "gold", lambda s, d, *pairs: calls.append(pairs) or plain(s, d, *pairs))
    answers = ranking.train_and_rank(spark, folder)
    assert answers.count() > 0 and len(calls) == 1 and len(calls[0]) == 1
