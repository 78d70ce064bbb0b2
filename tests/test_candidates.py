"""Blends over all candidates of a search, not over those that are best by BM25 alone."""

import hashlib

import pytest
from test_vocabulary import compare

from quillspark.plans import corpus, ranking
from quillspark.plans.corpus import Corpus


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Odd places hold the searches' words more often: the 60 best by BM25 are all outside the mask."""
    d = tmp_path_factory.mktemp("many")
    rows = [(i, f"plain title {i}\n" + " ".join(["alpha beta"] * (9 if i % 2 else 1) + [f"own{i}"] * (i % 5)), "en", f"src{i % 20}", 50) for i in range(120)]
    rows += [(120, None, "en", "src1", 0), (121, "", "en", "src1", 0), (122, "nothing asked", "de", "src2", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, "alpha"), (8, "beta alpha unknown"), (9, "own3 alpha")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_masked_blend_ranks_all_candidates(spark, many):
    scored = {}
    for r in Corpus(spark, many).scored.collect():
        scored.setdefault(r["query_id"], {})[r["item_pos"]] = r["score"]
    want, beyond = set(), 0
    for q, scores in scored.items():
        second = {i: round(int(hashlib.md5(f"{q}|{i}".encode()).hexdigest()[:6], 16) / 16777216, 6) for i in scores}
        found, model = ({i: k for k, i in enumerate(sorted(by, key=lambda i: (-by[i], i)), 1)} for by in (scores, second))
        mixed = {i: 0.25 / (60 + model[i]) + 0.75 / (60 + found[i]) for i in scores if i % 2 == 0}
        best = sorted(mixed, key=lambda i: (-mixed[i], i))[:20]
        beyond += sum(found[i] > 50 for i in best)
        want |= {(q, i, k) for k, i in enumerate(best, 1)}
    got = [(r["query_id"], r["item_pos"], r["rank"]) for r in ranking.masked_blend(spark, many).collect()]
    assert len(want) == 60 and beyond > 20
    assert sorted(got) == sorted(want)


def test_masked_blend_is_its_sql(spark, many, tmp_path):
    compare(spark, "masked_blend", many, f"{tmp_path}/out")


@pytest.mark.parametrize("small", [False, True])
def test_scores_alone_are_the_scores(spark, many, small):
    c = Corpus(spark, "/root/testdata/sf0.001" if small else many)
    want, got = (sorted(map(tuple, df.select("query_id", "item_pos", "score").collect())) for df in (c.scored, c.scored_alone))
    assert len(want) > 50 and got == want


def test_scores_alone_write_no_items_and_no_other_terms(spark, many, monkeypatch):
    kept = []
    plain = corpus.keep
    monkeypatch.setattr(corpus, "keep", lambda df: kept.append(plain(df)) or kept[-1])
    Corpus(spark, many).scored_alone.collect()
    assert not any("description" in df.columns for df in kept)
    counts = next(df for df in kept if df.columns == ["item_pos", "term", "tf"])
    assert {r["term"] for r in counts.select("term").distinct().collect()} == {None, "alpha", "beta", "own3"}
