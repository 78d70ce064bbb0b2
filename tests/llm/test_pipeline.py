import random

import pytest
from helpers import awkward, empty, plain_clean, plain_lines, plain_mix, prose
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language_id


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, " ".join(f"question{i}" for i in range(14))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("place", range(5))
def test_stage_on_awkward_and_empty_rows(spark, bench_dir, place):
    name, stage = corpus_pipeline.STAGES[place]
    for rows in (awkward(spark), empty(spark)):
        out = stage(spark, rows, bench_dir)
        got = out.collect()
        assert len(got) <= rows.count()
        if place < 4:
            assert out.columns == rows.columns
            assert all(r["component"] == "own component" for r in got)
        assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in rows.collect()}


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, bench_dir):
    rng = random.Random(1)
    clean = [(i, "\n".join(" ".join(f"{rng.choice(['the', 'of', 'und', 'der'])} word{rng.randint(0, 9999)}" for _ in range(20)) for _ in range(4)), "en", "s") for i in range(40)]
    text = clean[0][1]
    near = text.replace(text.split()[3], "changed", 1)
    leak = clean[1][1] + "\n" + " ".join(f"question{i}" for i in range(14))
    rows = clean + [(100, text, "en", "s"), (101, near.replace("\n", " "), "en", "s"), (102, leak.replace(clean[1][1].split()[1], "other") + " " + prose(60, 5), "en", "s"), (103, "12 34", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.mode("overwrite").parquet(f"{bench_dir}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, bench_dir)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {*range(40), 102}
    assert "question3" not in got[102]["text"] and all(r["n_chars"] == len(r["text"]) for r in got.values())
    mixed = corpus_pipeline.run(spark, bench_dir)
    assert {r["doc_id"] for r in mixed.collect()} <= set(got) and mixed.agg(F.sum("taken")).first()[0] > 0


def test_rows_that_share_an_id_are_kept(spark, bench_dir):
    rng = random.Random(8)
    text = ["\n".join(" ".join(f"the of {rng.randint(0, 9999)}w" for _ in range(12)) for _ in range(3)) for _ in range(5)]
    rows = [(1, text[0], "a"), (1, text[1], "b"), (1, text[1], "b"), (2, text[0], "c"), (3, text[2], "d"), (None, text[3], "e"), (None, text[4], "f"), (None, text[4], "f"), (None, text[2], "g"), (4, None, "h"), (4, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["text"] or "", r["source"]) for r in corpus_pipeline.stage_near_duplicates(spark, docs, bench_dir).collect())
    # equal texts of different rows are one group; of two ids that share a text, the one of its own stays
    assert [t for t, _ in got] == sorted([text[0], text[1], text[2], text[3], text[4], "", ""])
    assert dict(got)[text[2]] == "d" and dict(got)[text[0]] == "c"
    apart = corpus_pipeline.stage_lines(spark, docs.where("source in ('a', 'b', 'e')").distinct(), bench_dir)
    assert {r["text"] for r in apart.collect()} == {text[0], text[1], text[3]}


def test_stages_against_plain_versions(spark):
    """The middle stages of a small slice of the real documents, done in memory."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    accepted = corpus_pipeline.stage_language(spark, docs, d)
    model = language_id.Model(language_id.fit(docs.where(language_id.fold() != 2)))
    expected = {r["doc_id"] for r in docs.collect() for lang, score in [model.predict(r["text"])] if lang != "und" and score >= language_id.MIN_MARGIN}
    assert {r["doc_id"] for r in accepted.collect()} == expected
    lines = corpus_pipeline.stage_lines(spark, accepted, d)
    plain = {k: v for k, v in plain_lines({r["doc_id"]: r["text"] for r in accepted.collect()}).items() if v and v.strip()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == plain
    kept = {r["doc_id"] for r in corpus_pipeline.stage_near_duplicates(spark, lines, d).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in plain.items() for w in [t.encode().lower().split()]}
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert kept == {k for k in label if label[k] == k}
    # benchmark: words of windows go, with what stands between them; documents that are mostly benchmark go
    near = corpus_pipeline.stage_near_duplicates(spark, lines, d)
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    cleaned = {k: plain_clean(plain[k], items) for k in kept}
    cleaned = {k: t for k, t in cleaned.items() if t is not None and t.strip()}
    clean = corpus_pipeline.stage_benchmark(spark, near, d)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == cleaned
    # the mix takes what the plain mix takes
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    _, target, taken = plain_mix([(k, source[k], len(t.encode().split())) for k, t in cleaned.items()])
    mixed = {r["doc_id"]: r for r in corpus_pipeline.stage_mix(spark, clean, d).collect()}
    assert {k: r["taken"] for k, r in mixed.items()} == {k: n for k, n in taken.items() if n}
    assert all(r["target"] == pytest.approx(target[source[k]]) and r["text"] == cleaned[k] for k, r in mixed.items())
