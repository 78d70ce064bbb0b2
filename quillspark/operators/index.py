"""Inverted indexes as postings tables: term counts, BM25 and character n-gram TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIGITS
from ..functions.stemmer import stem_words
from ..functions.text import char_ngrams, tokenize

#: Times that a field counts in the joint index, BM25's constants, the caps on terms.
FIELD_WEIGHTS = {"title": 3, "params": 1, "description": 1}
K1, B = 1.5, 0.75
MAX_TERMS, MAX_GRAMS, MAX_PRIOR_GRAMS = 300_000, 180_000, 120_000


def term_counts(items: DataFrame, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS)) -> DataFrame:
    """(item_pos, field, term, tf): counts of the tokens, all fields in one pass."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(tokenize(F.col(f)), F.lit([]).cast("array<string>")).alias("terms")) for f in fields])
    rows = items.select("item_pos", F.explode(parts).alias("p")).select("item_pos", "p.field", F.explode("p.terms").alias("term"))
    return rows.groupBy("item_pos", "field", "term").agg(F.count("*").cast("double").alias("tf"))


def asked_counts(items: DataFrame, asked: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(item_pos, term, tf): as ``joint`` of ``term_counts`` for the terms of ``asked`` (distinct); all others of
    an item are counted together under null, so that sums of tf are whole lengths."""
    parts = F.array(*[F.struct(F.lit(float(w)).alias("times"), F.coalesce(tokenize(F.col(f)), F.lit([]).cast("array<string>")).alias("terms")) for f, w in (weights or FIELD_WEIGHTS).items()])
    rows = items.select("item_pos", F.explode(parts).alias("p")).select("item_pos", "p.times", F.explode("p.terms").alias("_token"))
    return rows.join(asked.select("term"), F.col("_token") == F.col("term"), "left").groupBy("item_pos", "term").agg(F.sum("times").alias("tf"))


def joint(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(item_pos, term, tf): the fields' counts, each as often as its weight says."""
    return counts.groupBy("item_pos", "term").agg(F.sum(F.col("tf") * _times(weights)).alias("tf"))


def _times(weights: dict[str, int] | None = None) -> Column:
    return F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in (weights or FIELD_WEIGHTS).items()])


def field_lengths(counts: DataFrame) -> DataFrame:
    """(item_pos, field, len) of the fields' counts."""
    return counts.groupBy("item_pos", "field").agg(F.sum("tf").alias("len"))


def joint_lengths(lengths: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(item_pos, len): the lengths in the joint index."""
    return lengths.groupBy("item_pos").agg(F.sum(F.col("len") * _times(weights)).alias("len"))


def capped(counts: DataFrame, most: int | None, least_df: int = 1) -> DataFrame:
    """(term, df): the most frequent terms over the corpus, ties by term; with None all of them."""
    totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where(F.col("df") >= least_df)
    return (totals if most is None else totals.orderBy(F.desc("cf"), "term").limit(most)).select("term", "df")


def stems_of(terms: DataFrame) -> DataFrame:
    """(term, stem) of a table of terms; each distinct one is stemmed once."""
    return terms.select("term").distinct().withColumn("stem", stem_words("term"))


def stemmed(counts: DataFrame, stems: DataFrame) -> DataFrame:
    """Counts merged by stem; terms that ``stems`` lacks, as behind a cap, go."""
    keys = [c for c in counts.columns if c not in ("term", "tf")]
    return counts.join(stems, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def frequencies(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(term, [keys,] df): in how many items each term is."""
    return counts.groupBy("term", *keys).agg(F.count("*").cast("double").alias("df"))


def bm25(counts: DataFrame, n_items: int, keys: tuple[str, ...] = (), terms: DataFrame | None = None, lengths: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """Adds idf and the weight w to (item_pos, [keys,] term, tf); n_items counts empty items too, ``keys``
    separates fields. With ``terms`` only their postings are weighted, by the lengths of whole items; with
    ``lengths`` (item_pos, [keys,] len) of those, counts may hold the postings of some terms only; ``df`` are
    stored frequencies of the terms."""
    # the sum of the lengths is that of the counts, so the mean needs no second pass over items
    sizes, size = (counts, "tf") if lengths is None else (lengths, "len")
    mean = sizes.groupBy(*keys).agg(F.greatest(F.sum(size) / F.lit(float(n_items)), F.lit(1.0)).alias("mean_len"))
    if lengths is None:
        lengths = counts.groupBy("item_pos", *keys).agg(F.sum("tf").alias("len"))
    kept = counts if terms is None else counts.join(terms.select("term").distinct(), "term", "left_semi")
    df = frequencies(kept, keys) if df is None else df
    rows = kept.join(df, ["term", *keys]).join(lengths, ["item_pos", *keys])
    rows = rows.join(F.broadcast(mean), list(keys)) if keys else rows.crossJoin(F.broadcast(mean))  # one row for each field
    scale = K1 * (1 - B + B * F.col("len") / F.col("mean_len"))
    weight = (K1 + 1) * F.col("tf") / (F.col("tf") + scale) * idf(F.lit(float(n_items)), F.col("df"))
    return rows.select("item_pos", *keys, "term", "tf", "len", idf(F.lit(float(n_items)), F.col("df")).alias("idf"), weight.alias("w"))


def gram_counts(texts: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    return texts.select(key, F.explode(char_ngrams(F.col(text), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))


def tfidf(counts: DataFrame, n_texts: int, most: int | None = None, least_df: int = 2) -> DataFrame:
    """(term, idf): vocabulary of gram counts with smooth idf."""
    return capped(counts, most, least_df).select("term", (F.log((1 + F.lit(float(n_texts))) / (1 + F.col("df"))) + 1).alias("idf"))


def project(counts: DataFrame, key: str, vocabulary: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Unit TF-IDF rows (key, term, w) of sublinear counts in a given vocabulary; with ``terms`` only
    those columns of the rows."""
    rows = counts.join(vocabulary, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    kept = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")
    return kept.join(norm, key).select(key, "term", (F.col("v") / F.col("norm")).alias("w"))


def score(query_terms: DataFrame, postings: DataFrame, weight: Column | None = None, target: str = "item_pos") -> DataFrame:
    """(query_id, target, score): inner join on terms and sum, rounded. Zero scores never arise."""
    value = F.col("w") if weight is None else weight
    rows = query_terms.join(postings, "term")
    return rows.groupBy("query_id", target).agg(F.round(F.sum(value), DIGITS).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, by: str = "score", tie: str = "item_pos", group: str = "query_id") -> DataFrame:
    """The k best of each query with ``rank``: score down, then position up."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, text: str = "search_query") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))


def stem_terms(queries: DataFrame, text: str = "search_query", shortest: int = 2) -> DataFrame:
    """Distinct stems of the searches; retrieval keeps those of two or more characters."""
    terms = query_terms(queries, text)
    return terms.join(stems_of(terms), "term").where(F.length("stem") >= shortest).select("query_id", F.col("stem").alias("term")).distinct()
