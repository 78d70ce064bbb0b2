"""Queries of text, indexes and lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import stemmer
from ..operators import features, index
from ..sources import views
from ..sources.views import cyrillic_sql, norm_sql, with_views
from .corpus import Corpus

TOKEN = T.TOKEN


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def normalize_text(spark, d):
    return views.read(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text_norm"))


def tokenize(spark, d):
    rows = views.read(spark, d, "documents").select("doc_id", T.tokenize(T.normalize(F.coalesce("text", F.lit("")))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def term_idf(spark, d):
    c = Corpus(spark, d)
    df = c.counts.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    return df.select("term", F.col("df").cast("long").alias("df"), F.round(index.idf(F.lit(float(c.n)), F.col("df")), 6).alias("idf"))


def bm25_weights(spark, d):
    c = Corpus(spark, d)
    return index.bm25(c.counts, c.n).select("item_pos", "term", F.round("w", 6).alias("w"))


def bm25_topk(spark, d):
    return index.top(Corpus(spark, d).scored, 50)


def stem_bm25_topk(spark, d):
    """Over texts in Cyrillic letters, where the stemmer has endings to cut."""
    return index.top(Corpus(spark, d, cyrillic=True).scored, 50)


def field_bm25(spark, d):
    c = Corpus(spark, d)
    postings = index.bm25(c.field_counts, c.n, ("field",), terms=c.terms, lengths=c.lengths)
    scored = c.terms.join(postings, "term").groupBy("query_id", "field", "item_pos").agg(F.round(F.sum("w"), 6).alias("score"))
    return index.top(scored.withColumn("list", F.concat_ws("|", "query_id", "field")), 20, group="list").drop("list")


def char_tfidf_topk(spark, d):
    return index.top(Corpus(spark, d).char_scored, 50)


def phrase_match(spark, d):
    p = Corpus(spark, d).pairs
    first = F.array_join(F.slice(F.split("search_query", " "), 1, 2), " ")
    return p.select("query_id", "item_pos", *[T.phrase_match(F.col("search_query"), F.col(f)).alias(f"{f}_match") for f in features.FIELDS], T.phrase_match(first, F.col("description")).alias("two_words"))


def oov_fraction(spark, d):
    """Stems of the searches against those of all documents, in Cyrillic letters; a search is a benchmark
    text's beginning and, so that some terms are unknown, its filter."""
    c = Corpus(spark, d, cyrillic=True)
    asked = c.queries.withColumn("search_query", F.concat_ws(" ", "search_query", "search_params"))
    return rounded(features.oov_fraction(asked, c.field_counts))


def number_coverage(spark, d):
    docs = views.items(spark, d).select("item_id", "item_pos", "params", "title", "description")
    return docs.select("item_id", F.size(T.numbers(F.col("description"))).cast("long").alias("n_numbers"), F.round(T.number_coverage(F.col("description"), F.concat_ws(" ", "title", "params")), 6).alias("coverage"))


def rating_filter(spark, d):
    p = Corpus(spark, d).pairs
    required = T.required_rating(T.normalize(F.col("search_params")))
    match, gap = features.rating_filter(required, F.col("rating"))
    return p.select("query_id", "item_pos", required.alias("required"), match.alias("rating_match"), gap.alias("rating_gap"))


def field_features(spark, d):
    """The 22 columns by stems, over texts in Cyrillic letters."""
    c = Corpus(spark, d, cyrillic=True)
    return rounded(features.field(c.best, c.items, c.queries, c.field_counts, c.n, c.lengths), 5)


FOUND = (normalize_text, tokenize, term_idf, bm25_weights, bm25_topk, stem_bm25_topk, field_bm25, char_tfidf_topk, phrase_match, oov_fraction, number_coverage, rating_filter, field_features)

# ---- DuckDB twins

QTERMS = f"q_terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(search_query, '{TOKEN}'))) AS term FROM queries_fx)"
TOK = f"""tok AS (SELECT item_pos, unnest(regexp_extract_all(title, '{TOKEN}')) AS term, 3e0 AS m, 'title' AS field FROM items_fx
  UNION ALL SELECT item_pos, unnest(regexp_extract_all(params, '{TOKEN}')), 1e0, 'params' FROM items_fx
  UNION ALL SELECT item_pos, unnest(regexp_extract_all(description, '{TOKEN}')), 1e0, 'description' FROM items_fx)"""
WEIGHTS = """tf AS (SELECT item_pos, term, sum(m) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM items_fx),
lens AS (SELECT item_pos, sum(tf) AS len FROM tf GROUP BY ALL),
mean AS (SELECT greatest(sum(len) / any_value(n), 1e0) AS mean_len FROM lens, n),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
w AS (SELECT item_pos, term, 2.5e0 * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / mean_len)) * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS w
      FROM tf JOIN df USING (term) JOIN lens USING (item_pos), n, mean)"""
INDEX = f"{TOK},\n{WEIGHTS}"
SCORED = "scored AS (SELECT query_id, item_pos, round(sum(w), 6) AS score FROM q_terms JOIN w USING (term) GROUP BY ALL)"
TOP50 = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_pos) AS rank FROM scored WHERE score > 0) WHERE rank <= 50)"
LEXICAL = ",\n".join([QTERMS, INDEX, SCORED, TOP50])
FIELD_INDEX = """ftf AS (SELECT item_pos, field, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
flen AS (SELECT item_pos, field, sum(tf) AS len FROM ftf GROUP BY ALL),
fmean AS (SELECT field, greatest(sum(len) / any_value(n), 1e0) AS mean_len FROM flen, n GROUP BY 1),
fdf AS (SELECT field, term, count(*)::DOUBLE AS df FROM ftf GROUP BY ALL),
fw AS (SELECT item_pos, field, term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf,
       2.5e0 * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / mean_len)) * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS w
       FROM ftf JOIN fdf USING (field, term) JOIN flen USING (item_pos, field) JOIN fmean USING (field), n)"""


def grams_sql(text: str, low: int, high: int) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split({text}, ' '), lambda w: w <> ''), lambda w: "
        f"flatten(list_transform(list_filter(range({low}, {high} + 1), lambda n: n = {low} OR n - 1 < length(w) + 2), lambda n: "
        f"list_transform(range(1, greatest(length(w) + 2 - n + 1, 1) + 1), lambda i: substr(' ' || w || ' ', i, n))))))"
    )


def tfidf_sql(name: str, table: str, key: str, text: str, low: int, high: int) -> str:
    """Postings ``name`` (key, term, w) and vocabulary ``name``_v."""
    return f"""{name}_c AS (SELECT {key}, term, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest({grams_sql(text, low, high)}) AS term FROM {table}) GROUP BY ALL),
{name}_v AS (SELECT term, ln((1 + (SELECT count(*) FROM {table})::DOUBLE) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM {name}_c GROUP BY 1 HAVING count(*) >= 2),
{project_sql(name, name + "_c", key, name + "_v")}"""


def project_sql(name: str, counts: str, key: str, vocabulary: str) -> str:
    return f"""{name}_r AS (SELECT {key}, term, (1 + ln(tf)) * idf AS v FROM {counts} JOIN {vocabulary} USING (term)),
{name} AS (SELECT {key}, term, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS w FROM {name}_r)"""


CHAR = f"""{tfidf_sql("t", "items_fx", "item_pos", "title", 3, 5)},
qc AS (SELECT query_id, term, count(*)::DOUBLE AS tf FROM (SELECT query_id, unnest({grams_sql("search_query", 3, 5)}) AS term FROM queries_fx) GROUP BY ALL),
{project_sql("qt", "qc", "query_id", "t_v")},
cscored AS (SELECT query_id, item_pos, round(sum(t.w * qt.w), 6) AS score FROM qt JOIN t USING (term) GROUP BY ALL HAVING round(sum(t.w * qt.w), 6) > 0)"""
def _ends(word: str, start: str, endings: tuple[str, ...]) -> str:
    """The longest of the endings that lies behind ``start`` (characters), or null."""
    ordered = ", ".join(f"'{e}'" for e in sorted(endings, key=len, reverse=True))
    return f"list_filter([{ordered}], lambda x: ends_with({word}, x) AND length({word}) - length(x) >= {start})[1]"


def _cut_sql(word: str, start: str, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str:
    """``word`` without that ending, or null; endings of ``after_a`` alone need а or я before them."""
    e = _ends(word, start, tuple({*free, *after_a}))
    rest = f"{word}[:length({word}) - length({e})]"
    ok = f"list_contains([{', '.join(f"'{x}'" for x in free)}], {e})"
    if after_a:
        ok = f"({ok} OR length({rest}) > {start} AND (ends_with({rest}, 'а') OR ends_with({rest}, 'я')))"
    return f"CASE WHEN {ok} THEN {rest} END"


def stems_sql(terms: str, name: str = "stems") -> str:
    """``name`` (term, stem) of the distinct terms of a query, step by step as the algorithm is published."""
    v, n = f"[{stemmer.VOWELS}]", f"[^{stemmer.VOWELS}]"
    return f"""{name}_0 AS (SELECT term, CASE WHEN regexp_matches(term, '{v}') THEN length(regexp_extract(term, '^{n}*{v}')) ELSE length(term) END AS rv,
  CASE WHEN regexp_matches(term, '{v}{n}.*?{v}{n}') THEN length(regexp_extract(term, '^.*?{v}{n}.*?{v}{n}')) ELSE length(term) END AS r2 FROM (SELECT DISTINCT term FROM ({terms}))),
{name}_1 AS (SELECT *, {_cut_sql('term', 'rv', stemmer.GERUND_2, stemmer.GERUND_1)} AS gerund, coalesce({_cut_sql('term', 'rv', stemmer.REFLEXIVE)}, term) AS w FROM {name}_0),
{name}_2 AS (SELECT *, {_cut_sql('w', 'rv', stemmer.ADJECTIVE)} AS adjective FROM {name}_1),
{name}_3 AS (SELECT term, rv, r2, CASE WHEN gerund IS NOT NULL THEN gerund WHEN adjective IS NOT NULL THEN coalesce({_cut_sql('adjective', 'rv', stemmer.PARTICIPLE_2, stemmer.PARTICIPLE_1)}, adjective)
  ELSE coalesce({_cut_sql('w', 'rv', stemmer.VERB_2, stemmer.VERB_1)}, {_cut_sql('w', 'rv', stemmer.NOUN)}, w) END AS w FROM {name}_2),
{name}_4 AS (SELECT term, rv, r2, CASE WHEN ends_with(w, 'и') AND length(w) > rv THEN w[:-2] ELSE w END AS w FROM {name}_3),
{name}_5 AS (SELECT term, rv, coalesce({_cut_sql('w', 'r2', stemmer.DERIVATIONAL)}, w) AS w FROM {name}_4),
{name}_6 AS (SELECT term, rv, {_cut_sql('w', 'rv', stemmer.SUPERLATIVE)} AS shorter, w FROM {name}_5),
{name} AS (SELECT term, CASE WHEN ends_with(coalesce(shorter, w), 'нн') AND length(coalesce(shorter, w)) - 2 >= rv THEN coalesce(shorter, w)[:-2]
  WHEN shorter IS NULL AND ends_with(w, 'ь') AND length(w) > rv THEN w[:-2] ELSE coalesce(shorter, w) END AS stem FROM {name}_6)"""


CYRILLIC = f"items_fx AS ({cyrillic_sql('items_fx', 'title', 'params', 'description')}),\nqueries_fx AS ({cyrillic_sql('queries_fx', 'search_query', 'search_params')})"
FILTER = f"regexp_replace({norm_sql('search_params')}, 'рейтинг пользователя\\s+\\d+(?:[.,]\\d+)?\\s*(?:звезд[а-я]*)?\\s*(?:и выше)?', '', 'g')"
#: The index of stems: raw tokens, their stems and those of the searches, then as ``INDEX``.
STEM_INDEX = f"""raw AS (SELECT item_pos, unnest(regexp_extract_all(title, '{TOKEN}')) AS term, 3e0 AS m, 'title' AS field FROM items_fx
  UNION ALL SELECT item_pos, unnest(regexp_extract_all(params, '{TOKEN}')), 1e0, 'params' FROM items_fx
  UNION ALL SELECT item_pos, unnest(regexp_extract_all(description, '{TOKEN}')), 1e0, 'description' FROM items_fx),
q_raw AS (SELECT query_id, unnest(regexp_extract_all(search_query, '{TOKEN}')) AS term, 'query' AS part FROM queries_fx
  UNION ALL SELECT query_id, unnest(regexp_extract_all({FILTER}, '{TOKEN}')), 'filter' FROM queries_fx
  UNION ALL SELECT query_id, unnest(regexp_extract_all(search_params, '{TOKEN}')), 'params' FROM queries_fx),
{stems_sql('SELECT term FROM raw UNION ALL SELECT term FROM q_raw')},
tok AS (SELECT item_pos, stem AS term, m, field FROM raw JOIN stems USING (term)),
q_all AS (SELECT DISTINCT query_id, part, stem AS term FROM q_raw JOIN stems USING (term)),
q_stems AS (SELECT query_id, term FROM q_all WHERE part = 'query'),
q_terms AS (SELECT query_id, term FROM q_stems WHERE length(term) >= 2)"""

PAIRS = "pairs AS (SELECT best.query_id, best.item_pos, items_fx.* EXCLUDE (item_pos), queries_fx.* EXCLUDE (query_id) FROM best JOIN items_fx USING (item_pos) JOIN queries_fx USING (query_id))"
NUM = r"\p{Nd}+"
REQUIRED = f"coalesce(try_cast(replace(regexp_extract({norm_sql('search_params')}, 'рейтинг пользователя\\s+(\\d+(?:[.,]\\d+)?)', 1), ',', '.') AS DOUBLE), 0)"


def _match(query: str, field: str) -> str:
    return f"(CASE WHEN {query} <> '' AND contains({field}, {query}) THEN 1e0 ELSE 0e0 END)"


def _coverage(query: str, text: str) -> str:
    q, t = f"list_distinct(regexp_extract_all({query}, '{NUM}'))", f"list_distinct(regexp_extract_all({text}, '{NUM}'))"
    return f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {t}))::DOUBLE / len({q}) ELSE 0e0 END)"


def _field_columns() -> str:
    out = []
    for f in features.FIELDS:
        out += [
            f"ln(1 + coalesce(w_{f}, 0)) AS {f}_log_bm25",
            f"coalesce(w_{f}, 0) / greatest(coalesce(idf_{f}, 0), 1e-12) AS {f}_normalized_bm25",
            f"coalesce(n_{f}, 0)::DOUBLE / greatest(coalesce(n_terms, 0), 1) AS {f}_query_coverage",
            f"ln(1 + coalesce(len_{f}, 0)) AS {f}_log_length",
            f"{_match('search_query', f)} AS {f}_phrase_match",
        ]
    return ",\n".join("round(" + c.replace(" AS ", ", 5) + 0e0 AS ") for c in out)


def _by_field(value: str, prefix: str, agg: str) -> str:
    return ", ".join(f"{agg}({value}) FILTER (field = '{f}') AS {prefix}_{f}" for f in features.FIELDS)


FIELD_FEATURES = f"""
size AS (SELECT query_id, count(*) AS n_terms FROM q_stems GROUP BY 1),
vocabulary AS (SELECT DISTINCT term FROM tf),
every AS (SELECT term, field, ln(1 + (n - coalesce(df, 0) + 0.5e0) / (coalesce(df, 0) + 0.5e0)) AS idf FROM vocabulary CROSS JOIN (VALUES ('title'), ('params'), ('description')) x(field) LEFT JOIN fdf USING (term, field), n),
idfs AS (SELECT query_id, {_by_field('idf', 'idf', 'sum')} FROM q_stems JOIN every USING (term) GROUP BY 1),
hits AS (SELECT query_id, item_pos, {_by_field('w', 'w', 'sum')}, {_by_field('*', 'n', 'count')} FROM best JOIN q_stems USING (query_id) JOIN fw USING (item_pos, term) GROUP BY ALL),
fterms AS (SELECT query_id, term FROM q_all WHERE part = 'filter'),
fsize AS (SELECT query_id, count(*) AS n_filter FROM fterms GROUP BY 1),
fhits AS (SELECT query_id, item_pos, sum(w) AS fwt, count(*) AS fn FROM best JOIN fterms USING (query_id) JOIN fw USING (item_pos, term) WHERE field = 'params' GROUP BY ALL),
wide AS (SELECT item_pos, {_by_field('len', 'len', 'sum')} FROM flen GROUP BY 1)
SELECT query_id, item_pos, {_field_columns()},
  round(ln(1 + coalesce(fwt, 0)), 5) + 0e0 AS params_filter_log_bm25, round(coalesce(fn, 0)::DOUBLE / greatest(coalesce(n_filter, 0), 1), 5) AS params_filter_coverage,
  {REQUIRED} AS required_rating,
  CASE WHEN {REQUIRED} = 0 OR rating IS NULL THEN 0e0 WHEN rating >= {REQUIRED} THEN 1e0 ELSE -1e0 END AS rating_filter_match,
  round(CASE WHEN {REQUIRED} = 0 THEN 0e0 ELSE rating - {REQUIRED} END, 5) + 0e0 AS rating_filter_gap,
  CASE WHEN len(regexp_extract_all(search_query, '{NUM}')) > 0 THEN 1e0 ELSE 0e0 END AS query_has_numbers,
  round({_coverage('search_query', "title || ' ' || params")}, 5) AS number_coverage
FROM pairs LEFT JOIN size USING (query_id) LEFT JOIN idfs USING (query_id) LEFT JOIN hits USING (query_id, item_pos) LEFT JOIN fsize USING (query_id)
  LEFT JOIN fhits USING (query_id, item_pos) LEFT JOIN wide USING (item_pos)"""

ORACLES = {
    "normalize_text": f"SELECT doc_id, {norm_sql('text')} AS text_norm FROM documents",
    "tokenize": f"WITH t AS (SELECT doc_id, regexp_extract_all({norm_sql('coalesce(text, $$$$)')}, '{TOKEN}') AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t",
    "term_idf": with_views("items_fx", more=INDEX) + " SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM df, n",
    "bm25_weights": with_views("items_fx", more=INDEX) + " SELECT item_pos, term, round(w, 6) AS w FROM w",
    "bm25_topk": with_views("items_fx", "queries_fx", more=LEXICAL) + " SELECT query_id, item_pos, score, rank FROM best",
    "stem_bm25_topk": with_views(more=f"{CYRILLIC},\n{STEM_INDEX},\n{WEIGHTS},\n{SCORED},\n{TOP50}") + " SELECT query_id, item_pos, score, rank FROM best",
    "field_bm25": with_views("items_fx", "queries_fx", more=f"{QTERMS},\n{INDEX},\n{FIELD_INDEX}") + ", s AS (SELECT query_id, field, item_pos, round(sum(w), 6) AS score FROM q_terms JOIN fw USING (term) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, item_pos) AS rank FROM s) WHERE rank <= 20",
    "char_tfidf_topk": with_views("items_fx", "queries_fx", more=CHAR) + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_pos) AS rank FROM cscored) WHERE rank <= 50",
    "phrase_match": with_views("items_fx", "queries_fx", more=f"{LEXICAL},\n{PAIRS}") + f" SELECT query_id, item_pos, {', '.join(f'{_match("search_query", f)} AS {f}_match' for f in features.FIELDS)}, {_match('array_to_string(string_split(search_query, $$ $$)[1:2], $$ $$)', 'description')} AS two_words FROM pairs",
    "oov_fraction": with_views(more=f"{CYRILLIC},\n{STEM_INDEX}") + ", v AS (SELECT DISTINCT term, 1 AS known FROM tok), f AS (SELECT query_id, 1 - count(known)::DOUBLE / count(*) AS f FROM (SELECT DISTINCT query_id, term FROM q_all WHERE part IN ('query', 'params')) LEFT JOIN v USING (term) GROUP BY 1) SELECT query_id, round(coalesce(f, 1e0), 6) + 0e0 AS query_oov_fraction FROM queries_fx LEFT JOIN f USING (query_id)",
    "number_coverage": with_views("items_fx") + f" SELECT item_id, len(list_distinct(regexp_extract_all(description, '{NUM}')))::BIGINT AS n_numbers, round({_coverage('description', 'title || $$ $$ || params')}, 6) AS coverage FROM items_fx",
    "rating_filter": with_views("items_fx", "queries_fx", more=f"{LEXICAL},\n{PAIRS}") + f" SELECT query_id, item_pos, {REQUIRED} AS required, CASE WHEN {REQUIRED} = 0 OR rating IS NULL THEN 0e0 WHEN rating >= {REQUIRED} THEN 1e0 ELSE -1e0 END AS rating_match, CASE WHEN {REQUIRED} = 0 THEN 0e0 ELSE rating - {REQUIRED} END AS rating_gap FROM pairs",
    "field_features": with_views(more=f"{CYRILLIC},\n{STEM_INDEX},\n{WEIGHTS},\n{SCORED},\n{TOP50},\n{PAIRS},\n{FIELD_INDEX},{FIELD_FEATURES}"),
}
