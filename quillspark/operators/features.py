"""Feature blocks over one table of candidates: core (35), field (22) and embedding (9) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RRF_OFFSET, SERVICE_CATEGORY, SearchConfig
from ..functions.text import filter_words, normalize, number_coverage, numbers, phrase_match, required_rating, tokenize
from ..sources.store import scratch_table as keep
from . import geo as geo_op
from . import index, retrieve
from . import prior as prior_op

CHANNELS = ("stem", "char")
FIELDS = ("title", "params", "description")
#: Column names of the blocks, in the order in which a ranker gets them.
CORE = (
    "stem_log_score", "stem_relative_score", "stem_raw_rr", "stem_geo_rr", "stem_present", "char_score", "char_relative_score", "char_raw_rr", "char_geo_rr", "char_present",
    "search_rrf", "rrf_rank", "both_channels", "same_location", "geo_signal", "geo_log_factor", "source_present_in_corpus", "source_log_support", "destination_log_background",
    "prior_probability", "prior_relative", "query_prior_max", "query_prior_entropy", "item_rating", "rating_missing", "log_reviews", "reviews_missing", "same_category",
    "is_service_category", "query_category_specified", "query_words", "query_characters", "query_oov_fraction", "has_filters", "delivery_search",
)
FIELD = (
    "title_log_bm25", "title_normalized_bm25", "title_query_coverage", "title_log_length", "title_phrase_match",
    "params_log_bm25", "params_normalized_bm25", "params_query_coverage", "params_log_length", "params_phrase_match",
    "description_log_bm25", "description_normalized_bm25", "description_query_coverage", "description_log_length", "description_phrase_match",
    "params_filter_log_bm25", "params_filter_coverage", "required_rating", "rating_filter_match", "rating_filter_gap", "query_has_numbers", "number_coverage",
)
EMBEDDING = ("e5_cosine", "e5_cosine_gap", "e5_rank", "e5_geo_score", "e5_geo_rank", "e5_present", "e5_geo_present", "text_present", "hybrid_rrf")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def oov_fraction(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, query_oov_fraction): share of a search's distinct stems that the vocabulary of stems
    lacks; 1 for a search without terms."""
    terms = keep(index.stem_terms(queries, shortest=1))
    known = vocabulary.join(terms.select("term").distinct(), "term", "left_semi").select("term").distinct().withColumn("_v", F.lit(1))
    found = terms.join(known, "term", "left").groupBy("query_id").agg((1 - F.count("_v") / F.greatest(F.count("*"), F.lit(1))).alias("f"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("f", F.lit(1.0)).alias("query_oov_fraction"))


def channel_columns(pools: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, item_pos, …): five columns for each channel, by conditional aggregation over the
    stacked pools. ``pools`` has channel, score, factor (location) and category_id."""
    weighted = F.round(F.col("score") * F.col("factor") * retrieve.service_factor(config), 6)
    by = ("channel", "query_id")
    rows = pools.withColumn("weighted", weighted)
    rows = rows.withColumn("raw_rr", retrieve.reciprocal(F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "item_pos"))))
    rows = rows.withColumn("geo_rr", retrieve.reciprocal(F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weighted"), "item_pos"))))
    rows = rows.withColumn("relative", F.col("score") / F.greatest(F.max("score").over(Window.partitionBy(*by)), F.lit(1e-12))).where("score > 0")
    columns = []
    for c in CHANNELS:
        own = F.col("channel") == c

        def of(value: Column, own=own) -> Column:
            return F.coalesce(F.max(F.when(own, value)), F.lit(0.0))

        columns += [of(F.log1p("score")).alias("stem_log_score") if c == "stem" else of(F.col("score")).alias("char_score"), of(F.col("relative")).alias(f"{c}_relative_score"), of(F.col("raw_rr")).alias(f"{c}_raw_rr"), of(F.col("geo_rr")).alias(f"{c}_geo_rr"), of(F.lit(1.0)).alias(f"{c}_present")]
    return rows.groupBy("query_id", "item_pos").agg(*columns)


def core(candidates: DataFrame, pools: DataFrame, items: DataFrame, queries: DataFrame, model: geo_op.GeoModel, prior: DataFrame, vocabulary: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, item_pos, *CORE). ``pools``: (channel, query_id, item_pos, score); ``prior``:
    (query_id, item_microcat_id, p). An unknown rating is null and flagged."""
    known = items.select("item_pos", "location_id", "category_id", "microcat_id", "rating", "reviews")
    q = queries.select("query_id", "search_query", "search_location_id", "search_params", "search_category", "delivery")
    placed = geo_op.with_factor(retrieve.with_items(pools, items, queries), items, model, config)
    rows = candidates.select("query_id", "item_pos").join(known, "item_pos").join(q, "query_id")
    rows = geo_op.with_factor(rows, items, model, config)
    rows = rows.join(channel_columns(placed, config), ["query_id", "item_pos"], "left")
    support = model.support.select(F.col("search_location_id").alias("_s"), "support")
    background = model.background.select(F.col("item_location_id").alias("_d"), "background")
    rows = rows.join(support, rows["search_location_id"] == support["_s"], "left").drop("_s")
    rows = rows.join(background, rows["location_id"] == background["_d"], "left").drop("_d")
    p = prior.select(F.col("query_id").alias("_q"), F.col("item_microcat_id").alias("_m"), "p")
    rows = rows.join(p, (rows["query_id"] == p["_q"]) & (rows["microcat_id"] == p["_m"]), "left").drop("_q", "_m")
    rows = rows.join(prior_op.summary(prior), "query_id", "left").join(oov_fraction(queries, vocabulary), "query_id", "left")
    relative = _zero("p") / F.greatest(_zero("prior_max"), F.lit(1e-12))
    rrf = sum((F.lit(float(config.channels.get(c, 0))) * _zero(f"{c}_geo_rr") for c in CHANNELS), F.lit(0.0)) * (1 + F.lit(config.prior) * relative)
    rows = rows.withColumn("search_rrf", F.round(rrf, 12)).withColumn("prior_relative", relative)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("search_rrf"), "item_pos"))
    missing, service = F.col("rating").isNull(), F.col("category_id") == SERVICE_CATEGORY
    values = {
        **{n: _zero(n) for n in CORE[:10]},
        "search_rrf": F.col("search_rrf"),
        "rrf_rank": retrieve.reciprocal(rank),
        "both_channels": _zero("stem_present") * _zero("char_present"),
        "same_location": _flag(F.col("location_id") == F.col("search_location_id")),
        "geo_signal": F.col("signal"),
        "geo_log_factor": F.log1p("factor"),
        "source_present_in_corpus": _flag(F.col("source_present")),
        "source_log_support": F.log1p(_zero("support")),
        "destination_log_background": F.log1p(1e6 * _zero("background")),
        "prior_probability": _zero("p"),
        "prior_relative": F.col("prior_relative"),
        "query_prior_max": _zero("prior_max"),
        "query_prior_entropy": _zero("prior_entropy"),
        "item_rating": F.col("rating").cast("double"),
        "rating_missing": _flag(missing),
        "log_reviews": F.log1p(F.greatest(_zero("reviews"), F.lit(0.0))),
        "reviews_missing": _flag(F.col("reviews").isNull()),
        "same_category": _flag(F.col("category_id") == F.col("search_category")),
        "is_service_category": _flag(service),
        "query_category_specified": _flag(F.col("search_category") != 0),
        "query_words": F.size(tokenize(normalize(F.col("search_query")))).cast("double"),
        "query_characters": F.length(normalize(F.col("search_query"))).cast("double"),
        "query_oov_fraction": F.col("query_oov_fraction"),
        "has_filters": _flag(F.trim(F.coalesce("search_params", F.lit(""))) != ""),
        "delivery_search": _flag(F.col("delivery")),
    }
    return rows.select("query_id", "item_pos", *[values[n].alias(n) for n in CORE])


def rating_filter(required: Column, rating: Column) -> tuple[Column, Column]:
    """(match, gap): 1, -1 or 0 for unknown; the gap is null where a rating is asked for and unknown."""
    match = F.when((required == 0) | rating.isNull(), 0.0).when(rating >= required, 1.0).otherwise(-1.0)
    return match, F.when(required == 0, 0.0).otherwise(rating - required)


def field(candidates: DataFrame, items: DataFrame, queries: DataFrame, counts: DataFrame, n_items: int, lengths: DataFrame | None = None) -> DataFrame:
    """(query_id, item_pos, *FIELD). ``counts``: (item_pos, field, term, tf) of stems, whose terms are the
    vocabulary that all fields share; ``lengths``: (item_pos, field, len) of them, if at hand. One join of
    the candidates' terms serves all fields."""
    lengths = keep(index.field_lengths(counts)) if lengths is None else lengths
    rows = candidates.select("query_id", "item_pos")
    wanted = keep(queries.select("query_id", "search_query", F.coalesce(normalize(F.col("search_params")), F.lit("")).alias("filter")))
    terms = keep(index.stem_terms(wanted, shortest=1))
    filter_terms = keep(index.stem_terms(wanted.select("query_id", filter_words(F.col("filter")).alias("search_query")), shortest=1))
    postings = keep(index.bm25(counts, n_items, ("field",), terms=terms.unionByName(filter_terms), lengths=lengths))
    size = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    df = postings.groupBy("term").agg(*[F.count_if(F.col("field") == f).cast("double").alias(f) for f in FIELDS])
    # a term of the vocabulary counts in each field's sum of idf, with a document frequency of 0 where the field lacks it
    known = terms.join(df, "term").groupBy("query_id").agg(*[F.sum(index.idf(F.lit(float(n_items)), F.col(f))).alias(f"_idf_{f}") for f in FIELDS])
    hits = rows.join(terms, "query_id").join(postings, ["item_pos", "term"])
    scores = hits.groupBy("query_id", "item_pos").agg(*[c for f in FIELDS for c in (F.sum(F.when(F.col("field") == f, F.col("w"))).alias(f"_w_{f}"), F.count_if(F.col("field") == f).alias(f"_n_{f}"))])
    filter_size = filter_terms.groupBy("query_id").agg(F.count("*").alias("n_filter"))
    filter_hits = rows.join(filter_terms, "query_id").join(postings.where("field = 'params'"), ["item_pos", "term"]).groupBy("query_id", "item_pos").agg(F.sum("w").alias("_fw"), F.count("*").alias("_fn"))
    own = lengths.join(rows.select("item_pos").distinct(), "item_pos", "left_semi")
    wide = own.groupBy("item_pos").agg(*[F.sum(F.when(F.col("field") == f, F.col("len"))).alias(f"_len_{f}") for f in FIELDS])
    rows = rows.join(scores, ["query_id", "item_pos"], "left").join(filter_hits, ["query_id", "item_pos"], "left").join(wide, "item_pos", "left")
    rows = rows.join(items.select("item_pos", "rating", *FIELDS), "item_pos").join(wanted, "query_id")
    for side in (size, known, filter_size):
        rows = rows.join(side, "query_id", "left")
    query = normalize(F.col("search_query"))
    values = {}
    for f in FIELDS:
        text = F.coalesce(F.col(f), F.lit(""))
        values |= {
            f"{f}_log_bm25": F.log1p(_zero(f"_w_{f}")),
            f"{f}_normalized_bm25": _zero(f"_w_{f}") / F.greatest(_zero(f"_idf_{f}"), F.lit(1e-12)),
            f"{f}_query_coverage": _zero(f"_n_{f}") / F.greatest(_zero("n_terms"), F.lit(1.0)),
            f"{f}_log_length": F.log1p(_zero(f"_len_{f}")),
            f"{f}_phrase_match": phrase_match(query, text),
        }
    required = required_rating(F.col("filter"))
    match, gap = rating_filter(required, F.col("rating"))
    values |= {
        "params_filter_log_bm25": F.log1p(_zero("_fw")),
        "params_filter_coverage": _zero("_fn") / F.greatest(_zero("n_filter"), F.lit(1.0)),
        "required_rating": required,
        "rating_filter_match": match,
        "rating_filter_gap": gap,
        "query_has_numbers": _flag(F.size(numbers(query)) > 0),
        "number_coverage": number_coverage(query, F.concat_ws(" ", "title", "params")),
    }
    return rows.select("query_id", "item_pos", *[values[n].alias(n) for n in FIELD])


def embedding(candidates: DataFrame, scored: DataFrame, neighbours: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, item_pos, *EMBEDDING). ``candidates`` has text_rrf, prior_relative and in_text;
    ``scored`` (query_id, item_pos, cosine, factor) covers them; ``neighbours`` is the dual top list."""
    rr = F.when(F.col("kind") == "global", "raw").otherwise("geo")
    lists = neighbours.withColumn("k", rr).groupBy("query_id", "item_pos").agg(*[F.max(F.when(F.col("k") == k, 1.0 / (RRF_OFFSET + F.col("rank")))).alias(f"_{k}") for k in ("raw", "geo")])
    best = neighbours.where("kind = 'global'").groupBy("query_id").agg(F.max("score").alias("_best"))
    rows = candidates.join(scored, ["query_id", "item_pos"]).join(lists, ["query_id", "item_pos"], "left").join(best, "query_id")
    hybrid = _zero("text_rrf") + F.lit(config.e5_weight) * _zero("_geo") * (1 + F.lit(config.prior) * _zero("prior_relative"))
    values = {
        "e5_cosine": F.col("cosine"),
        "e5_cosine_gap": F.col("cosine") - F.col("_best"),
        "e5_rank": _zero("_raw"),
        "e5_geo_score": retrieve.semantic_score(F.col("cosine"), F.col("factor"), config),
        "e5_geo_rank": _zero("_geo"),
        "e5_present": _flag(F.col("_raw") > 0),
        "e5_geo_present": _flag(F.col("_geo") > 0),
        "text_present": _flag(F.col("in_text")),
        "hybrid_rrf": hybrid,
    }
    return rows.select("query_id", "item_pos", *[values[n].alias(n) for n in EMBEDDING])
