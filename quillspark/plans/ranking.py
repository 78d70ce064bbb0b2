"""Queries of locations, priors, pools, fusion, features, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import text as T
from ..operators import blend, features, geo, index, metrics, prior, quality, ranker, retrieve, sampling
from ..pipeline import Prepared, answer, training_rows
from ..sources import store, views
from ..sources.views import with_views
from .corpus import Corpus
from .lexical import CHAR, INDEX, LEXICAL, QTERMS, SCORED, rounded

CONFIG = SearchConfig()
SEED = 20260928
#: Trees of the registered model, enough to order by; the command line trains 100 by default.
TREES = 10


def _hash_score(*columns: str):
    """A reproducible number in [0, 1) from the first hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 6), 16, 10).cast("double") / 16777216.0


def _ranked(scored: DataFrame) -> DataFrame:
    """Candidates by BM25 with a second score, for blending."""
    return scored.select("query_id", "item_pos", F.col("score").alias("rrf"), F.round(_hash_score("query_id", "item_pos"), 6).alias("prediction"))


def _labelled(spark, d) -> DataFrame:
    """Candidates with gold flags: gold pairs, and as known positives those of the same microcategory."""
    c = Corpus(spark, d)
    g = views.gold(spark, d).withColumn("is_gold", F.lit(True))
    rows = c.best.join(c.items.select("item_pos", "item_id", "microcat_id"), "item_pos").join(g, ["query_id", "item_id"], "left")
    gold_flag = F.coalesce("is_gold", F.lit(False))
    return rows.select("query_id", "item_pos", F.col("score").alias("rrf"), gold_flag.alias("is_gold"), (gold_flag | (F.col("microcat_id") == 3)).alias("is_known"))


def _answers(c: Corpus) -> DataFrame:
    return retrieve.search(c.pools, c.items, c.queries, CONFIG, prior=c.prior, model=c.geo)


def _judged(spark, d) -> DataFrame:
    """Queries with gold: the search's answer (50), its candidates (the pools of both channels, and the
    positions that fill a short answer) and gold as arrays of item ids."""
    c = Corpus(spark, d)
    ids = c.items.select("item_pos", "item_id")
    g = views.gold(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("gold"))
    ranked = _answers(c).join(ids, "item_pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    ranked = ranked.select("query_id", F.transform("l", lambda x: x["item_id"]).alias("answer"))
    pool = retrieve.union_candidates(c.pools, c.queries, c.items).join(ids, "item_pos")
    pool = pool.groupBy("query_id").agg(F.array_sort(F.collect_list("item_id")).alias("candidates"))
    q = c.queries.select("query_id", "search_location_id")
    empty = F.lit([]).cast("array<string>")
    rows = q.join(g, "query_id").join(pool, "query_id", "left").join(ranked, "query_id", "left")
    return rows.withColumn("candidates", F.coalesce("candidates", empty)).withColumn("answer", F.coalesce("answer", empty))


def geo_context_weights(spark, d):
    return geo.context_weights(views.geo_pairs(spark, d)).withColumn("weight", F.round("weight", 6))


def geo_counts(spark, d):
    return rounded(geo.fit(views.geo_pairs(spark, d)).counts)


def geo_background(spark, d):
    m = geo.fit(views.geo_pairs(spark, d))
    return rounded(m.background.join(m.support.withColumnRenamed("search_location_id", "item_location_id"), "item_location_id", "left"))


def geo_signal(spark, d):
    return rounded(geo.signal(geo.fit(views.geo_pairs(spark, d)), 5.0, 0.5))


def location_presence(spark, d):
    q = views.queries(spark, d)
    here = views.items(spark, d).select(F.col("location_id").alias("l")).distinct()
    return q.join(here, q["search_location_id"] == here["l"], "left").select("query_id", "search_location_id", F.col("l").isNotNull().alias("present"))


def location_factor(spark, d):
    c = Corpus(spark, d)
    rows = c.best.select("query_id", "item_pos").join(c.items.select("item_pos", "location_id"), "item_pos").join(c.queries.select("query_id", "search_location_id"), "query_id")
    every = geo.with_factor(rows, c.items, c.geo, CONFIG)
    missing = geo.with_factor(rows, c.items, c.geo, SearchConfig(scope="missing")).select("query_id", "item_pos", F.col("factor").alias("factor_missing"))
    return rounded(every.join(missing, ["query_id", "item_pos"]).select("query_id", "item_pos", "factor", "factor_missing"))


def category_distribution(spark, d):
    return rounded(prior.distribution(views.prior_pairs(spark, d)))


def _prior(spark, d) -> DataFrame:
    pairs = views.prior_pairs(spark, d)
    q = pairs.select(F.col("query_norm").alias("query_id"), F.col("query_norm").alias("search_query")).distinct()
    return prior.prior(pairs, q, leave_out_self=True)


def category_prior(spark, d):
    return _prior(spark, d)


def prior_entropy(spark, d):
    return rounded(prior.summary(_prior(spark, d)), 4)


def stratified_candidates(spark, d):
    c = Corpus(spark, d)
    return retrieve.stratified(retrieve.with_items(c.scored, c.items, c.queries)).select("query_id", "item_pos", "score", "is_local", "is_service")


def ordinal_ranks(spark, d):
    s = views.read(spark, d, "supplier")
    return s.select("s_suppkey", "s_nationkey", blend.ordinal("s_acctbal", "s_suppkey", "s_nationkey").alias("place"))


def rrf_fusion(spark, d):
    c = Corpus(spark, d)
    rows = geo.with_factor(retrieve.with_items(c.pools, c.items, c.queries), c.items, None, CONFIG).withColumn("factor", F.col("factor") * retrieve.service_factor(CONFIG))
    return index.top(retrieve.fuse(rows, CONFIG).withColumn("rrf", F.round("rrf", 12)), 50, by="rrf").select("query_id", "item_pos", F.round("rrf", 9).alias("rrf"), "rank")


def candidate_union(spark, d):
    c = Corpus(spark, d)
    return retrieve.union_candidates(c.pools.where("score > 2 or channel = 'char' and score > 0.3"), c.queries, c.items)


def fallback_fill(spark, d):
    c = Corpus(spark, d)
    return retrieve.fill(c.best.withColumn("rank", blend.ordinal("score")), c.queries, c.items)


def search_answer(spark, d):
    """The answer of both channels with location factor and class prior."""
    return _answers(Corpus(spark, d))


def blend_rank(spark, d):
    return blend.blend(_ranked(Corpus(spark, d).best), 0.5).select("query_id", "item_pos", "rank")


def blend_grid(spark, d):
    """Mean recall at 10 of two models' blends with five weights, in one job."""
    c = Corpus(spark, d)
    rows = c.best.select("query_id", "item_pos", F.col("score").alias("rrf"), F.round(_hash_score("query_id", "item_pos"), 6).alias("few"), F.round(_hash_score("item_pos", "query_id"), 6).alias("many"))
    top = blend.grid(rows, ["few", "many"], [0, 0.25, 0.5, 0.75, 1], k=10).join(c.items.select("item_pos", "item_id"), "item_pos")
    g = views.gold(spark, d).distinct()
    hits = top.join(g, ["query_id", "item_id"]).groupBy("model", "weight").agg(F.count("*").alias("hits"))
    points = spark.createDataFrame([(m, float(w)) for m in ("few", "many") for w in (0, 0.25, 0.5, 0.75, 1)], "model string, weight double")
    total = g.agg(F.count("*").alias("gold"))
    out = points.join(hits, ["model", "weight"], "left").crossJoin(F.broadcast(total))  # one row
    return out.select("model", "weight", F.round(F.coalesce("hits", F.lit(0)) / F.greatest("gold", F.lit(1)), 6).alias("recall"))


def masked_blend(spark, d):
    """Ranks are over all candidates of a search; they are shuffled once, before the second score is added."""
    rows = _ranked(Corpus(spark, d).scored_alone.repartition("query_id")).withColumn("in_text", F.col("item_pos") % 2 == 0)
    return blend.blend(rows, 0.25, k=20, mask="in_text").select("query_id", "item_pos", "rank")


def _vectors(spark, d):
    v = views.vectors(spark, d)
    q = v.where("item_pos % 20 = 0").select(F.concat(F.lit("q"), F.col("item_pos").cast("string")).alias("query_id"), "vector", (F.col("location_id") + 1).alias("search_location_id"))
    return v, q


def cosine_topk(spark, d):
    v, q = _vectors(spark, d)
    return retrieve.dense_top(retrieve.dense(q, v, 50), 50).select("query_id", "item_pos", "cosine", "rank")


def _near(spark, d) -> DataFrame:
    """The dual top 500."""
    v, q = _vectors(spark, d)
    model = geo.from_counts(store.scratch_table(geo.fit(views.geo_pairs(spark, d)).counts))
    return retrieve.dense_top(retrieve.dense(q, v, model=model, config=CONFIG))


def semantic_dual_topk(spark, d):
    return _near(spark, d).select("query_id", "item_pos", "kind", "score", "rank")


def embedding_features(spark, d):
    near = store.scratch_table(_near(spark, d))
    cand = near.select("query_id", "item_pos").distinct().withColumn("in_text", F.col("item_pos") % 2 == 0)
    cand = cand.withColumn("text_rrf", F.when(F.col("in_text"), 1.0 / (60 + F.col("item_pos"))).otherwise(0.0)).withColumn("prior_relative", (F.col("item_pos") % 5) / 5.0)
    return rounded(features.embedding(cand, near.select("query_id", "item_pos", "cosine", "factor").distinct(), near, CONFIG), 8)


def core_features(spark, d):
    """The 35 columns of the 50 best by BM25."""
    c = Corpus(spark, d)
    return rounded(features.core(c.best.select("query_id", "item_pos"), c.pools, c.items, c.queries, c.geo, c.prior, c.field_counts, CONFIG), 6)


def text_split(spark, d):
    texts = views.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query_norm"))
    return sampling.split(texts, SEED, previous=(11, 12), size=100, gone=150)


def negative_sampling(spark, d):
    return sampling.training_selection(_labelled(spark, d), SEED).select("query_id", "item_pos", "kind")


def balanced_pairs(spark, d):
    rows = sampling.training_selection(_labelled(spark, d), SEED)
    return rounded(sampling.balanced_pairs(rows.select("query_id", "item_pos", F.col("is_gold").cast("int").alias("y"))))


def recall_at_50(spark, d):
    return rounded(_judged(spark, d).select("query_id", metrics.recall(F.col("answer"), F.col("gold")).alias("recall")))


def candidate_coverage(spark, d):
    return rounded(_judged(spark, d).select("query_id", metrics.recall(F.col("candidates"), F.col("gold"), None).alias("coverage")))


def loss_decomposition(spark, d):
    r, ranking, retrieval = metrics.losses(F.col("answer"), F.col("candidates"), F.col("gold"))
    return rounded(_judged(spark, d).select("query_id", r.alias("recall"), ranking.alias("ranking_loss"), retrieval.alias("retrieval_loss")))


def recall_by_slice(spark, d):
    rows = _judged(spark, d).withColumn("r", metrics.recall(F.col("answer"), F.col("gold"))).withColumn("present", F.col("search_location_id") < 20)
    return rounded(metrics.by_slice(rows, "present", "r"))


def paired_delta(spark, d):
    c = views.read(spark, d, "customer")
    a = c.select("c_custkey", F.round("c_acctbal", 0).alias("v"))
    b = c.select("c_custkey", (F.round("c_acctbal", 0) + F.col("c_custkey") % 3 - 1).alias("v"))
    return rounded(metrics.paired_delta(a, b, "c_custkey", "v"))


def paired_interval(spark, d):
    """The difference with its bootstrap interval; the draws are this package's own, so it has no twin."""
    c = views.read(spark, d, "customer")
    a = c.select("c_custkey", F.round("c_acctbal", 0).alias("v"))
    b = c.select("c_custkey", (F.round("c_acctbal", 0) + F.col("c_custkey") % 3 - 1).alias("v"))
    return rounded(metrics.paired_interval(a, b, "c_custkey", "v"))


def many_to_one(spark, d):
    """Customers with their nation's name, by a join that must not multiply them."""
    nations = views.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return store.many_to_one(views.read(spark, d, "customer").select("c_custkey", "c_nationkey"), nations, ["c_nationkey"]).select("c_custkey", "n_name")


def _grid(spark, d) -> DataFrame:
    """Scored grid: location weight by service weight, one job for all points."""
    c = Corpus(spark, d)
    grid = spark.createDataFrame([(float(x), float(y)) for x in (1, 4, 8) for y in (1, 2)], "location double, service double")
    rows = retrieve.with_items(c.best.select("query_id", "item_pos", "score"), c.items, c.queries).crossJoin(F.broadcast(grid))  # a fixed number of points
    weighted = F.col("score") * F.when(F.col("location_id") == F.col("search_location_id"), F.col("location")).otherwise(1.0) * F.when(F.col("category_id") == 114, F.col("service")).otherwise(1.0)
    return rows.groupBy("location", "service").agg(F.round(F.sum(weighted), 6).alias("value"))


def grid_best(spark, d):
    return metrics.grid_best(_grid(spark, d), ["location", "service"], "value")


def grid_pivot(spark, d):
    return _grid(spark, d).groupBy("location").pivot("service", [1.0, 2.0]).agg(F.first("value")).select("location", F.col("`1.0`").alias("service_1"), F.col("`2.0`").alias("service_2"))


def bootstrap_ci(spark, d):
    return metrics.bootstrap(views.read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


def null_counts(spark, d):
    return quality.null_counts(views.items(spark, d))


def quality_checks(spark, d):
    return quality.checks(views.items(spark, d), views.queries(spark, d))


def dataset_profile(spark, d):
    return quality.profile(views.items(spark, d), "title", "location_id", "category_id")


def category_share(spark, d):
    items = views.items(spark, d).select(F.col("category_id").alias("c"))
    q = views.queries(spark, d).select(F.col("search_category").alias("c"))
    a, b = quality.shares(items, "c").withColumnRenamed("share", "item_share"), quality.shares(q, "c").withColumnRenamed("share", "query_share")
    return rounded(a.join(b, "c", "full").select("c", F.coalesce("item_share", F.lit(0.0)).alias("item_share"), F.coalesce("query_share", F.lit(0.0)).alias("query_share")))


def gold_sets(spark, d):
    return views.gold(spark, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), " ").alias("gold"))


def gold_histogram(spark, d):
    sizes = views.queries(spark, d).select("query_id").join(views.gold(spark, d).groupBy("query_id").agg(F.count_distinct("item_id").alias("n")), "query_id", "left")
    return sizes.select(F.coalesce("n", F.lit(0)).alias("gold_size")).groupBy("gold_size").agg(F.count("*").alias("queries"))


def dedup_catalogue(spark, d):
    items = views.items(spark, d).select("item_id", "item_pos", F.md5("title").alias("title_md5"))
    second = items.withColumn("title_md5", F.lit("later")).unionByName(items.withColumn("item_id", F.concat(F.lit("x"), F.col("item_id"))))
    return quality.dedup_catalogue(items, second, "item_id", "item_pos")


def encoder_text(spark, d):
    return views.items(spark, d).select("item_id", F.md5(T.prefixed(T.encoder_text(F.col("title"), F.col("params")), "passage: ")).alias("text_md5"))


def answer_lines(spark, d):
    """The answer file's rows: 50 ids joined by blanks."""
    c = Corpus(spark, d)
    rows = _answers(c).join(c.items.select("item_pos", "item_id"), "item_pos")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return lists.select("query_id", F.array_join(F.transform("l", lambda x: x["item_id"]), " ").alias("answer"))


def train_and_rank(spark, d):
    """Boosted model on the searches with gold, and its blended answer."""
    c = Corpus(spark, d)
    candidates = store.scratch_table(index.top(c.scored, 100).select("query_id", "item_pos").withColumn("in_text", F.lit(True)))
    core = store.scratch_table(features.core(candidates, c.pools, c.items, c.queries, c.geo, c.prior, c.field_counts, CONFIG))
    prepared = Prepared(candidates, c.pools, core, store.scratch_table(features.field(candidates, c.items, c.queries, c.field_counts, c.n, c.lengths)))
    # a search trains only if a candidate is gold, so only candidates are judged
    judged = store.scratch_table(candidates.join(c.items.select("item_pos", "item_id"), "item_pos").select("query_id", "item_id"))
    gold = store.scratch_table(views.gold(spark, d, judged))
    gold = gold.groupBy("query_id").agg(F.collect_set("item_id").alias("gold")).withColumn("known_positives", F.col("gold"))
    rows = store.scratch_table(training_rows(prepared, c.items, gold, SEED))
    pairs = sampling.balanced_pairs(rows.select("query_id", "item_pos", "y"))
    fitted = ranker.fit_boosted(rows, pairs, prepared.names, rounds=TREES, depth=6, materialise=store.scratch_table)
    return answer(prepared, fitted, 0.5)


FOUND = (
    geo_context_weights, geo_counts, geo_background, geo_signal, location_presence, location_factor, category_distribution, category_prior, prior_entropy,
    stratified_candidates, ordinal_ranks, rrf_fusion, candidate_union, fallback_fill, search_answer, blend_rank, masked_blend, blend_grid, cosine_topk, semantic_dual_topk,
    embedding_features, core_features, text_split, negative_sampling, balanced_pairs, recall_at_50, candidate_coverage, loss_decomposition, recall_by_slice,
    paired_delta, paired_interval, many_to_one, grid_best, grid_pivot, bootstrap_ci, null_counts, quality_checks, dataset_profile, category_share, gold_sets, gold_histogram, dedup_catalogue,
    encoder_text, answer_lines, train_and_rank,
)

# ---- DuckDB twins

GEO = """gdist AS (SELECT query_norm, search_location_id, item_id, min(item_location_id) AS item_location_id FROM geo_pairs_fx GROUP BY ALL),
gw AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY query_norm, search_location_id) AS weight FROM gdist),
gc AS (SELECT search_location_id, item_location_id, sum(weight) AS count FROM gw GROUP BY ALL),
gs AS (SELECT search_location_id, sum(count) AS support FROM gc GROUP BY 1),
gb AS (SELECT item_location_id, sum(count) / (SELECT sum(count) FROM gc) AS background FROM gc GROUP BY 1)"""


def signal_sql(alpha: float, beta: float, name: str = "sig") -> str:
    return f"""{name}_a AS (SELECT *, count / support / pow(background, {beta}e0) AS adjusted FROM gc JOIN gs USING (search_location_id) JOIN gb USING (item_location_id)),
{name} AS (SELECT search_location_id, item_location_id, adjusted / max(adjusted) OVER (PARTITION BY search_location_id) * (support / (support + {alpha}e0)) AS signal FROM {name}_a)"""


SIGNAL = signal_sql(CONFIG.alpha, CONFIG.beta)
PRESENT = "here AS (SELECT DISTINCT location_id AS l FROM items_fx)"


def factor_sql(rows: str, name: str, scope: str = "all", locations: str = "here") -> str:
    """``rows`` has search_location_id and location_id."""
    learned = f"{CONFIG.geo_strength}e0 * coalesce(signal, 0)"
    learned = learned if scope == "all" else f"CASE WHEN l IS NOT NULL THEN 0 ELSE {learned} END"
    return f"""{name} AS (SELECT r.*, coalesce(signal, 0) AS signal, l IS NOT NULL AS source_present,
  CASE WHEN r.location_id = r.search_location_id THEN {CONFIG.location}e0 ELSE 1e0 END + {learned} AS factor
  FROM {rows} r LEFT JOIN {locations} ON r.search_location_id = l LEFT JOIN sig ON r.search_location_id = sig.search_location_id AND r.location_id = sig.item_location_id)"""


LOCATED = "located AS (SELECT query_id, item_pos, location_id, search_location_id FROM best JOIN items_fx USING (item_pos) JOIN queries_fx USING (query_id))"
BOTH = ",\n".join([LEXICAL, CHAR])


def strata_sql(name: str, scored: str) -> str:
    return f"""{name}_r AS (SELECT s.*, location_id, category_id, search_location_id, location_id = search_location_id AS is_local, category_id = 114 AS is_service
  FROM {scored} s JOIN items_fx USING (item_pos) JOIN queries_fx USING (query_id) WHERE score > 0),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_pos) AS g,
  row_number() OVER (PARTITION BY query_id, is_local, is_service ORDER BY score DESC, item_pos) AS c FROM {name}_r) WHERE g <= 500 OR c <= 100)"""


POOLS = f"""{BOTH},
{strata_sql('ps', 'scored')},
{strata_sql('pc', 'cscored')},
pools AS (SELECT 'stem' AS channel, query_id, item_pos, score, location_id, category_id, search_location_id FROM ps
  UNION ALL SELECT 'char', query_id, item_pos, score, location_id, category_id, search_location_id FROM pc)"""


def fuse_sql(rows: str, name: str) -> str:
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY round(score * factor, 6) DESC, item_pos) AS r FROM {rows} WHERE score > 0),
{name} AS (SELECT query_id, item_pos, round(sum(CASE channel WHEN 'stem' THEN 1e0 ELSE 0.5e0 END / (60 + r)), 12) AS rrf FROM {name}_k GROUP BY ALL)"""


RANKED = "ranked AS (SELECT query_id, item_pos, score AS rrf, round(('0x' || substr(md5(query_id || '|' || item_pos), 1, 6))::BIGINT / 16777216e0, 6) AS prediction FROM best)"
#: The same of all candidates.
ALL_RANKED = ",\n".join([QTERMS, INDEX, SCORED, RANKED.replace("FROM best", "FROM scored WHERE score > 0")])


def blend_sql(weight: float, mask: str, k: int) -> str:
    return f"""mix AS (SELECT *, {weight}e0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY prediction DESC, item_pos)) + {1 - weight}e0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_pos)) AS mixed FROM ranked),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, item_pos) AS rank FROM mix WHERE {mask})
SELECT query_id, item_pos, rank FROM m WHERE rank <= {k}"""


BLEND_GRID = """pr AS (SELECT query_id, item_pos, score AS rrf, round(('0x' || substr(md5(query_id || '|' || item_pos), 1, 6))::BIGINT / 16777216e0, 6) AS prediction, 'few' AS model FROM best
  UNION ALL SELECT query_id, item_pos, score, round(('0x' || substr(md5(item_pos || '|' || query_id), 1, 6))::BIGINT / 16777216e0, 6), 'many' FROM best),
pm AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY prediction DESC, item_pos) AS m, row_number() OVER (PARTITION BY model, query_id ORDER BY rrf DESC, item_pos) AS f FROM pr),
points AS (SELECT model, weight FROM (VALUES ('few'), ('many')) a(model), (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) b(weight)),
px AS (SELECT model, weight, query_id, item_pos, CASE weight WHEN 0 THEN rrf WHEN 1 THEN prediction ELSE weight / (60 + m) + (1 - weight) / (60 + f) END AS mixed FROM pm JOIN points USING (model)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, weight, query_id ORDER BY mixed DESC, item_pos) AS rank FROM px) WHERE rank <= 10),
gd AS (SELECT DISTINCT * FROM gold_fx),
ph AS (SELECT model, weight, count(*) AS hits FROM pk JOIN items_fx USING (item_pos) JOIN gd USING (query_id, item_id) GROUP BY ALL)
SELECT model, weight, round(coalesce(hits, 0) / greatest((SELECT count(*) FROM gd), 1), 6) AS recall FROM points LEFT JOIN ph USING (model, weight)"""
LABELLED = """lab AS (SELECT b.query_id, b.item_pos, b.score AS rrf, g.item_id IS NOT NULL AS is_gold, g.item_id IS NOT NULL OR i.microcat_id = 3 AS is_known
  FROM best b JOIN items_fx i USING (item_pos) LEFT JOIN gold_fx g ON g.query_id = b.query_id AND g.item_id = i.item_id),
kinds AS (SELECT *, CASE WHEN is_gold THEN 'positive' WHEN NOT is_known THEN 'negative' END AS kind FROM lab),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rrf DESC, item_pos) AS h FROM kinds WHERE kind IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, h <= 128 ORDER BY md5('20260928|' || query_id || '|' || item_pos), item_pos) AS r FROM h),
kept AS (SELECT * FROM r WHERE kind = 'positive' OR h <= 128 OR r <= 64),
sel AS (SELECT * FROM kept WHERE query_id IN (SELECT query_id FROM kept GROUP BY 1 HAVING count(DISTINCT kind) = 2))"""
MP = "mp AS (SELECT query_id, microcat_id, round(count(*)::DOUBLE / (microcat_id + 1) / (SELECT count(*) FROM items_fx), 6) AS p FROM items_fx, (SELECT query_id FROM queries_fx) GROUP BY query_id, microcat_id)"
DENSE = f"""vq AS (SELECT 'q' || item_pos AS query_id, vector AS qv, location_id + 1 AS search_location_id FROM vectors_fx WHERE item_pos % 20 = 0),
cosines AS (SELECT query_id, item_pos, round(list_dot_product(qv::DOUBLE[], vector::DOUBLE[]), 4) + 0e0 AS cosine, location_id, search_location_id FROM vectors_fx, vq),
vhere AS (SELECT DISTINCT location_id AS l FROM vectors_fx),
{GEO},
{SIGNAL},
{factor_sql('cosines', 'vf', locations='vhere')},
dense AS (SELECT *, round(cosine + {CONFIG.e5_geo}e0 * ln(factor), 4) + 0e0 AS geo_score FROM vf),
dual AS (SELECT query_id, item_pos, 'global' AS kind, cosine AS score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_pos) AS rank FROM dense
  UNION ALL SELECT query_id, item_pos, 'geo', geo_score, row_number() OVER (PARTITION BY query_id ORDER BY geo_score DESC, item_pos) FROM dense),
near AS (SELECT * FROM dual WHERE rank <= 500)"""
GRID = """g AS (SELECT x.location, y.service, round(sum(score * CASE WHEN location_id = search_location_id THEN x.location ELSE 1 END * CASE WHEN category_id = 114 THEN y.service ELSE 1 END), 6) AS value
  FROM best JOIN items_fx USING (item_pos) JOIN queries_fx USING (query_id), (VALUES (1e0), (4e0), (8e0)) x(location), (VALUES (1e0), (2e0)) y(service) GROUP BY ALL)"""
PRIOR = f"""pt AS (SELECT DISTINCT query_norm FROM prior_pairs_fx),
{{tfidf}},
ps AS (SELECT a.query_norm AS query_id, b.query_norm, round(sum(a.w * b.w), 6) AS score FROM px a JOIN px b USING (term) WHERE a.query_norm <> b.query_norm GROUP BY ALL),
pn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, query_norm) AS k FROM ps WHERE score > 0) WHERE k <= 10 AND score >= 0.2e0),
pd AS (SELECT query_norm, item_microcat_id, count(*)::DOUBLE / sum(count(*)::DOUBLE) OVER (PARTITION BY query_norm) AS share FROM prior_pairs_fx GROUP BY query_norm, item_microcat_id),
pp AS (SELECT query_id, item_microcat_id, round(sum(score * score * share) / any_value(total), 6) AS p
  FROM pn JOIN pd USING (query_norm) JOIN (SELECT query_id, sum(score * score) AS total FROM pn GROUP BY 1) USING (query_id) GROUP BY query_id, item_microcat_id)"""


def _prior_sql() -> str:
    from .lexical import tfidf_sql

    return PRIOR.replace("{tfidf}", tfidf_sql("px", "pt", "query_norm", "query_norm", 2, 5))


def _core_sql() -> str:
    """The 35 columns over the 50 best candidates."""
    ch = []
    for c in features.CHANNELS:
        own = f"FILTER (channel = '{c}')"
        ch += [f"max(ln(1 + score)) {own} AS stem_log_score" if c == "stem" else f"max(score) {own} AS char_score", f"max(rel) {own} AS {c}_relative_score", f"max(raw_rr) {own} AS {c}_raw_rr", f"max(geo_rr) {own} AS {c}_geo_rr", f"max(1e0) {own} AS {c}_present"]
    z = lambda n: f"coalesce({n}, 0e0)"
    values = {
        **{n: z(n) for n in features.CORE[:10]},
        "search_rrf": "search_rrf", "rrf_rank": "1e0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY search_rrf DESC, item_pos))",
        "both_channels": f"{z('stem_present')} * {z('char_present')}", "same_location": "(location_id = search_location_id)::INT::DOUBLE", "geo_signal": "signal",
        "geo_log_factor": "ln(1 + factor)", "source_present_in_corpus": "source_present::INT::DOUBLE", "source_log_support": f"ln(1 + {z('support')})",
        "destination_log_background": f"ln(1 + 1e6 * {z('background')})", "prior_probability": z("p"), "prior_relative": "prior_relative", "query_prior_max": z("prior_max"),
        "query_prior_entropy": z("prior_entropy"), "item_rating": "rating", "rating_missing": "(rating IS NULL)::INT::DOUBLE", "log_reviews": f"ln(1 + greatest({z('reviews')}, 0))",
        "reviews_missing": "(reviews IS NULL)::INT::DOUBLE", "same_category": "(category_id = search_category)::INT::DOUBLE", "is_service_category": "(category_id = 114)::INT::DOUBLE",
        "query_category_specified": "(search_category <> 0)::INT::DOUBLE", "query_words": r"len(regexp_extract_all(search_query, '[\p{L}\p{N}_]{2,}'))::DOUBLE",
        "query_characters": "length(search_query)::DOUBLE", "query_oov_fraction": "oov", "has_filters": "(trim(search_params) <> '')::INT::DOUBLE", "delivery_search": "delivery::INT::DOUBLE",
    }
    columns = ", ".join(f"round({values[n]}, 6) + 0e0 AS {n}" for n in features.CORE)
    return f"""{POOLS}, {PRESENT}, {GEO}, {SIGNAL}, {factor_sql('pools', 'pf')},
k AS (SELECT *, 1e0 / (60 + row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, item_pos)) AS raw_rr,
  1e0 / (60 + row_number() OVER (PARTITION BY channel, query_id ORDER BY round(score * factor, 6) DESC, item_pos)) AS geo_rr, score / max(score) OVER (PARTITION BY channel, query_id) AS rel FROM pf),
ch AS (SELECT query_id, item_pos, {', '.join(ch)} FROM k WHERE score > 0 GROUP BY ALL),
{MP},
ms AS (SELECT query_id, max(p) AS prior_max, round(sum(-p * ln(p)), 6) AS prior_entropy FROM mp WHERE p > 0 GROUP BY 1),
oo AS (SELECT query_id, 1 - count(v.term)::DOUBLE / greatest(count(*), 1) AS oov FROM q_terms t LEFT JOIN (SELECT DISTINCT term FROM tf) v ON t.term = v.term GROUP BY 1),
c0 AS (SELECT query_id, item_pos, location_id, category_id, microcat_id, rating, reviews, search_query, search_location_id, search_params, search_category, delivery FROM best JOIN items_fx USING (item_pos) JOIN queries_fx USING (query_id)),
{factor_sql('c0', 'c1')},
c2 AS (SELECT c1.*, ch.* EXCLUDE (query_id, item_pos), support, background, p, prior_max, prior_entropy, coalesce(oov, 1e0) AS oov, coalesce(p, 0) / greatest(coalesce(prior_max, 0), 1e-12) AS prior_relative
  FROM c1 LEFT JOIN ch USING (query_id, item_pos) LEFT JOIN gs USING (search_location_id) LEFT JOIN gb ON gb.item_location_id = c1.location_id LEFT JOIN mp USING (query_id, microcat_id) LEFT JOIN ms USING (query_id) LEFT JOIN oo USING (query_id)),
c3 AS (SELECT *, round((1e0 * coalesce(stem_geo_rr, 0) + 0.5e0 * coalesce(char_geo_rr, 0)) * (1 + 0.5e0 * prior_relative), 12) AS search_rrf FROM c2)
SELECT query_id, item_pos, {columns} FROM c3"""


I, Q, IQ = ("items_fx",), ("queries_fx",), ("items_fx", "queries_fx")
#: Fusion, then the class prior's boost, then the 50 best.
SEARCH = f"""{POOLS}, {PRESENT}, {GEO}, {SIGNAL}, {factor_sql('pools', 'pf')}, {MP},
fused_k AS (SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY round(score * factor, 6) DESC, item_pos) AS r FROM pf WHERE score > 0),
fused_s AS (SELECT query_id, item_pos, sum(CASE channel WHEN 'stem' THEN 1e0 ELSE 0.5e0 END / (60 + r)) AS rrf FROM fused_k GROUP BY ALL),
mx AS (SELECT query_id, max(p) AS pmax FROM mp GROUP BY 1),
fused AS (SELECT query_id, item_pos, round(rrf * (1 + {CONFIG.prior}e0 * (coalesce(p, 0) / greatest(coalesce(pmax, 0), 1e-12))), 12) AS rrf
  FROM fused_s JOIN items_fx USING (item_pos) LEFT JOIN mx USING (query_id) LEFT JOIN mp USING (query_id, microcat_id)),
ans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_pos) AS rank FROM fused) WHERE rank <= 50)"""


def fill_sql(answers: str, name: str) -> str:
    return f"""{name}_n AS (SELECT query_id, count(item_pos) AS n FROM (SELECT query_id FROM queries_fx) LEFT JOIN {answers} USING (query_id) GROUP BY 1),
{name}_s AS (SELECT query_id, i.item_pos, (n + row_number() OVER (PARTITION BY query_id ORDER BY i.item_pos)) AS rank FROM {name}_n, (SELECT item_pos FROM items_fx WHERE item_pos < 100) i
  WHERE n < 50 AND NOT EXISTS (FROM {answers} a WHERE a.query_id = {name}_n.query_id AND a.item_pos = i.item_pos)),
{name} AS (SELECT query_id, item_pos, rank::INT AS rank FROM {answers} UNION ALL SELECT query_id, item_pos, rank::INT FROM {name}_s WHERE rank <= 50)"""


#: The whole answer against all candidates of both channels.
JUDGED = f"""{SEARCH}, {fill_sql('ans', 'f')},
cu AS (SELECT DISTINCT query_id, item_pos FROM pools WHERE score > 0),
short AS (SELECT query_id FROM (SELECT query_id FROM queries_fx) LEFT JOIN cu USING (query_id) GROUP BY 1 HAVING count(item_pos) < 50),
cands AS (SELECT * FROM cu UNION SELECT query_id, item_pos FROM short, (SELECT item_pos FROM items_fx WHERE item_pos < 50)),
cl AS (SELECT query_id, list(item_id) AS candidates FROM cands JOIN items_fx USING (item_pos) GROUP BY 1),
al AS (SELECT query_id, list(item_id ORDER BY rank) AS answer FROM f JOIN items_fx USING (item_pos) GROUP BY 1),
golds AS (SELECT query_id, list(DISTINCT item_id) AS gold FROM gold_fx GROUP BY 1),
j AS (SELECT q.query_id, search_location_id, gold, coalesce(candidates, []) AS candidates, coalesce(answer, [])[1:50] AS answer
  FROM queries_fx q JOIN golds USING (query_id) LEFT JOIN cl USING (query_id) LEFT JOIN al USING (query_id)),
e AS (SELECT *, len(list_intersect(answer, gold))::DOUBLE / len(gold) AS recall, len(list_intersect(candidates, gold))::DOUBLE / len(gold) AS coverage FROM j)"""

ORACLES = {
    "geo_context_weights": with_views("geo_pairs_fx", more=GEO) + " SELECT query_norm, search_location_id, item_id, item_location_id, round(weight, 6) AS weight FROM gw",
    "geo_counts": with_views("geo_pairs_fx", more=GEO) + " SELECT search_location_id, item_location_id, round(count, 6) AS count FROM gc",
    "geo_background": with_views("geo_pairs_fx", more=GEO) + " SELECT item_location_id, round(background, 6) AS background, round(support, 6) AS support FROM gb LEFT JOIN gs ON search_location_id = item_location_id",
    "geo_signal": with_views("geo_pairs_fx", more=f"{GEO}, {signal_sql(5.0, 0.5)}") + " SELECT search_location_id, item_location_id, round(signal, 6) AS signal FROM sig",
    "location_presence": with_views(*IQ, more=PRESENT) + " SELECT query_id, search_location_id, l IS NOT NULL AS present FROM queries_fx LEFT JOIN here ON search_location_id = l",
    "location_factor": with_views(*IQ, "geo_pairs_fx", more=f"{LEXICAL}, {LOCATED}, {PRESENT}, {GEO}, {SIGNAL}, {factor_sql('located', 'fa')}, {factor_sql('located', 'fm', 'missing')}") + " SELECT query_id, item_pos, round(fa.factor, 6) AS factor, round(fm.factor, 6) AS factor_missing FROM fa JOIN fm USING (query_id, item_pos)",
    "category_distribution": with_views("prior_pairs_fx") + " SELECT query_norm, item_microcat_id, round(count(*)::DOUBLE / sum(count(*)::DOUBLE) OVER (PARTITION BY query_norm), 6) AS share FROM prior_pairs_fx GROUP BY query_norm, item_microcat_id",
    "category_prior": with_views("prior_pairs_fx", more=_prior_sql()) + " SELECT query_id, item_microcat_id, p FROM pp",
    "prior_entropy": with_views("prior_pairs_fx", more=_prior_sql()) + " SELECT query_id, round(max(p), 4) AS prior_max, round(round(sum(-p * ln(p)), 6), 4) + 0e0 AS prior_entropy FROM pp WHERE p > 0 GROUP BY 1",
    "stratified_candidates": with_views(*IQ, more=f"{LEXICAL}, {strata_sql('ps', 'scored')}") + " SELECT query_id, item_pos, score, is_local, is_service FROM ps",
    "ordinal_ranks": "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier",
    "rrf_fusion": with_views(*IQ, more=f"{POOLS}, pf AS (SELECT *, CASE WHEN location_id = search_location_id THEN 8e0 ELSE 1e0 END AS factor FROM pools), {fuse_sql('pf', 'fused')}, ans AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_pos) AS rank FROM fused)") + " SELECT query_id, item_pos, round(rrf, 9) AS rrf, rank FROM ans WHERE rank <= 50",
    "candidate_union": with_views(*IQ, more=f"{POOLS}, u AS (SELECT DISTINCT query_id, item_pos FROM pools WHERE score > 0 AND (score > 2 OR channel = 'char' AND score > 0.3)), short AS (SELECT query_id FROM (SELECT query_id FROM queries_fx) LEFT JOIN u USING (query_id) GROUP BY 1 HAVING count(item_pos) < 50)") + " SELECT * FROM u UNION SELECT query_id, item_pos FROM short, (SELECT item_pos FROM items_fx WHERE item_pos < 50)",
    "fallback_fill": with_views(*IQ, more=f"{LEXICAL}, a AS (SELECT query_id, item_pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_pos) AS rank FROM best), {fill_sql('a', 'f')}") + " SELECT * FROM f",
    "search_answer": with_views(*IQ, "geo_pairs_fx", more=f"{SEARCH}, {fill_sql('ans', 'f')}") + " SELECT * FROM f",
    "blend_rank": with_views(*IQ, more=f"{LEXICAL}, {RANKED}, {blend_sql(0.5, 'true', 50)}"),
    "masked_blend": with_views(*IQ, more=f"{ALL_RANKED}, {blend_sql(0.25, 'item_pos % 2 = 0', 20)}"),
    "blend_grid": with_views(*IQ, "gold_fx", more=f"{LEXICAL}, {BLEND_GRID}"),
    "cosine_topk": with_views("vectors_fx", "geo_pairs_fx", more=DENSE) + " SELECT * FROM (SELECT query_id, item_pos, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_pos) AS rank FROM cosines) WHERE rank <= 50",
    "semantic_dual_topk": with_views("vectors_fx", "geo_pairs_fx", more=DENSE) + " SELECT query_id, item_pos, kind, score, rank FROM near",
    "embedding_features": with_views("vectors_fx", "geo_pairs_fx", more=DENSE) + f""", nl AS (SELECT query_id, item_pos, max(1e0 / (60 + rank)) FILTER (kind = 'global') AS rw, max(1e0 / (60 + rank)) FILTER (kind = 'geo') AS ge FROM near GROUP BY ALL),
nb AS (SELECT query_id, max(score) AS top FROM near WHERE kind = 'global' GROUP BY 1)
SELECT query_id, item_pos, round(cosine, 8) + 0e0 AS e5_cosine, round(cosine - top, 8) + 0e0 AS e5_cosine_gap, round(coalesce(rw, 0), 8) AS e5_rank, round(cosine + {CONFIG.e5_geo}e0 * ln(factor), 8) + 0e0 AS e5_geo_score,
  round(coalesce(ge, 0), 8) AS e5_geo_rank, (rw IS NOT NULL)::INT::DOUBLE AS e5_present, (ge IS NOT NULL)::INT::DOUBLE AS e5_geo_present, (item_pos % 2 = 0)::INT::DOUBLE AS text_present,
  round(CASE WHEN item_pos % 2 = 0 THEN 1e0 / (60 + item_pos) ELSE 0 END + {CONFIG.e5_weight}e0 * coalesce(ge, 0) * (1 + {CONFIG.prior}e0 * ((item_pos % 5) / 5e0)), 8) AS hybrid_rrf
FROM nl JOIN dense USING (query_id, item_pos) JOIN nb USING (query_id)""",
    "core_features": with_views(*IQ, "geo_pairs_fx", more=_core_sql()),
    "text_split": """WITH t AS (SELECT p_partkey::VARCHAR AS q FROM part), a AS (SELECT q FROM t ORDER BY md5('11|' || q), q LIMIT 150), b AS (SELECT q FROM t WHERE q NOT IN (FROM a) ORDER BY md5('12|' || q), q LIMIT 150),
c AS (SELECT q, row_number() OVER (ORDER BY md5('20260928|' || q), q) AS k FROM t WHERE q NOT IN (FROM a) AND q NOT IN (FROM b))
SELECT q AS query_norm, 'previous' AS split FROM a UNION ALL SELECT q, 'previous' FROM b UNION ALL SELECT q, CASE WHEN k <= 100 THEN 'val' WHEN k <= 200 THEN 'test' ELSE 'fit' END FROM c""",
    "negative_sampling": with_views(*IQ, "gold_fx", more=f"{LEXICAL}, {LABELLED}") + " SELECT query_id, item_pos, kind FROM sel",
    "balanced_pairs": with_views(*IQ, "gold_fx", more=f"{LEXICAL}, {LABELLED}") + " SELECT a.query_id, a.item_pos AS winner, b.item_pos AS loser, round(192e0 / count(*) OVER (PARTITION BY a.query_id), 6) AS weight FROM sel a JOIN sel b ON a.query_id = b.query_id AND a.is_gold AND NOT b.is_gold",
    "recall_at_50": with_views(*IQ, "gold_fx", "geo_pairs_fx", more=JUDGED) + " SELECT query_id, round(recall, 6) AS recall FROM e",
    "candidate_coverage": with_views(*IQ, "gold_fx", "geo_pairs_fx", more=JUDGED) + " SELECT query_id, round(coverage, 6) AS coverage FROM e",
    "loss_decomposition": with_views(*IQ, "gold_fx", "geo_pairs_fx", more=JUDGED) + " SELECT query_id, round(recall, 6) AS recall, round(coverage - recall, 6) + 0e0 AS ranking_loss, round(1 - coverage, 6) + 0e0 AS retrieval_loss FROM e",
    "recall_by_slice": with_views(*IQ, "gold_fx", "geo_pairs_fx", more=JUDGED) + " SELECT search_location_id < 20 AS present, count(*) AS n, round(avg(recall), 6) AS mean FROM e GROUP BY 1",
    "paired_delta": "WITH x AS (SELECT (round(c_acctbal, 0) + c_custkey % 3 - 1) - round(c_acctbal, 0) AS d FROM customer) SELECT count(*) AS n, round(avg(d), 6) + 0e0 AS mean_delta, count_if(d > 0)::BIGINT AS wins, count_if(d < 0)::BIGINT AS losses FROM x",
    "many_to_one": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "grid_best": with_views(*IQ, more=f"{LEXICAL}, {GRID}") + " SELECT location, service, value FROM g ORDER BY value DESC, location, service LIMIT 1",
    "grid_pivot": with_views(*IQ, more=f"{LEXICAL}, {GRID}") + " SELECT location, any_value(value) FILTER (service = 1) AS service_1, any_value(value) FILTER (service = 2) AS service_2 FROM g GROUP BY 1",
    "null_counts": with_views(*I) + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM items_fx" for c in ("item_id", "item_pos", "title", "params", "description", "location_id", "category_id", "microcat_id", "rating", "reviews")),
    "quality_checks": with_views(*IQ) + " SELECT count_if(reviews < 0)::BIGINT AS negative_reviews, count_if(rating < 0 OR rating > 5)::BIGINT AS rating_out_of_range, count_if(coalesce(trim(title), '') = '')::BIGINT AS empty_titles, count(*) - count(DISTINCT item_id) AS duplicate_ids, (SELECT count(*) FROM queries_fx WHERE search_location_id NOT IN (SELECT location_id FROM items_fx)) AS sources_not_in_catalogue FROM items_fx",
    "dataset_profile": with_views(*I) + " SELECT count(*) AS rows, " + ", ".join(f"count(DISTINCT {c}) AS {c}_distinct, count({c}) - count(DISTINCT {c}) AS {c}_repeats" for c in ("title", "location_id", "category_id")) + " FROM items_fx",
    "category_share": with_views(*IQ) + ", a AS (SELECT category_id AS c, count(*)::DOUBLE / sum(count(*)::DOUBLE) OVER () AS s FROM items_fx GROUP BY 1), b AS (SELECT search_category AS c, count(*)::DOUBLE / sum(count(*)::DOUBLE) OVER () AS s FROM queries_fx GROUP BY 1) SELECT c, round(coalesce(a.s, 0), 6) AS item_share, round(coalesce(b.s, 0), 6) AS query_share FROM a FULL JOIN b USING (c)",
    "gold_sets": with_views("gold_fx") + " SELECT query_id, string_agg(DISTINCT item_id, ' ' ORDER BY item_id) AS gold FROM gold_fx GROUP BY 1",
    "gold_histogram": with_views("queries_fx", "gold_fx") + ", s AS (SELECT q.query_id, count(DISTINCT g.item_id) AS gold_size FROM queries_fx q LEFT JOIN gold_fx g ON q.query_id = g.query_id GROUP BY 1) SELECT gold_size, count(*) AS queries FROM s GROUP BY 1",
    "dedup_catalogue": with_views(*I) + ", u AS (SELECT item_id, item_pos, md5(title) AS title_md5, 0 AS priority FROM items_fx UNION ALL SELECT item_id, item_pos, 'later', 1 FROM items_fx UNION ALL SELECT 'x' || item_id, item_pos, md5(title), 1 FROM items_fx) SELECT item_id, item_pos, title_md5, priority FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority, item_pos) AS r FROM u) WHERE r = 1",
    "encoder_text": with_views(*I) + " SELECT item_id, md5('passage: ' || title[:200] || CASE WHEN params = '' THEN '' ELSE ' ' || params[:200] END) AS text_md5 FROM items_fx",
    "answer_lines": with_views(*IQ, "geo_pairs_fx", more=f"{SEARCH}, {fill_sql('ans', 'f')}") + " SELECT query_id, string_agg(item_id, ' ' ORDER BY rank) AS answer FROM f JOIN items_fx USING (item_pos) GROUP BY 1",
}
