"""Role views: the driver tables as catalogue, searches, known positives and training pairs.

Each view exists twice: as a DataFrame here, and as a DuckDB table expression in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, normalize


#: From the first character with ink to the end of its line: the first line with a word.
FIRST_LINE = r"[^\x09-\x0D\x20][^\n]*"
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстуввхыз"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex_id(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def positions(df: DataFrame, key: str, name: str = "item_pos", bucket: Column | None = None) -> DataFrame:
    """Adds the 0-based place by a distinct ``key``.

    ``bucket`` is an expression that rises with the key, by default the key in ranges of 65,536. A
    bucket's first place is the number of rows in the buckets before it, so only the counts are
    ordered in one task, and only keys are ordered bucket by bucket; the rows join their numbers.
    """
    keys = df.select(F.col(key).alias("_key")).withColumn("_range", F.floor(F.col("_key") / 65536) if bucket is None else bucket)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy("_key")
    numbers = keys.withColumn("_place", F.row_number().over(within)).join(starts, "_range").select("_key", (F.col("_start") + F.col("_place") - 1).alias(name))
    # both sides by the key: rows with texts come out spread evenly
    return df.join(numbers.hint("shuffle_hash"), df[key] == numbers["_key"]).drop("_key")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: documents with what labels say of them."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    d = positions(d, "doc_id")
    text = normalize(F.col("text"))
    known = F.col("l_id").isNotNull()
    return d.join(lab, d["doc_id"] == lab["l_id"], "left").select(
        hex_id(F.col("doc_id")).alias("item_id"),
        "item_pos",
        normalize(F.regexp_extract("text", FIRST_LINE, 0)).alias("title"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("params"),
        text.alias("description"),
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("location_id"),
        F.when(F.col("lang") == "en", 114).when(F.col("lang") == "de", 115).when(F.col("lang") == "fr", 116).otherwise(117).cast("long").alias("category_id"),
        (F.col("doc_id") % 7).alias("microcat_id"),
        F.when(F.col("quality") == 1, 4.5).when(F.col("quality") == 0, 2.5).alias("rating"),
        F.when(known, (F.col("n_chars") % 100).cast("double")).alias("reviews"),
    )


def cyrillic(df: DataFrame, *columns: str) -> DataFrame:
    """Texts letter by letter in Cyrillic, so that Russian endings occur."""
    return df.withColumns({c: F.translate(c, LATIN, CYRILLIC) for c in columns})


def class_shares(items: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, item_microcat_id, p): a prior for every search, from the sizes of the classes."""
    shares = items.groupBy("microcat_id").agg(F.count("*").alias("c"))
    p = F.round(F.col("c") / (F.col("microcat_id") + 1) / n, 6)
    return queries.select("query_id").crossJoin(F.broadcast(shares)).select("query_id", F.col("microcat_id").alias("item_microcat_id"), p.alias("p"))  # seven rows


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches: the first words of benchmark texts."""
    b = read(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    params = F.when(item % 3 == 0, "").when(item % 3 == 1, "рейтинг пользователя 4,0 звезды и выше").otherwise("en src1")
    return b.select(
        hex_id(item).alias("query_id"),
        F.array_join(F.slice(F.split(normalize(F.col("text")), " "), 1, 6), " ").alias("search_query"),
        (item % 25).alias("search_location_id"),
        (item % 2 == 0).alias("delivery"),
        params.alias("search_params"),
        F.when(item % 4 == 0, 0).otherwise(114).cast("long").alias("search_category"),
    )


#: Pairs to judge are broadcast up to this many, some 8 MB; more are shuffled with the texts.
BROADCAST_PAIRS = 100_000


def gold(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Known positives: documents that hold a whole benchmark text; with ``pairs`` (query_id, item_id),
    a stored table, those among them.

    The needles are a stated query set and small (checked by the planner before it broadcasts).
    """
    d = read(spark, sf_dir, "documents").select(hex_id(F.col("doc_id")).alias("item_id"), "text")
    b = read(spark, sf_dir, "benchmark").select(hex_id(F.col("item_id")).alias("query_id"), F.col("text").alias("needle"))
    if pairs is not None:
        asked = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
        return d.join(asked, "item_id").join(b, "query_id").where(F.contains("text", "needle")).select("query_id", "item_id")
    return d.join(b, F.contains("text", "needle")).select("query_id", "item_id")


def geo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs for location statistics: who ordered what from where."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("o_custkey").cast("string").alias("query_norm"), F.col("c_nationkey").cast("long").alias("search_location_id"), F.col("l_suppkey").alias("item_id"), F.col("s_nationkey").cast("long").alias("item_location_id"))


def prior_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs for the category prior."""
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("query_norm"), F.col("p_type").alias("item_microcat_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors; the searches are those whose id is divisible by 20."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_pos"), F.col("embedding").alias("vector"), (F.col("vec_id") % 20).alias("location_id"))


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '{WHITE}', ' ', 'g'))"


_HEX = "lpad(lower(to_hex({0})), 16, '0')"
#: DuckDB twins of the views, to be used as common table expressions.
SQL = {
    "items_fx": f"""SELECT {_HEX.format('d.doc_id')} AS item_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS item_pos,
        {norm_sql(f"regexp_extract(text, '{FIRST_LINE}')")} AS title, lang || ' ' || source AS params, {norm_sql('text')} AS description,
        regexp_extract(source, '(\\d+)', 1)::BIGINT AS location_id,
        (CASE lang WHEN 'en' THEN 114 WHEN 'de' THEN 115 WHEN 'fr' THEN 116 ELSE 117 END)::BIGINT AS category_id, d.doc_id % 7 AS microcat_id,
        CASE quality WHEN 1 THEN 4.5e0 WHEN 0 THEN 2.5e0 END AS rating, CASE WHEN l.doc_id IS NOT NULL THEN (n_chars % 100)::DOUBLE END AS reviews
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "queries_fx": f"""SELECT {_HEX.format('item_id')} AS query_id, array_to_string(string_split({norm_sql('text')}, ' ')[1:6], ' ') AS search_query,
        item_id % 25 AS search_location_id, item_id % 2 = 0 AS delivery,
        CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'рейтинг пользователя 4,0 звезды и выше' ELSE 'en src1' END AS search_params,
        (CASE WHEN item_id % 4 = 0 THEN 0 ELSE 114 END)::BIGINT AS search_category FROM benchmark""",
    "gold_fx": f"SELECT {_HEX.format('b.item_id')} AS query_id, {_HEX.format('d.doc_id')} AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "geo_pairs_fx": """SELECT o_custkey::VARCHAR AS query_norm, c_nationkey::BIGINT AS search_location_id, l_suppkey AS item_id, s_nationkey::BIGINT AS item_location_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "prior_pairs_fx": "SELECT p_name AS query_norm, p_type AS item_microcat_id FROM part",
    "vectors_fx": "SELECT vec_id AS item_pos, embedding AS vector, vec_id % 20 AS location_id FROM embeddings",
}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause of the named views and further expressions."""
    return "WITH " + ",\n".join([f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else []))


def cyrillic_sql(table: str, *columns: str) -> str:
    """The named view with texts in Cyrillic, under its own name."""
    return f"SELECT * REPLACE ({', '.join(f"translate({c}, '{LATIN}', '{CYRILLIC}') AS {c}" for c in columns)}) FROM ({SQL[table]})"
