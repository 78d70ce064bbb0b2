"""Quality rules: per-document repetition measures and cross-document line frequency.

Column expressions only. Cross-document: lines are normalised (trimmed, lower-cased, digit runs to
0, blanks to one space) and hashed; for each host the number of distinct documents with a line is
counted; lines in more documents than the host's limit are removed, and documents that lose more
than half of their words are depleted. A host's limit is ``max_share`` of its documents, at least
``min_docs``. Repeated word windows are found by 64-bit hashes of eight words within one document.

Defined results: null text has no word and no line and fails; null host is a host of its own;
repeated rows count as documents of their own; a very long text is one row, measured in n log n; an
empty table gives an empty result. Input columns with the names of output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialise, read, without
from .secrets import let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.5
#: Above this many frequent lines the join is left to a shuffle.
BROADCAST_LINES = 500_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\x0b\f\r"


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more; ``words`` is a lambda variable."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(WINDOW)])))

    def covered(rows: Column) -> Column:
        """rows: (hash, place) sorted; a place counts if a neighbour has its hash."""
        near = F.transform(rows, lambda x, i: F.when((i > 0) & (F.get(rows, i - 1)["h"] == x["h"]) | (F.get(rows, i + 1)["h"] == x["h"]), x["p"]))
        places = F.sort_array(F.filter(near, lambda p: p.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n")), lambda a: a["n"])

    def counted(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(rows, covered)).otherwise(F.lit(0))

    return F.when(n > WINDOW, let(windows, counted)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of ``MEASURES`` as longs."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.lit([]).cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), repeated_words(w).alias("r")))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    values = let(by_word, lambda w: F.struct(w["n"].cast("long").alias("n_words"), w["c"].cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), repeats.cast("long").alias("n_dup_lines"), w["r"].cast("long").alias("n_repeat_words")))
    return values


def line_rows(text: Column, host: Column) -> Column:
    """Array of (k: hash of host and normalised line, w: words) for the lines with a word."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    where = F.when(host.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), host.cast("string")))

    def row(line: Column) -> Column:
        norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line, F.lit(_BLANKS))), "[0-9]+", "0"), f"[{BLANK}]+", " ")
        return F.struct(F.xxhash64(where, norm).alias("k"), F.regexp_count(line, F.lit(f"[^{BLANK}]+")).alias("w"))

    return F.transform(lines, row)


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """Keys of the lines above their host's limit."""
    hosts = docs.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("docs"))
    limits = hosts.select("host", F.greatest(F.lit(min_docs).cast("double"), F.col("docs") * F.lit(max_share)).alias("limit"))
    keys = F.array_distinct(F.transform(line_rows(F.col(text_col), F.col(host_col)), lambda x: x["k"]))
    counts = docs.select(F.col(host_col).alias("h"), F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.first("h").alias("h")).where(F.col("n") > min_docs)
    return counts.join(limits, counts["h"].eqNullSafe(limits["host"])).where(F.col("n") > F.col("limit")).select("k")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents (without text) with measures, ``words_left``, ``base_failed`` and ``kept``."""
    docs = without(docs, *MEASURES, "words_left", "base_failed", "kept")
    frequent = frequent_lines(docs, text_col, host_col, min_docs, max_share)
    frequent = materialise(frequent, "frequent-lines")
    few = frequent.count() <= BROADCAST_LINES
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), measures(F.col(text_col)).alias("m"), line_rows(F.col(text_col), F.col(host_col)).alias("l"), F.monotonically_increasing_id().alias("row"))
    lines = rows.select("d", "m", "row", F.explode_outer("l").alias("x")).select("d", "m", "row", F.col("x.k").alias("key"), F.col("x.w").alias("w"))
    marked = lines.join((F.broadcast(frequent) if few else frequent).withColumn("often", F.lit(1)), lines["key"] == frequent["k"], "left")
    lost = F.coalesce(F.sum(F.when(F.col("often") == 1, F.col("w"))), F.lit(0)).cast("long")
    # one row for each document after the map side; the first of equal values is that value
    out = marked.groupBy("row").agg(F.first(F.struct("d", "m")).alias("d"), lost.alias("lost"))
    out = out.select(*[F.col(f"d.d.`{c}`").alias(c) for c in kept], *[F.col(f"d.m.{m}") for m in MEASURES], (F.col("d.m.n_words") - F.col("lost")).alias("words_left"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("words_left") >= min_left * F.col("n_words")))


def op4_quality_rules(spark, sf_dir):
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")
