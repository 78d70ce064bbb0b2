"""Secret scan: fixed patterns plus character Markov models of random strings and identifiers.

Column expressions only. The base kinds (assign, access, hex) are leftmost non-overlapping pattern
matches; matches with too short a value are dropped after matching. The method adds spans of kind
``markov``: runs of at least ``MIN_RUN`` key characters that overlap no base span and whose mean
log-likelihood ratio, random against identifier, over their character pairs exceeds ``min_llr``.
Both models are pair models with additive smoothing, trained from labelled samples (text, label 1
for random strings and 0 for identifiers): ``labelled`` takes them from a bounded sample of documents,
where the base patterns say what is a secret, and ``samples`` makes more from word lists and hashes of
counters, so that a corpus without secrets has a model too. ``rates`` measures a model on other rows.

Positions are code points, the end exclusive; they come from running sums over the matches' widths, and
runs are held against base spans in one pass over both in order, so a text's cost follows its length and
its matches. Defined results: null text is empty text and has no span; equal spans of several kinds
are all kept, ordered by start and then kind; a very long text is one row; repeated rows are judged one by
one; an empty table gives an empty result. Input columns with the names of output columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, without

#: Fixed patterns. `hex` and `access` runs are maximal, so a minimum length in the pattern equals dropping short matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
MIN_LLR = 0.6
#: The characters of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Ordinary words of four languages and of programs, for the identifier sample.
WORDS = """the and ing tion there with that from this have which their other about into time could people water these
number result value index table column request response handler service manager buffer stream config default
user name list count read write open close create delete update select insert session thread error message
und der die das einheit keit lichkeit schung verein nicht werden zwischen arbeit gesellschaft entwicklung moeglich
que los las para con una por como mente cion ciones estado nacional gobierno trabajo desarrollo tambien cuando
les des une dans pour avec ment tion aire elle eaux ouverture gouvernement developpement travail entreprise toujours""".split()

#: Documents that samples are taken from, at most, and the shortest identifier among them.
SAMPLE_DOCS = 2000
MIN_NAME = 8

SPAN = "array<struct<s:int,k:int,e:int>>"
#: Values that one step of a running sum or maximum copies, at most.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], first: int) -> Column:
    """Running sums or maxima of an array of integers that isn't empty: inside blocks, then over them."""

    def scan(block: Column) -> Column:
        start = F.array(F.lit(first))
        return F.aggregate(block, start, lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))), lambda a: F.slice(a, F.lit(2), F.size(block)))

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(first)), scan(F.transform(blocks, lambda x: F.element_at(x, -1))))
        return let(before, lambda c: F.flatten(F.transform(blocks, lambda block, i: F.transform(block, lambda x: combine(F.element_at(c, i + 1), x)))))

    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: let(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), scan))

    return let(let(values, cut), joined)


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, t): places and texts of all matches. What ``split`` leaves between the matches and
    the matches' widths give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(t: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(t))  # the last one is behind all matches
        ends = running(F.zip_with(gaps, t, lambda g, x: g + F.length(x)), lambda a, x: a + x, 0)
        return F.zip_with(ends, t, lambda e, x: F.struct((e - F.length(x)).cast("int").alias("s"), e.cast("int").alias("e"), x.alias("t")))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.lit([]).cast("array<struct<s:int,e:int,t:string>>"))


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, min_value: int = 0) -> Column:
    """(s, k, e) of all matches whose ``value_group`` has at least ``min_value`` characters."""
    found = matches(text, pattern)
    if value_group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        found = F.filter(F.zip_with(found, values, lambda x, v: F.when(F.length(v) >= min_value, x)), lambda x: x.isNotNull())
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def labelled(docs: DataFrame, text_col: str = "text", limit: int = SAMPLE_DOCS, fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """(text, label) from at most ``limit`` documents, chosen by the hash of their text: values that the
    base patterns find are random strings, and runs of key characters in what is left are identifiers.
    ``fold`` is a condition on the text, to hold documents out."""
    text = F.col(text_col)
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(text.isNotNull())
    if fold is not None:
        rows = rows.where(fold(F.col("text")))
    n = rows.count()
    share = min(1.0, (2 * limit + 64) / max(n, 1))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct().orderBy("h", "text").limit(limit).select("text")
    text = F.col("text")
    assigned = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    values = F.concat(assigned, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    rest = text
    for p in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    names = F.regexp_extract_all(rest, F.lit(f"[A-Za-z][A-Za-z0-9_-]{{{MIN_NAME - 1},}}"), F.lit(0))
    both = F.concat(F.transform(values, lambda v: F.struct(v.alias("text"), F.lit(1).alias("label"))), F.transform(names, lambda v: F.struct(v.alias("text"), F.lit(0).alias("label"))))
    return drawn.select(F.explode(both).alias("x")).select("x.text", "x.label").distinct()


def rates(rows: DataFrame, ratios: list[float], min_llr: float = MIN_LLR, min_run: int = MIN_RUN) -> DataFrame:
    """(label, n, flagged): how many labelled strings of at least ``min_run`` characters there are, and the
    share of them that the models call random."""
    judged = rows.where(F.length("text") >= min_run).select("label", (mean_llr(F.col("text"), ratios) > min_llr).cast("int").alias("hit"))
    return judged.groupBy("label").agg(F.count("*").alias("n"), F.avg("hit").alias("flagged"))


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples, ``n`` of each kind: hex, base 64 and upper-case base 36 strings from hashes;
    and one to four words joined as snake, kebab, camel or path names, some with a number."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+/=]", ""))
    alnum = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(digest, F.lit("x")), 256))), "[+/=]", "")
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, raw).when(F.col("id") % 4 == 2, alnum).otherwise(upper)
    table = F.lit(WORDS)

    def pick(i: int) -> Column:
        return F.element_at(table, (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(len(WORDS))) + 1).cast("int"))

    words = F.slice(F.array(*[pick(i) for i in range(4)]), F.lit(1), (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(4)) + 1).cast("int"))
    style = F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(6))
    name = (
        F.when(style == 0, F.array_join(words, "_")).when(style == 1, F.array_join(words, "-")).when(style == 2, F.array_join(F.transform(words, F.initcap), ""))
        .when(style == 3, F.upper(F.array_join(words, "_"))).when(style == 4, F.array_join(words, "/")).otherwise(F.array_join(words, ""))
    )
    name = F.when(F.col("id") % 5 == 0, F.concat(name, (F.col("id") % 100).cast("string"))).otherwise(name)
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(name.alias("text"), F.lit(0).alias("label")))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the character pairs, row by row of ``ALPHABET`` squared.

    The pairs are counted in Spark; what reaches the driver is bounded by the alphabet.
    """
    chars = F.filter(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = let(chars, lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)))))
    counts = labelled.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    size = len(ALPHABET)
    table = {k: [smoothing] * size * size for k in (0, 1)}
    for label, pair, n in counts.collect():
        table[label][ALPHABET.index(pair[0]) * size + ALPHABET.index(pair[1])] += n
    out = []
    for a in range(size):
        rows = [table[k][a * size : (a + 1) * size] for k in (1, 0)]
        out += [math.log(x / sum(rows[0])) - math.log(y / sum(rows[1])) for x, y in zip(*rows, strict=True)]
    return [round(x, 6) for x in out]


def mean_llr(run: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a string over its pairs of model characters."""
    table = F.expr("cast(split('" + ",".join(map(str, ratios)) + "', ',') as array<double>)")
    size = len(ALPHABET)
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def mean(p: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(p) - 1)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.element_at(table, (F.element_at(p, i) - 1) * size + F.element_at(p, i + 1)))
        return total / (F.size(p) - 1)

    return F.when(F.length(run) > 1, let(F.filter(places, lambda x: x > 0), mean))


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", min_llr: float = MIN_LLR, min_run: int = MIN_RUN) -> DataFrame:
    """Adds ``base`` and ``found``: sorted arrays of (s, k, e), k an index into ``KINDS``."""
    docs = without(docs, "base", "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.sort_array(F.concat(spans(text, ASSIGN, 0, 2, MIN_VALUE), spans(text, ACCESS, 1), spans(text, HEX, 2)))
    run = RUN % min_run
    none = F.lit(None).cast("string")

    def added(b: Column) -> Column:
        own = F.transform(b, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), none.alias("t")))
        found = F.transform(matches(text, run), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"), x["t"].alias("t")))
        return let(F.sort_array(F.concat(own, found)), apart)

    def apart(x: Column) -> Column:
        """Runs, which don't overlap one another, that end before the next base span and begin after all before."""
        ends = running(F.transform(x, lambda y: F.when(y["k"] < 3, y["e"]).otherwise(0)), lambda a, y: F.greatest(a, y), 0)

        def free(ends: Column) -> Column:
            def clear(y: Column, i: Column) -> Column:
                behind = F.get(x, i + 1)
                return (y["k"] == 3) & (F.coalesce(F.get(ends, i - 1), F.lit(0)) <= y["s"]) & ~F.coalesce((behind["k"] < 3) & (behind["s"] < y["e"]), F.lit(False))

            return F.filter(x, clear)

        random = F.filter(let(ends, free), lambda y: mean_llr(y["t"], ratios) > min_llr)
        return F.transform(random, lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e")))

    more = F.when(text.rlike(run), added(F.col("base"))).otherwise(F.lit([]).cast(SPAN))
    return docs.withColumn("base", base).withColumn("found", F.sort_array(F.concat("base", more)))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by ``mask``."""
    found = scan(docs, ratios, text_col, **options)
    start = F.struct(F.lit(1).alias("p"), F.lit("").alias("o"))
    text = F.col(text_col)

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] + 1 >= a["p"]
        o = F.when(fresh, F.concat(a["o"], F.substring(text, a["p"], x["s"] + 1 - a["p"]), F.lit(mask))).otherwise(a["o"])
        return F.struct(F.greatest(a["p"], x["e"] + 1).alias("p"), o.alias("o"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(a["o"], F.substring(text, a["p"], F.length(text))))
    return found.withColumn(text_col, F.when(F.size("found") > 0, clean).otherwise(text)).drop("base", "found")


def fit(docs: DataFrame, text_col: str = "text", **options) -> list[float]:
    """Models of a corpus: its own labelled samples and the generated ones."""
    return train(labelled(docs, text_col, **options).unionByName(samples(docs.sparkSession)))


def op3_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
