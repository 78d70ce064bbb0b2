"""URL filter: host rules, and trust and distrust propagated over the host link graph.

Column expressions only. The longest rule whose host is the URL's host or a parent of it, and whose
path begins the URL's path, decides. Where none fits, trust and distrust decide. Trust is a personalised
PageRank: it flows along links from hosts with allowed pages; a seed's mass is the share of its pages
that a rule allows. Distrust flows against links: a host has that of the hosts it links to, weighted by
the shares of its own links and damped, or the share of its pages that a rule blocks if that is more, so
it does not depend on how many others link to a blocked host. A host is blocked if its distrust is above
its trust and above ``threshold``. Each iteration is one join of the scores with the edges and a sum
that combines before its shuffle.

Scores are in the unit of a seed's mass (a host all of whose pages a rule decides starts with 1 less
damping); the flow is linear, so normalising the seeds would only change the unit, and ``threshold`` is
stated in it.

Defined results: null URL or one without ``://`` has an empty host and path and is allowed; null
html has no links; links within a host are no edges; repeated rows are judged one by one, and each
counts as a page in the shares and edges of its host; a very long html is one row; an empty
table gives an empty result; input columns with the names of output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, without

#: Fixed values of the query: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Steps along links; what is farther away has less than damping ** 20, 4 %, of a seed's mass.
ITERATIONS = 20
THRESHOLD = 0.5 * (1 - DAMPING)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, _rules): the rules of a host and its parents, as structs (size, rule, path, verdict)."""
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    exploded = hosts.select("host", F.explode(parents).alias("parent"))
    cut = F.instr("rule", "/")
    table = rules.select("rule", "verdict", F.substring("rule", F.lit(1), cut - 1).alias("parent"), F.substring("rule", cut, F.length("rule")).alias("path"), F.length("rule").alias("size"))
    return exploded.join(table, "parent").groupBy("host").agg(F.collect_list(F.struct("size", "rule", "path", "verdict")).alias("_rules"))


def best_rule(rules: Column, page_path: Column) -> Column:
    """The longest fitting rule; of equal lengths the last by code point."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(page_path, r["path"])))


def edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, pages): links between different hosts; ``pages`` must have ``host``."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust) for hosts that any mass reaches; ``seeds`` has host, trust, distrust."""
    forward = links.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "pages")
    flow = forward.unionByName(links.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "pages"))
    out = flow.groupBy("kind", "a").agg(F.sum("pages").alias("out"))
    flow = materialise(flow.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("pages") / F.col("out")).alias("share")), "edges")
    start = seeds.select(F.lit("t").alias("kind"), "host", F.col("trust").alias("mass")).unionByName(seeds.select(F.lit("d").alias("kind"), "host", F.col("distrust").alias("mass"))).where("mass > 0")
    start = materialise(start.select("kind", "host", (F.col("mass") * F.lit(1 - damping)).alias("score")), "seeds")
    score = start
    for i in range(iterations if flow.head(1) else 0):
        from_here = score.select("kind", F.col("host").alias("a"), "score").join(flow, ["kind", "a"])
        moved = from_here.select("kind", F.col("b").alias("host"), (F.col("score") * F.col("share") * F.lit(damping)).alias("score"))
        score = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 4 == 3:
            score = materialise(score, "scores")
    return score.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(name) for k, name in (("t", "trust"), ("d", "distrust"))])


def exposure(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, distrust) for hosts that any distrust reaches, in the scale of a seed's mass."""
    out = links.groupBy("src").agg(F.sum("pages").alias("out"))
    flow = materialise(links.join(out, "src").select("src", "dst", (F.col("pages") / F.col("out")).alias("share")), "out-links")
    start = materialise(seeds.where("distrust > 0").select("host", (F.col("distrust") * F.lit(1 - damping)).alias("score")), "blocked")
    score = start
    for i in range(iterations if flow.head(1) else 0):
        moved = score.withColumnRenamed("host", "dst").join(flow, "dst").groupBy(F.col("src").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * F.lit(damping)).alias("score"))
        score = start.unionByName(moved).groupBy("host").agg(F.max("score").alias("score"))
        if i % 4 == 3:
            score = materialise(score, "distrust")
    return score.withColumnRenamed("score", "distrust")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html", damping: float = DAMPING, iterations: int = ITERATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """The pages (without html) with host, path, rule, verdict, trust and distrust."""
    kept = [c for c in without(pages, "host", "path", "rule", "verdict", "trust", "distrust").columns if c != html_col]
    pages = pages.select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    counted = materialise(pages.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    known = materialise(rules_of_hosts(counted, rules), "host-rules")

    def with_rule(p: DataFrame) -> DataFrame:
        return p.join(known, "host", "left").withColumn("_best", best_rule(F.col("_rules"), F.col("path"))).drop("_rules")

    def share(verdict: str) -> Column:
        return F.sum(F.when(F.col("_best.verdict") == verdict, 1).otherwise(0)) / F.count("*")

    seeds = with_rule(pages.select("host", "path")).groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = materialise(edges(pages.select("host", "html")), "links")
    seeds = materialise(seeds, "seed-shares")
    trusted = propagate(links, seeds.withColumn("distrust", F.lit(0.0)), damping, iterations).select("host", "trust")
    scores = materialise(trusted.join(exposure(links, seeds, damping, iterations), "host", "full"), "host-scores")
    judged = with_rule(pages.drop("html")).join(scores, "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust > trust) & (distrust > F.lit(threshold)) & (F.col("host") != ""), "block").otherwise("allow")
    verdict = F.coalesce(F.col("_best.verdict"), own)
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def op6_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _steps() -> str:
    """The iterations of trust (t) and distrust (e) as common table expressions."""
    out = ["t0 AS (SELECT host, t AS score FROM start WHERE t > 0), e0 AS (SELECT host, d AS score FROM start WHERE d > 0)"]
    for i in range(ITERATIONS):
        out.append(f"t{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM t0 UNION ALL SELECT dst, score * share * {DAMPING}e0 FROM t{i} JOIN flow ON host = src) GROUP BY 1)")
        out.append(f"e{i + 1} AS (SELECT host, max(score) AS score FROM (SELECT * FROM e0 UNION ALL SELECT src, sum(score * share) * {DAMPING}e0 FROM e{i} JOIN flow ON host = dst GROUP BY 1) GROUP BY 1)")
    return ",\n".join(out)


_HOST = f"translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}')"
OP6_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
cut AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM rules),
u AS (SELECT row_number() OVER () AS rid, page_id, html, {_HOST} AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
best AS (SELECT rid, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
         FROM u JOIN cut ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY 1),
p AS (SELECT u.*, best.rule, best.verdict FROM u LEFT JOIN best USING (rid)),
links AS (SELECT src, dst, count(*) AS pages FROM (SELECT DISTINCT rid, host AS src,
            translate(unnest(regexp_extract_all(coalesce(html, ''), '{_LINK.replace("'", "''")}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM u WHERE host <> '')
          WHERE src <> dst GROUP BY ALL),
flow AS (SELECT src, dst, pages / sum(pages) OVER (PARTITION BY src) AS share FROM links),
seeds AS (SELECT host, count_if(verdict = 'allow') / count(*) AS t, count_if(verdict = 'block') / count(*) AS d FROM p GROUP BY 1),
start AS (SELECT host, t * {1 - DAMPING}e0 AS t, d * {1 - DAMPING}e0 AS d FROM seeds),
{_steps()},
s AS (SELECT coalesce(t.host, e.host) AS host, coalesce(t.score, 0) AS trust, coalesce(e.score, 0) AS distrust FROM t{ITERATIONS} t FULL JOIN e{ITERATIONS} e ON t.host = e.host)
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) AND coalesce(distrust, 0) > {THRESHOLD}e0 AND p.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s ON p.host = s.host
"""
