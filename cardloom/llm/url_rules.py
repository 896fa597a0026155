"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix, or a regular expression with a literal that each of its matches holds as a whole
token. Rules are indexed by the one of their tokens that the fewest rules have. A URL's own tokens fetch candidate
rules, and only on those a regular expression runs. The longest matching rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_DDL = "action string, host string, path string"
PATTERNS_DDL = "action string, pattern string, literal string"

#: The rules of the registered query, and patterns that decide where no rule fits.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
PATTERNS = [
    ("block", r"(^|[./-])casino-win([./-]|$)", "casino"),
    ("block", r"(^|[./-])cheap-pills([./-]|$)", "pills"),
    ("block", r"(^|[./-])free-bets([./-]|$)", "bets"),
    ("block", r"(^|[./-])spam-farm([./-]|$)", "spam"),
    ("block", r"(^|[./-])ads-track([./-]|$)", "ads"),
    ("block", r"(^|[./-])adult-x([./-]|$)", "adult"),
]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters, digits and bytes beyond ASCII in host and path; and the empty token, for rules without any."""
    return F.array_distinct(F.split(F.concat_ws("/", F.lit(""), host, path), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def index_rules(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(token, kind, rule, action, size, regex): each rule once, under the rarest of its whole literal tokens."""
    quote = lambda c: F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))
    fixed = rules.select(
        "action",
        F.concat("host", F.regexp_replace("path", "^/", "/")).alias("rule"),
        F.length(F.concat("host", "path")).alias("size"),
        F.lit(1).alias("kind"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quote(F.col("host")), F.when(F.col("path") == "", "(?:/|$)").otherwise(quote(F.col("path")))).alias("regex"),
        # The last piece of the path may go on in the URL, so it is no whole token.
        url_tokens(F.col("host"), F.regexp_replace("path", "[^/]*$", "")).alias("tokens"),
    )
    free = patterns.select("action", F.col("pattern").alias("rule"), F.length("pattern").alias("size"), F.lit(0).alias("kind"), F.col("pattern").alias("regex"), F.array(F.coalesce("literal", F.lit(""))).alias("tokens"))
    each = fixed.unionByName(free).dropDuplicates(["action", "rule", "kind"]).select("*", F.explode("tokens").alias("token"))
    spread = each.withColumn("rules", F.count("*").over(W.partitionBy("token")))
    rank = W.partitionBy("action", "rule", "kind").orderBy((F.col("token") == "").cast("int"), "rules", F.length("token").desc(), "token")
    return spread.withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("token", "kind", "rule", "action", "size", "regex")


def judge_urls(pages: DataFrame, rules: DataFrame, patterns: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages.

    The longest fitting rule decides (of equal ones the first by rule, then action); else the longest matching pattern;
    else the verdict is allow. rule is null where none fits, pattern null where none was needed. A null URL, or one
    without ://, has an empty host and path, which no rule with a host fits. Repeated rows come back as often; other
    columns are left out. The rules are broadcast if they are few enough (checked), else joined by token.
    """
    index = small(index_rules(rules, patterns))
    # Equal rows are judged once; one exchange serves both groupings.
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    parts = urls.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    asked = parts.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    found = asked.join(index, "token", "left")
    fits = F.col("regex").isNotNull() & F.expr("rlike(concat(host, path), regex)")
    best = F.max(F.when(fits, F.struct("kind", "size", F.col("rule").alias("rule"), F.col("action").alias("action"))))
    judged = found.groupBy("page_id", "url").agg(best.alias("best"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"))
    ruled = F.col("best.kind") == 1
    out = judged.select(
        "page_id", "host", "path",
        F.when(ruled, F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        F.when(~ruled, F.col("best.rule")).alias("pattern"),
        "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by the fixed rules, and by spam patterns where no rule fits."""
    rules = spark.createDataFrame(RULES, RULES_DDL)
    patterns = spark.createDataFrame(PATTERNS, PATTERNS_DDL)
    return judge_urls(table(spark, sf_dir, "pages"), rules, patterns)


def _oracle() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    patterns = ", ".join(f"('{a}', '{p}')" for a, p, _ in PATTERNS)
    return rf"""
WITH rules(action, h, p) AS (VALUES {rules}), patterns(action, pattern) AS (VALUES {patterns}),
u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS n FROM pages),
r AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
m AS (SELECT n, max((length(pattern), pattern, action)) AS best FROM u JOIN patterns ON regexp_matches(host || path, pattern) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(r.action, best[3], 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN best[2] END AS pattern
FROM u LEFT JOIN r USING (n) LEFT JOIN m USING (n)"""


QUERIES = {"op3_url_rules": op3_url_rules}
ORACLES = {"op3_url_rules": _oracle()}
