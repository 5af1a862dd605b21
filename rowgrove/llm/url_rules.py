"""URL filters: host-suffix and path-prefix expressions joined with a rule table on short hash prefixes.

Every URL is expanded into the expressions that a rule could have written for it, the expressions meet the
rules on the first hex digits of their SHA-256, full digests confirm a match, and the longest rule wins.

A URL's expressions come from one row and are brought back to one row before the only shuffle of rows, which has a row for each row of the input and goes
by key and address, so URLs without a host aren't a hot key. Expressions are made by two short lists (labels of a host, lengths of a path),
so the plan doesn't grow with the rules.

Defined results: a null URL, or one without ``://``, has an empty host and path and so meets no rule; an empty
table gives an empty result; repeated rows are judged together and each keeps its own result; columns of the
input other than the key and the URL are ignored, so they cannot clash. Of two fitting rules of one length the
one with the longer host wins; a rule listed twice counts once, and ``block`` beats ``allow`` in that case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT_VERDICT = "allow"
#: Hex digits of the join key; longer prefixes only make fewer false meetings.
PREFIX_DIGITS = 8
#: Rules up to this number are broadcast (at most about 1 KB each); more of them are joined by a shuffle.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a relation (verdict, rule_host, rule_path)."""
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row of ``pages`` by ``rules`` (verdict, rule_host, rule_path).

    Returns key, host, path, rule (null where none fits) and verdict (the rule's, else ``default``).
    """
    rules = (
        rules.groupBy(ascii_lower(F.col("rule_host")).alias("rule_host"), F.col("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("chars", F.length("rule_path"))
    )
    # What rules are written for says which expressions are worth making: so many labels of the host, so many characters of the path.
    kinds = rules.agg(F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("chars")).alias("chars"), F.count("*").alias("n")).first()
    # Rules that share a short prefix (few do) stand in one row, so an expression meets at most one.
    rules = rules.groupBy("short").agg(F.collect_list(F.struct("digest", "rule", "rule_verdict", "rule_host")).alias("here"))
    rules = F.broadcast(rules) if kinds.n <= BROADCAST_RULES else rules

    seen = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not kinds.n:
        return seen.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    # Suffixes from the whole host down, prefixes of the path; those that the address is too short for are left out.
    suffixes = F.transform(F.filter(F.array(*map(F.lit, kinds.labels)), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    lengths = F.filter(F.array(*map(F.lit, kinds.chars)), lambda c: c <= F.length("path"))
    prefixes = F.transform(lengths, lambda c: F.substring(F.col("path"), F.lit(1), c))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    spread = seen.select("key", "host", "path", F.posexplode_outer(F.array_distinct(expressions)).alias("at", "expression"))
    spread = spread.withColumn("expression_digest", F.sha2("expression", 256)).withColumn("short", F.substring("expression_digest", 1, PREFIX_DIGITS))
    met = spread.join(rules, "short", "left")
    rule = F.element_at(F.filter("here", lambda r: r["digest"] == F.col("expression_digest")), F.lit(1))
    fits = F.exists("here", lambda r: r["digest"] == F.col("expression_digest"))
    best = F.when(fits, F.struct(F.length(rule["rule"]).alias("n"), F.length(rule["rule_host"]).alias("h"), rule["rule"].alias("rule"), rule["rule_verdict"].alias("rule_verdict")))
    first = F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)  # each row of the input has one first expression, or none at all
    judged = met.groupBy("key", "host", "path").agg(F.max(best).alias("best"), F.sum(first).alias("times"))
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")
    ).drop("_")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = {
    "op5_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT h.page_id, h.host, h.path, rh || rp AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
