"""Operator 10, URL filters (native): host-suffix and path-prefix expressions.

Every URL is expanded into the expressions ``host suffix + path prefix`` that a
rule could have, as a lookup list of hashes does.  Expressions meet the rules in
an equi-join on a short prefix of their SHA-256 digest; the full digest confirms
a match, and of several matching rules the longest one decides.

Only suffixes with as many labels, and prefixes with as many characters, as some
rule has are expanded, so a URL of any length gives a bounded number of rows.
All distinct (host, path) pairs are judged once; repeated URLs get their
decision by a join that can be split when one URL is very frequent.

Defined results: a null URL, or one without ``://``, has empty host and path; no
rule fits an empty host.  ``path`` starts with the rule's path as plain text, so
an empty path does not match a rule whose path is ``/``.  Without a matching
rule the verdict is ``default``.  Equal rules with different verdicts: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name

#: Fixed values of the contract: (verdict, rule).
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
SHORT = 8  # hex digits of the joined hash prefix (32 bits)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules with host, path, label and length counts, and digests."""
    df = spark.createDataFrame(list(rules), "verdict string, rule string")
    return df.select(
        "rule", "verdict",
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.length("rule").alias("rule_length"),
        (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("path_length"),
        F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
        F.sha2("rule", 256).alias("rule_digest"),
        F.substring(F.sha2("rule", 256), 1, SHORT).alias("short"),
    )


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (names lengthened on a clash)."""
    spark = pages.sparkSession
    listed = rule_table(spark, rules)
    shape = listed.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    host, path = free_name(pages, "host"), free_name(pages, "path")
    split = pages.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))})

    keys = split.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("h", ".", -n) for n in sorted(shape["labels"])]))
    prefixes = F.filter(
        F.array(*[F.when(F.length("p") >= n, F.substring(F.col("p"), 1, n)) for n in sorted(shape["lengths"])]),
        lambda x: x.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: F.concat(s, q))))
    looked_up = (keys.withColumn("expression", F.explode(expressions))
                 .withColumn("digest", F.sha2("expression", 256))
                 .withColumn("short", F.substring("digest", 1, SHORT)))
    best = F.max_by(F.struct("rule", "verdict"), F.struct("rule_length", "rule", "verdict"))
    decided = (looked_up.join(listed, "short").where(F.col("digest") == F.col("rule_digest"))
               .groupBy("h", "p").agg(best.alias("best")))
    rule, verdict = free_name(pages, "rule"), free_name(pages, "verdict")
    return (split.join(decided, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left")
            .withColumns({rule: F.col("best.rule"),
                          verdict: F.coalesce(F.col("best.verdict"), F.lit(default))})
            .select(*pages.columns, host, path, rule, verdict))


def op10_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM named LEFT JOIN rules
  ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
"""
