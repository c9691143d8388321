"""URL filters by host-suffix and path-prefix expressions.

A rule is a host and a path that ends with ``/``; it fits its host and all subdomains where
the url's path starts with the rule's. Each distinct (host, path) of the urls is expanded
into its host suffixes times its path prefixes, no deeper than the deepest rule; expressions
join the rules on the first 8 hex digits of their SHA-256, full digests confirm, and the
longest rule wins. Where none fits, the method's default is to allow.

Rules are a table of any size; Spark sends it to all tasks only where its measured size is
under the session's threshold. A repeated url is judged once.

Urls without a path fit no rule and are set aside before the join: those without host too would
all have one key.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no
rule; an empty path fits no rule either, as it doesn't start with ``/``; very long urls are
expanded no further than the deepest rule; of rules with the same host and path the verdict that
is last by spelling counts (block before allow); rows that share a page_id stay apart, and equal
rows are equal rows of the result; empty tables give empty results; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return tuple(F.when(there, x).otherwise("") for x in (F.translate(host, ALPHABET, ALPHABET.lower()), path))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(spark, rules=RULES) -> DataFrame:
    if any(not p.startswith("/") or not p.endswith("/") for _, p, _ in rules):
        raise ValueError("a rule's path begins and ends with /")
    return digested(spark.createDataFrame(rules, "host string, path string, verdict string"))


def digested(rules: DataFrame) -> DataFrame:
    """host, path, verdict with the rule's text, digest, short key and depths."""
    rule = rules.select(F.concat("host", "path").alias("rule"), "verdict", (F.size(F.split("host", "[.]"))).alias("labels"), (F.size(F.split("path", "/")) - 1).alias("slashes"))
    return rule.withColumn("digest", _digest(F.col("rule"))).withColumn("short", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All host suffixes of up to ``labels`` labels times all path prefixes that end at one of the first ``slashes`` slashes."""
    hosts, paths = F.split(host, "[.]"), F.split(path, "/")
    n = F.size(hosts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - (labels - 1)), n), lambda i: F.array_join(F.slice(hosts, i, n), "."))
    deep = F.least(F.size(paths) - 1, F.lit(slashes))
    prefixes = F.when(deep < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(paths, 1, i), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels, slashes = rules.agg(F.max("labels"), F.max("slashes")).first()
    none = parts.where("path = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = parts.where("path <> ''")
    urls = parts.select("host", "path").distinct()
    terms = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels or 1, slashes or 1)).alias("expression"))
    terms = terms.withColumn("digest", _digest(F.col("expression"))).select("host", "path", "digest", F.substring("digest", 1, 8).alias("short"))
    r = rules.select("short", F.col("digest").alias("full"), "rule", "verdict")
    fits = terms.join(r, "short").where("digest = full")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("best"))
    ruled = parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return ruled.union(none)


def op6(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


ORACLE_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (
  SELECT page_id, host, path,
    (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules WHERE h || p = rule), 'allow') AS verdict FROM ruled
"""
