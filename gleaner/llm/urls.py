"""Block and allow rules for URLs by host and path, in DataFrame functions alone.

A URL is expanded into the suffixes of its host and those prefixes of its path that could be a rule; expressions meet rules
by an equi-join on the first bits of a digest, full digests confirm a match, and the longest rule decides. Rules are thus
never compared with each URL in turn, and either side may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join goes by.
PREFIX = 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?` or `#`."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _digested(rows: DataFrame, expression: str) -> DataFrame:
    """`rows` with the expression's digest and the prefix of it that the join goes by."""
    return rows.withColumn("digest", F.sha2(expression, 256)).withColumn("short", F.substring("digest", 1, PREFIX))


def expressions(rules: DataFrame) -> DataFrame:
    """Rules (action, rule) by their expression `host` + `path`; of two actions for one rule, block holds."""
    made = rules.where(F.col("rule").isNotNull() & F.col("action").isin("block", "allow") & (F.instr("rule", "/") > 0))
    host, path = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER), F.regexp_extract("rule", "(?s)/.*$", 0)
    made = made.select(F.concat(host, path).alias("rule"), F.length(path).alias("n"), "action")
    return _digested(made.groupBy("rule", "n").agg(F.max("action").alias("action")), "rule")  # "block" comes after "allow"


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of `pages`: id_col, host, path, rule (the longest that fits, else null), verdict (its action, else `otherwise`).

    A rule `host/path` fits that host and its subdomains if the URL's path starts with its path; rules without `/`, with
    another action or null are ignored. Ties in length can only be one rule (an expression of a URL of a given length and
    host is unique) or go to the longer host. Null URLs and those without `://` have an empty host and path and no rule.
    Repeated rows and null ids are each judged. Columns besides the two named are not read. Each distinct host and path is
    judged once. Sides of joins are broadcast only if Spark's size check finds them small; else hot hosts and URLs meet in
    joins that Spark can split.
    """
    known = written(expressions(rules), "rules")
    host, path = parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))

    distinct = rows.where((F.col("host") != "") & F.col("path").startswith("/")).select("host", "path").distinct()
    suffixed = distinct.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    # prefixes of the lengths that occur in rules: one row, whose numbers are no more than the longest rule has characters
    lengths = known.agg(F.collect_set("n").alias("lengths"))
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    each = suffixed.join(F.broadcast(lengths)).select("host", "path", "suffix", F.explode(fits).alias("n"))
    each = each.withColumn("expression", F.concat("suffix", F.col("path").substr(F.lit(1), F.col("n"))))
    each = _digested(each.select("host", "path", "suffix", "expression"), "expression").withColumnRenamed("digest", "found")
    met = each.join(known.select("short", "digest", "rule", "action"), "short").where(F.col("found") == F.col("digest"))
    order = F.struct(F.length("rule").alias("n"), F.length("suffix").alias("m"), "rule", "action")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best")).select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    # written, so that a hot URL's rows can be split in the join; its size follows that of the pages: a merge join at every size
    best = written(best, "best").hint("merge")
    out = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(otherwise)).alias("verdict"))


#: Rules of the registered query, as its contract gives them.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as a table of constants, without a Python worker."""
    each = [F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule")) for action, rule in rules]
    return spark.range(1).select(F.explode(F.array(*each)).alias("r")).select("r.action", "r.rule")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, a, regexp_extract(a, '^[^/?#]*') AS raw FROM u),
s AS (SELECT page_id, lower(raw) AS host, regexp_extract(substr(a, length(raw) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(action, rule_host, rule_path)),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
 FROM s JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.k = 1
"""
