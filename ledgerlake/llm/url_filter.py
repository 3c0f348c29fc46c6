"""URL rules by hash-prefix look-up.

Each distinct (host, path) is expanded into expressions: the host suffixes with as many labels as some rule
with the prefixes of the path whose length some rule has. The work is linear in the length of a url. Expressions meet the rules in an equi-join on the first four
bytes of their SHA-256, then the full digests are compared; of the rules that fit, the longest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import LOWER, UPPER, table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"


def url_parts(url):
    """(host, path): the host after the first :// with A-Z lower-cased, the path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*", 0), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), rest.substr(F.char_length(host) + 1, F.char_length(rest))


def _digest(host, path):
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def _labels(host):
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row. rules: verdict, host, path.

    A null url or one without :// has empty host and path and gets the default. Of equally long rules the
    one with the longer host wins, then block over allow. Repeated rows are judged each. Other columns
    are not read; no rules or no pages give defaults or an empty result."""
    lengths = sorted(r[0] for r in rules.select(F.char_length("path").alias("n")).distinct().collect())  # at most the longest path
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    labels = [r[0] for r in rules.select(_labels(F.col("host")).alias("n")).distinct().collect()]  # at most those of the longest host
    suffix = F.array_compact(F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sorted(labels)]))
    ends = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))
    expr = (urls.filter("host <> ''").select("host", "path").distinct()
            .select("host", "path", F.explode(suffix.cast("array<string>")).alias("h"), ends.alias("ends"))
            .select("host", "path", "h", F.explode("ends").alias("n"))
            .select("host", "path", _digest(F.col("h"), F.expr("substring(path, 1, n)")).alias("digest"))
            .withColumn("prefix", F.substring("digest", 1, 4)))
    digest = _digest(F.col("host"), F.col("path"))
    known = rules.select(digest.alias("rule_digest"), F.substring(digest, 1, 4).alias("prefix"),
                         F.struct((F.char_length("host") + F.char_length("path")).alias("long"),
                                  F.char_length("host").alias("host_long"), (F.col("verdict") == "block").alias("block"),
                                  F.concat("host", "path").alias("rule"), "verdict").alias("best")).distinct()
    found = (expr.join(known, "prefix").filter("digest = rule_digest")
             .groupBy("host", "path").agg(F.max("best").alias("best")))
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


SQL = """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*')
  ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM u),
r(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
d AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT d.host, d.path, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS verdict FROM d JOIN r
  ON (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, q) GROUP BY d.host, d.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (host, path)"""


def rules_frame(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def op2_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))
