"""URL filtering by host and path rules, in DataFrame operations only.

Every URL is expanded into host-suffix x path-prefix expressions. These meet the rules, listed by the short prefix of
their SHA-256 digests, in an equi-join on that prefix alone. The full digests of a list then confirm or refute the
match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares (32 bits, as in public URL blocklists).
PREFIX_DIGITS = 8
#: Up to so many rules, the rule table (a digest, a string, a verdict: under 300 bytes a row) is broadcast; beyond, the join shuffles.
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query (fixed values): verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a local relation with columns verdict, host, path."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first '://' to '/', '?', '#' or the end, A-Z lower-cased. Path: from there to '?', '#' or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw_host, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge each row of pages(page_id, url) by rules(verdict, host, path).

    Returns page_id, host, path, rule (host + path of the winning rule, or null) and verdict. A rule fits its host and
    all subdomains if the path starts with the rule's path. The longest rule wins; among equally long ones the more
    specific host, then 'block', so the result never depends on row order. Defined cases: a null URL or one without
    '://' has an empty host and path and gets the default; repeated rows are judged each on its own; other columns of
    pages are ignored, whatever their names; empty tables give empty results or only defaults.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter("r_host IS NOT NULL AND r_verdict IS NOT NULL")
    rules = rules.select(
        F.concat("r_host", "r_path").alias("r_rule"), F.length("r_path").alias("r_len"), "r_verdict", "r_host",
        F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256).alias("r_digest"),
    )
    known = rules.agg(F.count("*"), F.array_sort(F.collect_set("r_len"))).first()  # two numbers and the few distinct lengths of rule paths
    order = F.struct(F.length("r_rule").alias("length"), F.length("r_host").alias("host"), F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("block"), "r_rule", "r_verdict")
    rules = rules.groupBy("r_digest").agg(F.max(order).alias("r_best"))  # the rule that wins among those of one host and path
    lists = rules.groupBy(F.substring("r_digest", 1, PREFIX_DIGITS).alias("r_prefix")).agg(F.collect_list(F.struct("r_digest", "r_best")).alias("r_list"))
    if known[0] <= BROADCAST_RULES:
        lists = F.broadcast(lists)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(
        F.col("host") != "",
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array(F.lit("")))
    lengths = F.array(*[F.lit(x) for x in (known[1] or [])]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\x00", h, p), 256))))
    spread = rows.select("row", "page_id", "host", "path", F.explode_outer(expressions).alias("digest"))
    spread = spread.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    met = spread.join(lists, F.col("prefix") == F.col("r_prefix"), "left")
    confirmed = F.filter("r_list", lambda x: x["r_digest"] == F.col("digest"))  # at most one
    best = F.max(F.get(confirmed, F.lit(0))["r_best"]).alias("best")
    judged = met.groupBy("row", "page_id", "host", "path").agg(best)  # a row's expressions lie in one task, so they fold before the shuffle
    return judged.select("page_id", "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM p
), u AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h
), r(verdict, r_host, r_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), b AS (
  SELECT u.page_id, u.host, u.path, r.r_host || r.r_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.r_host || r.r_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.r_host OR ends_with(u.host, '.' || r.r_host)) AND starts_with(u.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1
"""
