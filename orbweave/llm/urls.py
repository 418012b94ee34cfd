"""Operator 8: URL rules, with block decisions carried along redirects and canonical links.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path starts with the rule's
path; the longest rule that fits decides (by host length plus path length; then the longer host; then allow).
Urls that name one document (a page and its canonical link or redirect target) are aliases. The connected
components of these links are found in a distributed way, and a url without a rule of its own
is blocked if any alias is blocked by a rule. Explicit allow takes precedence: a url with an allow rule stays
allowed whatever its aliases are. All else is allowed.

Links come from the page's html (``<link rel="canonical" href=...>``, ``<meta http-equiv="refresh" content="0; url=...">``)
and from an optional table of redirects. A link's node is its url up to ``#``, with scheme and host in lower case.
Relative targets are resolved against the page's host (``/path``, ``//host/path``) or folder.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is
allowed; repeated urls and rows are each judged; null html has no links; empty tables give empty results.
Everything is DataFrame functions; a component or host with a third of all pages only meets grouped minima
and flags (combined map-side) and joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components

Rule = tuple[str, str, str]
#: As many rules are held in the plan; more are joined.
RULES_IN_PLAN = 1000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url up to '#', scheme and host in lower case; null where there is no host."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    front = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(host_of(url) != "", F.concat(lower_ascii(front), F.substring(whole, F.length(front) + 1, F.length(whole))))


def html_links(html: Column, page_url: Column) -> Column:
    """array<string>: absolute targets of the page's canonical links and redirects."""
    def found(tag: str, attribute: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))

    canonical = found(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = found(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    scheme = F.regexp_extract(page_url, r"(?s)^(.*?):", 1)
    site = F.regexp_extract(page_url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(page_url), r"[^/]*$", "")
    absolute = lambda h: (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(site, h))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), h)))
    return F.transform(F.filter(F.concat(canonical, refresh), lambda h: h != ""), absolute)


def host_suffixes(host: Column) -> Column:
    """array<string>: the host and the domains above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _best(fitting: Column) -> Column:
    """Of array<struct<verdict, host, path>> the rule that decides, or null."""
    rank = F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), (r["verdict"] == "allow").alias("a"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict")))
    return F.array_max(rank)


def apply_rules(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Adds host, path and best (struct with host, path, verdict; null if no rule fits) to a table with column url.

    A list of up to RULES_IN_PLAN rules is matched within each row. Otherwise rules is a table (verdict, host, path) that is joined by domain.
    """
    out = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > RULES_IN_PLAN:
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    if not isinstance(rules, DataFrame):
        if not rules:
            return out.withColumn("best", F.expr("CAST(NULL AS struct<n: int, h: int, a: boolean, host: string, path: string, verdict: string>)"))
        listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
        fits = lambda r: ((F.col("host") == r["host"]) | F.endswith("host", F.concat(F.lit("."), r["host"]))) & F.startswith("path", r["path"])
        return out.withColumn("best", _best(F.filter(listed, fits)))
    keyed = out.select("url", "host", "path").distinct()
    hits = keyed.select("url", F.col("path").alias("p"), F.explode(host_suffixes(F.col("host"))).alias("domain")).join(rules.withColumnRenamed("host", "domain"), "domain").where(F.startswith("p", F.col("path")))
    hit = F.array(F.struct(F.col("verdict"), F.col("domain").alias("host"), F.col("path")))
    best = hits.select("url", _best(hit).alias("b")).groupBy("url").agg(F.max("b").alias("best"))
    return out.join(best, "url", "left").select(*out.columns, "best")


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """id, url, host, path, rule, rule_verdict, alias_blocked, verdict for each row of pages (id, url, html; others ignored).

    redirects: optional table (source, target) of absolute urls.
    """
    pages = pages.select(F.col(id_col).alias("id"), "url", "html")
    judged = apply_rules(pages.select("id", "url"), rules)
    links = pages.where(F.col("html").isNotNull() & (host_of(F.col("url")) != "")).select(F.col("url").alias("source"), F.explode(html_links(F.col("html"), F.col("url"))).alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    parts = connected_components(links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    ruled = apply_rules(parts.withColumnRenamed("node", "url"), rules)
    blocked = ruled.groupBy("component").agg(F.bool_or(F.coalesce(F.col("best.verdict") == "block", F.lit(False))).alias("any_blocked")).where("any_blocked")
    tainted = parts.join(blocked, "component").select(F.col("node"), F.lit(True).alias("alias_blocked"))
    out = judged.withColumn("node", node_of(F.col("url"))).join(tainted, "node", "left")
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("alias_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("id").alias(id_col), "url", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.col("best.verdict").alias("rule_verdict"),
        F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"), verdict.alias("verdict"))


#: Rules of the contract.
RULES: list[Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, url, html,
    lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
links AS (SELECT DISTINCT regexp_extract(url, '(?s)^([^#]*)', 1) AS a, regexp_extract(target, '(?s)^([^#]*)', 1) AS b
  FROM (SELECT url, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS target FROM u)
  WHERE url LIKE '%://%' AND target LIKE '%://%'),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
node_rule AS (SELECT n, arg_max(verdict, length(h) + length(p)) AS verdict FROM (SELECT DISTINCT b AS n,
    lower(coalesce(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM reach) x
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
tainted AS (SELECT DISTINCT a FROM reach JOIN node_rule ON b = n WHERE verdict = 'block'),
ruled AS (SELECT u.page_id, u.url, host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS own
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN regexp_extract(url, '(?s)^([^#]*)', 1) IN (SELECT a FROM tainted) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""
