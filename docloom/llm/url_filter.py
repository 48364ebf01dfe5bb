"""URL filters: longest-rule verdicts, and block decisions that pass to aliases by redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import checkpointed, small_or_shuffled
from docloom.llm.components import connected_components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host, all its subdomains, and the paths that begin with ``path``."""

    action: str
    host: str
    path: str


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name of a url in the alias graph: scheme and host lower-cased, no fragment; null if it has no ``://``."""
    front = F.regexp_extract(url, r"(?s)^((?:(?!://).)*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^#]*)", 1)
    return F.when(front != "", F.concat(F.translate(front, UPPER, UPPER.lower()), F.when(rest == "", "/").otherwise(rest)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in double, single or no quotes; empty if there is none."""
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(quoted, r"""^["']|["']$""", "")


def _resolved(links: DataFrame) -> DataFrame:
    """(url, target) with targets made absolute, seen from the page ``url``; those that lead nowhere are left out."""
    d = links.select(
        "url",
        F.trim(F.replace("target", F.lit("&amp;"), F.lit("&"))).alias("t"),
        F.regexp_extract("url", r"(?s)^((?:(?!://).)*):", 1).alias("scheme"),
        F.regexp_extract("url", r"(?s)^((?:(?!://).)*://[^/?#]*)", 1).alias("site"),
        F.regexp_replace(F.regexp_extract("url", r"(?s)^((?:(?!://).)*://[^/?#]*(?:/[^?#]*/|/)?)", 1), "/$", "").alias("folder"),
    )
    target = (
        F.when(F.col("t").rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), F.col("t"))
        .when(F.col("t").startswith("//"), F.concat("scheme", F.lit(":"), "t"))
        .when(F.col("t").startswith("/"), F.concat("site", "t"))
        .when(F.col("t").rlike(r"(?i)^(?:$|[a-z][a-z0-9+.\-]*:|#|\?)"), F.lit(None))
        .otherwise(F.concat("folder", F.lit("/"), "t"))
    )
    return d.select("url", target.alias("target")).where("target IS NOT NULL")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): nodes joined by a page's canonical link or by its refresh to another url."""
    html = F.coalesce("html", F.lit(""))
    # most pages have neither: a plain search decides before any pattern runs
    lower = F.lower(html)
    marked = pages.where(F.col("url").isNotNull()).where(lower.contains("canonical") | lower.contains("http-equiv")).select("url", html.alias("h"))
    tags = marked.select("url", F.explode_outer(F.regexp_extract_all("h", F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag")).where("tag IS NOT NULL")
    tags = tags.select("url", *[_attribute(F.col("tag"), a).alias(f"a{i}") for i, a in enumerate(("rel", "href", "http-equiv", "content"))])
    canonical = F.when(F.lower("a0").rlike(r"(^|\s)canonical(\s|$)"), F.col("a1"))
    refresh = F.when(F.lower("a2") == "refresh", F.regexp_extract("a3", r"""(?is)url\s*=\s*['"]?([^'"\s;]+)""", 1))
    links = tags.select("url", F.coalesce(canonical, refresh).alias("target")).where("target != ''")
    links = checkpointed(links)  # what follows looks at each url and target many times
    return _resolved(links).select(node_of(F.col("url")).alias("src"), node_of(F.col("target")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, other columns) with rule and action of the longest rule that fits, null where none does.

    A host is looked up by each of its suffixes that begin at a label, so rules meet urls in an equi-join. The longest
    rule is the one with most characters of host and path, then of host; equal rules block before they allow.
    """
    spots = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = spots.where("host != ''").select("host", "path", F.explode_outer(suffixes).alias("rule_host"))
    fits = tried.join(small_or_shuffled(rules), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("action") == "block").alias("c"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), order).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return urls.join(best, ["host", "path"], "left")


def url_verdicts(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and ``inherited`` for every row of ``pages`` (page_id, url, html).

    The longest rule that fits a url decides. A url without a rule is blocked if any url that it is joined to, by
    redirects (a table from_url, to_url) or by canonical links and refreshes in html, in any number of steps and either
    direction, is blocked by a rule; otherwise it is allowed. An explicit allow has precedence: it is never overruled,
    but it does not clear the other members of its group. Targets that are not pages themselves take part.

    Null urls and those without ``://`` have an empty host and path, no rule, and are allowed; null html has no links.
    Repeated rows get the same result each. Only nodes with a link enter the components; verdicts of all members of a
    component are combined by a grouping with map-side maxima.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r.host, r.path, r.action) for r in rules], "rule_host string, rule_path string, action string")
    judged = matched(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("src"), node_of(F.col("to_url")).alias("dst")))
    parts = checkpointed(connected_components(edges))
    members = parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    blocked = matched(members, rules).where("action = 'block'").select("component").distinct()
    tainted = checkpointed(parts.join(blocked, "component", "left_semi").select("node"))
    out = judged.withColumn("node", node_of(F.col("url"))).join(small_or_shuffled(tainted.withColumn("tainted", F.lit(True))), "node", "left")
    inherited = F.col("action").isNull() & F.coalesce("tainted", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(inherited, "block").otherwise(F.coalesce("action", F.lit("allow"))).alias("verdict"), inherited.alias("inherited"))


#: DuckDB SQL of the registered query. Canonical links and refreshes are followed by a recursive query.
ORACLE = r"""
WITH RECURSIVE lo AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                               ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT row_number() OVER () AS rid, page_id, url, html,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), u, l) AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut, lo),
tags AS (SELECT rid, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM parts WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (SELECT rid, url, CASE WHEN regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)
                             WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s;>]+)', 1) END AS t FROM tags),
edges AS (SELECT regexp_replace(url, '#.*$', '') AS a,
                 regexp_replace(CASE WHEN strpos(t, '://') > 0 THEN t ELSE regexp_extract(url, '^.*?://[^/?#]*') || t END, '#.*$', '') AS b
          FROM targets WHERE t <> ''),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
best AS (SELECT rid, max_by(h || p, len(h || p)) AS rule, max_by(action, len(h || p)) AS action
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
other AS (SELECT DISTINCT b AS url, regexp_extract(b, '://([^/?#]*)', 1) AS host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM reach),
bad AS (SELECT url FROM (SELECT url, max_by(action, len(h || p)) AS action FROM other
        JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url) WHERE action = 'block'),
tainted AS (SELECT DISTINCT a AS url FROM reach JOIN bad ON reach.b = bad.url)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN t.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       action IS NULL AND t.url IS NOT NULL AS inherited
FROM parts p LEFT JOIN best USING (rid) LEFT JOIN tainted t ON t.url = regexp_replace(p.url, '#.*$', '')
"""
