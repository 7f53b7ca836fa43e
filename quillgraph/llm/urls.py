"""URL filters that hold for all aliases of a page.

A URL's explicit verdict is that of the longest rule that fits it. Redirects and canonical links join
URLs; a block on any URL of such a component reaches all its aliases, but a URL that a rule explicitly
allows stays allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize
from quillgraph.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of op9.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """The longest fitting rule as a struct (name, verdict), or null; of equal lengths an allowing one, then
    the first by name. The rules are part of the expression: no shuffle, no join."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    found = None
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def absolute_url(base: Column, link: Column) -> Column:
    """link as seen from the page base: absolute, //host, /path or relative; without its fragment."""
    bare = F.regexp_replace(F.trim(link), r"#.*$", "")
    bare = F.replace(bare, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(bare == "", F.lit(None).cast("string"))
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), bare))
        .when(bare.startswith("/"), F.concat(origin, bare))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), bare))
    )


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


_RAW = ("script", "style", "template", "textarea", "noscript")
_HIDDEN = "(?is)<!--.*?-->|" + "|".join(rf"<{x}\b[^>]*>.*?</{x}\s*>" for x in _RAW)
_MOVED = r"(?:^|[^\w.$-])(?:(?:window|document|self|top)\.)?location(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']"


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url_a, url_b: canonical links and redirects (meta refresh, an assignment to location in a script) that the pages
    declare, without fragments. Tags within comments, scripts, styles, templates, text areas and noscript are none, nor is
    an attribute that is called location. Only pages with such a word go on from the scan. Null html or url
    declares nothing; repeated rows count once."""
    bare = F.regexp_replace(F.col(html), _HIDDEN, "")
    tags = F.regexp_extract_all(bare, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b")),
        lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")),
        lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    scripts = F.regexp_extract_all(F.regexp_replace(F.col(html), r"(?is)<!--.*?-->", ""), F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), F.lit(1))
    moved = F.flatten(F.transform(scripts, lambda x: F.regexp_extract_all(x, F.lit(_MOVED), F.lit(1))))
    links = F.concat(canonical, refresh, moved)
    named = pages.filter(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|http-equiv|location"))
    return (
        named.select(F.col(url).alias("page"), F.explode(F.array_distinct(links)).alias("link"))
        .select(without_fragment(F.col("page")).alias("url_a"), absolute_url(F.col("page"), F.col("link")).alias("url_b"))
        .filter("url_b is not null and url_a <> url_b and url_b like '%://%'")
        .distinct()
    )


def judge_urls(pages: DataFrame, edges: DataFrame, rules: Sequence[UrlRule] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages. edges (url_a, url_b) are redirects and
    canonical links, without fragments.

    A null url, or one without ://, has empty host and path, fits no rule and is allowed. Repeated rows are
    judged each. Aliases that are no page of the table count too: a rule that blocks them blocks the page.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("_url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("_rule", explicit_rule(F.col("host"), F.col("path"), rules))
    stored = materialize(edges.select("url_a", "url_b"), "links")
    groups = connected_components(stored, "url_a", "url_b")
    aliases = groups.withColumn("_verdict", explicit_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"])
    blocked = aliases.filter("_verdict = 'block'").select("component").distinct()
    # Rows as many as there are URLs with an alias; it joins by URL, shuffled unless Spark finds it small.
    reached = aliases.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return (
        judged.withColumn("_node", without_fragment(F.col("_url")))
        .join(reached, "_node", "left")
        .select("page_id", "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"))
    )


ORACLE_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
bare AS (SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<textarea\b[^>]*>.*?</textarea\s*>|<noscript\b[^>]*>.*?</noscript\s*>', '', 'g') AS html FROM u WHERE url IS NOT NULL),
scripts AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>(.*?)</script', 1)) AS x FROM u WHERE url IS NOT NULL),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM bare),
links AS (
  SELECT url, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS l FROM tags WHERE regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b')
  UNION ALL
  SELECT url, regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
  UNION ALL
  SELECT url, unnest(regexp_extract_all(x, '(?:^|[^\w.$-])(?:(?:window|document|self|top)\.)?location(?:\.href)?\s*=\s*["'']([^"'']+)["'']', 1)) FROM scripts),
e0 AS (SELECT regexp_replace(url, '#.*$', '') AS a, regexp_replace(l, '#.*$', '') AS b FROM links WHERE l LIKE '%://%'),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(node, seen) AS (SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a),
nodes AS (
  SELECT seen,
         translate(regexp_extract(seen, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(seen, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT seen FROM reach)),
nodeverdict AS (SELECT seen, arg_max(verdict, length(h || p)) AS verdict FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY seen),
blocked AS (SELECT DISTINCT node FROM reach JOIN nodeverdict ON reach.seen = nodeverdict.seen WHERE verdict = 'block'),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN blocked.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id LEFT JOIN blocked ON regexp_replace(u.url, '#.*$', '') = blocked.node
"""
