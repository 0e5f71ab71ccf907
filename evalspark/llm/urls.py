"""URL filters with redirect equivalence, in DataFrame operations only.

Pages that redirect to each other, or name a canonical page, are aliases. Distributed connected
components over those links make them one class; a block decision for one alias holds for the
others, unless any of them is allowed by a rule of its own: explicit allow comes first. A url
that a rule fits is judged by that rule alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import components, lower_az
from evalspark.plans.durable import durable

# The verdict, the host and the path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], verdict: bool) -> Column:
    """The longest fitting rule, or its verdict; null if none fits. ``rules`` are part of the
    plan, so this is for short lists."""
    cases = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(v if verdict else h + p))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def node_of(url: Column) -> Column:
    """What names a page: host, path and query, whatever the scheme and fragment. Null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def link_targets(url: Column, html: Column) -> Column:
    """Where a page's canonical link and its refresh lead, each null if the page has none. Both
    count: a page that names itself canonical may still be sent elsewhere."""
    canonical = F.regexp_extract(F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")

    def whole(found: Column) -> Column:
        found = F.replace(found, F.lit("&amp;"), F.lit("&"))
        return (
            F.when(found == "", F.lit(None))
            .when(F.instr(found, "://") > 0, found)
            .when(found.startswith("//"), F.concat(F.lit("x:"), found))
            .when(found.startswith("/"), F.concat(F.lit("x://"), host_of(url), found))
            .otherwise(F.concat(F.lit("x://"), host_of(url), F.when(folder == "", F.lit("/")).otherwise(folder), found))
        )

    return F.when(html.rlike(r"(?i)canonical|http-equiv"), F.transform(F.array(canonical, refresh), whole))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) per input row.

    ``redirects`` (from_url, to_url) adds known redirects to the links that the pages hold.
    ``verdict`` is the rule's; without one it is ``block`` if an alias is blocked by a rule and
    none allowed by one, else ``allow``. A url that is null or has no ``://`` has an empty host
    and path, fits no rule, has no aliases and is allowed. Repeated rows and null ids keep their
    rows; links whose target has no host are ignored. No input: no rows.
    """
    url = F.col("_url")
    narrow = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    links = pages.select(node_of(F.col(url_col)).alias("a"), F.explode_outer(link_targets(F.col(url_col), F.col(html_col))).alias("_to")).select("a", node_of(F.col("_to")).alias("b"))
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    stars = components(links.where("b != '' and a is not null"), "a", "b")
    members = stars.union(stars.select("root", "root").distinct())
    whole = F.concat(F.lit("x://"), F.col("node"))
    own = members.withColumn("_own", rule_of(host_of(whole), path_of(whole), rules, True))
    decided = durable(
        own.groupBy("root").agg(F.max(F.col("_own") == "allow").alias("_allowed"), F.max(F.col("_own") == "block").alias("_blocked"))
        .where("_blocked and not coalesce(_allowed, false)").select("root")
    )
    blocked = durable(members.join(decided, "root").select("node"))
    judged = narrow.select("_id", node_of(url).alias("_node"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.select("*", rule_of(F.col("host"), F.col("path"), rules, False).alias("rule"), rule_of(F.col("host"), F.col("path"), rules, True).alias("_verdict"))
    aliased = judged.join(blocked.select(F.col("node").alias("_node"), F.lit(True).alias("_alias")), "_node", "left")
    return aliased.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_alias"), "block").otherwise("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '') AS rest
  FROM pages),
link AS (
  SELECT *, CASE WHEN url LIKE '%://%' THEN host || rest END AS a,
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS canonical,
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS refresh
  FROM p),
found AS (SELECT a, host, path, replace(unnest(list_filter([canonical, refresh], lambda x: x <> '')), '&amp;', '&') AS f FROM link),
target AS (
  SELECT a, CASE WHEN f LIKE '%://%' THEN f WHEN f LIKE '//%' THEN 'x:' || f WHEN f LIKE '/%' THEN 'x://' || host || f
    ELSE 'x://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || f END AS t
  FROM found WHERE f IS NOT NULL AND a IS NOT NULL),
edge AS (
  SELECT DISTINCT a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM target),
both_ways AS (SELECT a, b FROM edge WHERE b <> '' AND a <> b UNION SELECT b, a FROM edge WHERE b <> '' AND a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
rules(kind, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
node AS (
  SELECT DISTINCT n, regexp_extract(n, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(n, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT a AS n FROM both_ways)),
own AS (
  SELECT n, (SELECT kind FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS kind FROM node),
alias AS (
  SELECT reach.a AS n, bool_or(own.kind = 'block') AND NOT coalesce(bool_or(own.kind = 'allow'), false) AS blocked
  FROM reach JOIN own ON own.n = reach.b GROUP BY 1),
judged AS (
  SELECT page_id, host, path, CASE WHEN url LIKE '%://%' THEN host || rest END AS n,
    (SELECT {'rule': h || pre, 'kind': kind} FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS r
  FROM p)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.kind, CASE WHEN alias.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN alias USING (n)
"""
