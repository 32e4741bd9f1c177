"""Operator 3, URL filters by redirect equivalence.

Explicit rules judge a URL by its host and path. URLs that redirect to, or name as canonical,
the same page are aliases: connected components over these edges carry a block decision to
every alias that no rule fits. Allow takes precedence: a URL's own rule always holds, and a
component with an explicitly allowed URL blocks none of its unruled members.

Edges come from the pages themselves (link rel=canonical, meta refresh) and from an optional
redirect table (src_url, dst_url). A URL's node is its host, path and query; scheme and
fragment don't matter, and dot segments of the path are resolved. Every canonical link and
refresh of a page counts, outside comments; relative targets are resolved against the page's
host and folder (base elements are not read).

Rules are a short configuration list (they become one CASE expression).

Very long pages, and pages full of tags and comments that never end, take time in proportion.

Defined results: a null url, or one without "://", has empty host and path, fits no rule, has
no alias and is allowed. Null html has no edges. Repeated rows are judged alike. Among rules
that fit, the longest wins, then the longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.text import let
from siteloom.llm.common import cut, table
from siteloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Patterns of a whole tag for RE2, and of a tag that begins a text for Java.
COMMENT = r"(?s)<!--.*?-->"
_CANONICAL = r"<link\b[^>]*\srel\s*=\s*(?:\"[^\"]*\bcanonical\b[^\"]*\"|'[^']*\bcanonical\b[^']*'|canonical\b)"
_REFRESH = r"<meta\b[^>]*\shttp-equiv\s*=\s*[\"']?refresh\b"
CANONICAL, REFRESH = rf"(?is){_CANONICAL}[^>]*>", rf"(?is){_REFRESH}[^>]*>"
HREF = r"(?is)[\s\"']href\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
AMPERSAND = r"(?i)&(amp|#38|#x26);"
AUTHORITY = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)" + AUTHORITY, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)" + PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that wins and its action; null where none fits."""
    found = action = None
    for act, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if found is None else (found, action)


def without_dots(path: Column) -> Column:
    """The path without its segments "." and ".."; what ".." would lead above the root is left out."""

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    done = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.contains("/."), F.concat(done, F.when(F.element_at(parts, -1).isin(".", "..") & ~done.endswith("/"), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """Host, path and query behind "://"; null without "://"."""
    path = without_dots(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query))


def resolve(href: Column, url: Column) -> Column:
    """An absolute URL for a link of the page at url; dot segments are left to node_of()."""
    href = F.regexp_replace(href, AMPERSAND, "&")
    base = F.concat(F.lit("://"), host_of(url))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.regexp_replace(F.concat(F.lit("/"), path_of(url)), r"(?s)^/?(.*/)?[^/]*$", "$1"), href))
    )


def tags(html: Column) -> Column:
    """Link and meta tags outside comments, each from its start to its end. The text is cut at
    ends of comments and at starts of tags, once each, so that no page takes more than time in
    proportion, however many of either it opens and never closes."""
    keep = lambda x, i, n: F.when(i == n - 1, x).when(x.contains("<!--"), F.substring_index(x, "<!--", 1)).otherwise(F.concat(x, F.lit("-->")))
    bare = lambda parts: let(F.size(parts), lambda n: F.array_join(F.transform(parts, lambda x, i: keep(x, i, n)), ""))
    begun = F.split(let(F.split(html, "-->"), bare), r"(?i)(?=<(?:link|meta)\b)")
    whole = F.filter(begun, lambda x: x.contains(">") & x.rlike(r"(?i)^<(?:link|meta)\b"))
    return F.transform(whole, lambda x: F.concat(F.substring_index(x, ">", 1), F.lit(">")))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) nodes of canonical links, refreshes and redirects."""
    url = F.col("url")
    found = lambda tag, target: F.transform(F.filter(tags(F.col("html")), lambda t: t.rlike("(?is)^" + tag)), lambda t: F.regexp_extract(t, target, 1))
    targets = F.concat(found(_CANONICAL, HREF), found(_REFRESH, TARGET))
    # Few pages have such tags, so most are spared the patterns.
    held = pages.where(url.contains("://") & F.lower("html").rlike("canonical|refresh"))
    named = held.select("url", F.explode(F.filter(targets, lambda t: t != "")).alias("href"))
    edges = named.select(node_of(url).alias("src"), node_of(resolve(F.col("href"), url)).alias("dst"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src_url")), node_of(F.col("dst_url"))))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule and verdict; its html is not kept."""
    edges = cut(alias_edges(pages, redirects).distinct())
    kept = [c for c in pages.columns if c not in ("html", "host", "path", "rule", "verdict")]
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "action": action})
    if edges.isEmpty():
        return judged.select(*kept, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    nodes = connected_components(edges)
    ruled = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    blocked = (
        nodes.select("component", ruled.alias("own"))
        .groupBy("component")
        .agg(F.max(F.col("own") == "block").alias("blocks"), F.max(F.col("own") == "allow").alias("allows"))
        .where("blocks AND NOT coalesce(allows, false)")
    )
    aliases = nodes.join(blocked, "component", "left_semi").select("node", F.lit("block").alias("spread"))
    joined = judged.withColumn("node", node_of(F.col("url"))).join(aliases, "node", "left")
    return joined.select(*kept, "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_case(value: str, host: str, path: str) -> str:
    whens = []
    for act, rule in sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0])):
        domain, _, rest = rule.partition("/")
        whens.append(f"WHEN ({host} = '{domain}' OR ends_with({host}, '.{domain}')) AND starts_with({path}, '/{rest}') THEN '{act if value == 'action' else rule}'")
    return "CASE " + " ".join(whens) + " END"


_HOST = "coalesce(translate(regexp_extract({u}, '(?s)" + AUTHORITY + f"', 1), '{UPPER}', '{LOWER}'), '')"
_PATH = "coalesce(regexp_extract({u}, '(?s)" + PATH + "', 1), '')"


_DOTS = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/'), lambda s: [s])), lambda k, s: CASE WHEN s[1] = '..' THEN k[1:greatest(len(k) - 1, 1)] WHEN s[1] = '.' THEN k ELSE list_concat(k, s) END)"


def _node(u: str) -> str:
    host, path = _HOST.format(u=u), _PATH.format(u=u)
    done = f"array_to_string({_DOTS.format(p=path)}, '/')"
    path = f"CASE WHEN contains({path}, '/.') THEN {done} || CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') AND NOT ends_with({done}, '/') THEN '/' ELSE '' END ELSE {path} END"
    return f"CASE WHEN contains({u}, '://') THEN '://' || {host} || CASE WHEN ({path}) = '' THEN '/' ELSE {path} END || regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"


def _tag(tag: str, attribute: str) -> str:
    q = lambda p: p.replace("'", "''")
    return f"SELECT url, regexp_replace(regexp_extract(unnest(regexp_extract_all(regexp_replace(html, '{COMMENT}', '', 'g'), '{q(tag)}')), '{q(attribute)}', 1), '{AMPERSAND}', '&', 'g') AS href FROM pages WHERE contains(url, '://')"


ORACLE = f"""
WITH RECURSIVE found AS (
  {_tag(CANONICAL, HREF)} UNION ALL {_tag(REFRESH, TARGET)}
), absolute AS (
  SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN ':' || href
    WHEN starts_with(href, '/') THEN '://' || {_HOST.format(u="url")} || href
    ELSE '://' || {_HOST.format(u="url")} || regexp_replace('/' || {_PATH.format(u="url")}, '(?s)^/?(.*/)?[^/]*$', '\\1') || href END AS target
  FROM found WHERE href <> ''
), edges AS (
  SELECT {_node("url")} AS a, {_node("target")} AS b FROM absolute
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM both_ways
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), spread AS (
  SELECT node FROM (SELECT node, {_sql_case("action", _HOST.format(u="other"), _PATH.format(u="other"))} AS own FROM reach)
  GROUP BY node HAVING count(*) FILTER (own = 'block') > 0 AND count(*) FILTER (own = 'allow') = 0
), judged AS (
  SELECT page_id, url, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM pages
)
SELECT page_id, host, path, {_sql_case("rule", "host", "path")} AS rule,
  coalesce({_sql_case("action", "host", "path")}, CASE WHEN s.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN spread s ON s.node = {_node("url")}
"""
