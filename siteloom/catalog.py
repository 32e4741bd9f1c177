"""Queries over the stored tables, and the DuckDB SQL with the same results.

pages are audited as a crawl: each host is one scan, in page_id order, with what stored pages
hold. events stand in for a history of scans (user_id: site, event_id: run, value: score) and
for requests to a limiter; documents for long page texts; line items for the links of a site
(supplier to supplier within an order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import composed
from siteloom.functions import labels, text, urls
from siteloom.functions.wordlists import STATE_WORDS, STOP_WORDS
from siteloom.operators import compare, crosspage, history, issues, links, reports, rules, scoring, similar, sitechecks, technology
from siteloom.plans import audit, frontier, phases
from siteloom.plans.lineage import spread
from siteloom.sources import pages as P
from siteloom.sources import keyset, sinks, site
from siteloom.sources.store import Store
from siteloom.streaming import limiter

c = F.col
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared pieces of SQL ---------------------------------------------------------------------

HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) END"
SEARCH = r"regexp_extract(url, '^[^?#]*(\?[^#]+)', 1)"
SCHEME = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"
PAGES = f"""p AS (
  SELECT {HOST} AS scan_id, page_id AS seq, url, html, {SCHEME} AS scheme, {PATH} AS path, {SEARCH} AS search,
    nullif(trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')), '') AS title
  FROM pages
)"""
_RULES_SQL = [
    ("title_too_short", "P1", "SEO", 3, 1, "title IS NOT NULL AND length(title) < 10"),
    ("missing_meta_description", "P1", "SEO", 4, 1, "NOT regexp_matches(html, '(?i)<meta[^>]+name=[\"'']description[\"'']')"),
    ("missing_canonical", "P2", "SEO", 3, 1, "NOT regexp_matches(html, '(?i)<link[^>]+rel=[\"'']canonical[\"'']')"),
    ("missing_viewport", "P1", "SEO", 5, 1, "NOT regexp_matches(html, '(?i)<meta[^>]+name=[\"'']viewport[\"'']')"),
    ("url_uppercase", "P3", "SEO", 1, 2, "len(list_filter(string_split(path || search, '/'), lambda s: NOT regexp_matches(s, '^[a-z]{2,3}[-_][A-Z]{2,4}$') AND regexp_matches(s, '[A-Z]'))) > 0"),
    ("url_too_long", "P3", "SEO", 1, 2, "length(path || search) > 115"),
    ("url_underscores", "P3", "SEO", 1, 2, "contains(path || search, '_')"),
    ("pagination_missing_rel_links", "P2", "SEO", 3, 1, "html <> '' AND regexp_matches(url, '(?i)" + urls.PAGINATION + "') AND NOT regexp_matches(html, '(?i)<link[^>]*\\brel\\s*=\\s*[\"''](prev|next)[\"'']')"),
    ("missing_structured_data", "P3", "SEO", 3, 2, "html <> '' AND path = '/' AND NOT contains(html, 'application/ld+json')"),
    ("low_text_ratio", "P3", "CONTENT", 2, 3, "length(html) >= 500 AND words * 5 / length(html) < 0.05 AND words > 20"),
    ("very_thin_content", "P1", "CONTENT", 5, 3, "words < 50"),
    ("thin_content", "P2", "CONTENT", 5, 3, "words >= 50 AND words < 300 AND path <> '/'"),
    ("missing_privacy_policy", "P3", "SEO", 3, 2, "NOT regexp_matches(html, '(?i)<a\\s[^>]*href=\"[^\"]*privacy') AND NOT regexp_matches(path, '(?i)/privacy(-policy)?$')"),
    ("no_structured_data", "P2", "SEO", 3, 2, "html <> '' AND NOT contains(html, 'application/ld+json')"),
    ("no_preload_hints", "P3", "PERFORMANCE", 2, 1, "html <> '' AND NOT regexp_matches(html, '(?i)<link[^>]+rel=[\"''](preload|preconnect)[\"'']')"),
]
PLAIN = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&#\d+;|&\w+;', ' ', 'g'), '\s+', ' ', 'g'))"""
ISSUES = PAGES + ", q AS (SELECT *, len(list_filter(regexp_split_to_array(" + PLAIN + r", '\s+'), lambda w: w <> '')) AS words FROM p), raw AS (" + " UNION ALL ".join(
    f"SELECT scan_id, seq, {k} AS pos, '{code}' AS code, '{sev}' AS severity, '{cat}' AS category, {imp} AS impact, {eff} AS effort, url FROM q WHERE {test}" for k, (code, sev, cat, imp, eff, test) in enumerate(_RULES_SQL)
) + """), firsts AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY scan_id, code, url ORDER BY seq, pos) = 1
), issues AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq, pos, code, url) AS n FROM firsts
)"""  # fmt: skip
PENALTY = "CASE severity WHEN 'P0' THEN 20 WHEN 'P1' THEN 8 WHEN 'P2' THEN 3 WHEN 'P3' THEN 1 ELSE 3 END + CASE WHEN k <= 1 THEN 0 WHEN k = 2 THEN 1 WHEN k <= 4 THEN 2 ELSE 3 END"
SCORES = ISSUES + f""", codes AS (
  SELECT scan_id, category, code, arg_min(severity, n) AS severity, count(*) AS k FROM issues GROUP BY ALL
), scores AS (
  SELECT scan_id, category, sum({PENALTY})::BIGINT AS raw, greatest(0, 100 - floor(100 * (1 - exp(-sum({PENALTY}) / 80.0)) + 0.5))::INT AS score FROM codes GROUP BY ALL
)"""
RANK = "CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 ELSE 4 END"
RUNS = "runs AS (SELECT user_id AS site, event_id AS run_id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, (floor(value * 100)::BIGINT % 101)::INT AS score, event_id % 3 AS p0 FROM events)"


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the few parsed columns that patterns over the markup can give."""
    raw = P.read_pages(spark, sf_dir)
    title = F.trim(F.replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&")))
    made = {"title": F.nullif(title, F.lit("")), "word_count": F.size(text.words(text.plain(c("html"))))}
    for name, tag in (("meta_description", "name=[\"']description[\"']"), ("viewport", "name=[\"']viewport[\"']")):
        made[name] = F.nullif(F.regexp_extract("html", rf"(?i)<meta[^>]+{tag}[^>]*>", 0), F.lit(""))
    made["canonical"] = F.nullif(F.regexp_extract("html", r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]*>", 0), F.lit(""))
    return raw.withColumns(made)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated issues, with their places, of the rules that patterns decide."""
    by_code = {r.code: r for r in rules.SEO + rules.LINK_TEXT + rules.CONTENT}
    anchors = lambda: c("html").rlike("(?i)<a\\s[^>]*href=\"[^\"]*privacy")
    own = {
        "missing_privacy_policy": rules.Rule("missing_privacy_policy", "P3", "SEO", 3, 2, lambda: ~anchors() & ~urls.path(c("url")).rlike(r"(?i)/privacy(-policy)?$")),
        "no_structured_data": rules.Rule("no_structured_data", "P2", "SEO", 3, 2, lambda: rules.has_text() & ~rules.html().contains("application/ld+json")),
        "no_preload_hints": rules.Rule("no_preload_hints", "P3", "PERFORMANCE", 2, 1, lambda: rules.has_text() & ~rules.html().rlike("(?i)<link[^>]+rel=[\"'](preload|preconnect)[\"']")),
    }
    chosen = [own.get(code) or by_code[code] for code, *_ in _RULES_SQL]
    found = rules.evaluate(_light(spark, sf_dir), chosen).withColumn("phase", F.lit(1)).withColumn("seq", c("seq").cast("long"))
    return issues.placed(issues.dedupe(found.select(*issues.COLUMNS)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(c("event_type") == "error", "FAILED").otherwise("SUCCEEDED")
    score = (F.floor(c("value") * 100).cast("long") % 101).cast("int")
    return table(spark, sf_dir, "events").select(c("user_id").alias("site"), c("event_id").alias("run_id"), c("ts").alias("created_at"), status.alias("status"), score.alias("score"), (c("event_id") % 3).alias("p0"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_pages(P.read_pages(spark, sf_dir))


# -- pages and addresses ----------------------------------------------------------------------


@query(f"WITH {PAGES} SELECT seq, url, title FROM p")
def page_titles(spark, sf_dir):
    return _light(spark, sf_dir).select("seq", "url", "title")


@query(f"WITH {PAGES} SELECT seq, CASE WHEN title IS NULL THEN 'missing_title' WHEN length(title) < 10 THEN 'title_too_short' WHEN length(title) > 60 THEN 'title_too_long' END AS code FROM p WHERE title IS NULL OR length(title) < 10 OR length(title) > 60")
def title_length_issues(spark, sf_dir):
    wanted = [r for r in rules.SEO if r.code in ("missing_title", "title_too_short", "title_too_long")]
    return rules.evaluate(_light(spark, sf_dir), wanted).select("seq", "code")


@query(f"WITH {PAGES} SELECT seq, scheme, scan_id AS host, path, search FROM p")
def url_parts(spark, sf_dir):
    u = c("url")
    return P.read_pages(spark, sf_dir).select("seq", urls.scheme(u).alias("scheme"), urls.hostname(u).alias("host"), urls.path(u).alias("path"), urls.search(u).alias("search"))


_TAIL = "CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/$', '') END"


@query(f"""WITH {PAGES}, s AS (SELECT *, list_filter(string_split(substr(search, 2), '&'), lambda x: x <> '') AS pairs FROM p)
SELECT seq, 'https://' || regexp_replace(scan_id, '^www\\.', '') || {_TAIL} || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(pairs), '&') ELSE '' END AS normalized FROM s""")
def url_normalize(spark, sf_dir):
    return P.read_pages(spark, sf_dir).select("seq", urls.normalize(c("url")).alias("normalized"))


_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)


@query(f"""WITH {PAGES}, s AS (SELECT *, list_filter(string_split(substr(search, 2), '&'), lambda x: x <> '' AND NOT list_contains([{_TRACK}], split_part(x, '=', 1))) AS pairs FROM p)
SELECT seq, scheme || '://' || scan_id || path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS stripped FROM s""")
def tracking_param_strip(spark, sf_dir):
    return P.read_pages(spark, sf_dir).select("seq", urls.strip_tracking(c("url")).alias("stripped"))


@query(f"""WITH {PAGES} SELECT seq, lower(regexp_replace(scheme || '://' || scan_id || path, '/+$', '')) AS for_compare, scheme || '://' || scan_id || {_TAIL} || search AS for_graph,
lower(regexp_replace(scheme || '://' || regexp_replace(scan_id, '^www\\.', '') || path, '/+$', '')) AS for_hreflang, scheme || '://' || scan_id || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS for_map FROM p""")
def url_normalizers(spark, sf_dir):
    u = c("url")
    return P.read_pages(spark, sf_dir).select("seq", urls.for_compare(u).alias("for_compare"), urls.for_graph(u).alias("for_graph"), urls.for_hreflang(u).alias("for_hreflang"), urls.for_map(u).alias("for_map"))


@query(f"""WITH {PAGES} SELECT seq, len(list_filter([{', '.join(f"'{a}'" for a in urls.AUTH_PARTS)}], lambda a: contains(lower(path), a))) > 0 AS auth,
regexp_matches(url, '(?i){urls.ARTICLE}') AND NOT regexp_matches(path, '(?i){urls.HUB}') AND NOT regexp_matches(url, '(?i){urls.LISTING}') AS article,
regexp_matches(url, '(?i){'|'.join(urls.EXCLUDED)}') AS excluded, path = '/' AS home FROM p""")
def page_flags(spark, sf_dir):
    u = c("url")
    return P.read_pages(spark, sf_dir).select("seq", urls.is_auth_page(u).alias("auth"), urls.is_article(u).alias("article"), urls.is_excluded(u).alias("excluded"), urls.is_homepage(u).alias("home"))


_HOSTS = "hosts AS (SELECT l_orderkey % 256 AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c, l_linenumber AS d, l_orderkey AS o FROM lineitem)"


@query(f"""WITH {_HOSTS}, u AS (SELECT DISTINCT a, b, c, d FROM hosts) SELECT a || '.' || b || '.' || c || '.' || d AS ip,
NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS safe FROM u""")
def safe_addresses(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 256).alias("a"), (c("l_partkey") % 256).alias("b"), (c("l_suppkey") % 256).alias("c"), c("l_linenumber").alias("d")).distinct()
    ip = F.concat_ws(".", *(c(x).cast("string") for x in "abcd"))
    return parts.select(ip.alias("ip"), urls.is_safe(F.concat(F.lit("http://"), ip, F.lit("/"))).alias("safe"))


@query(f"""WITH {PAGES}, a AS (SELECT seq, scan_id, scheme, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"#][^"]*)"', 1)) AS href FROM p)
SELECT seq, count(DISTINCT href) AS links, count(DISTINCT href) FILTER (NOT contains(href, '://')) AS internal FROM a GROUP BY seq""")
def internal_external_links(spark, sf_dir):
    found = P.read_pages(spark, sf_dir).select("seq", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"#][^"]*)"'), F.lit(1))).alias("href"))
    inside = ~c("href").contains("://") | urls.is_internal(c("href"), urls.hostname(c("url")))
    return found.groupBy("seq").agg(F.count_distinct("href").alias("links"), F.count_distinct(F.when(inside, c("href"))).alias("internal"))


@query("SELECT page_id AS seq, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{rx}') THEN '{n}' END" for n, rx in rules.FRAMEWORKS.items()) + "], lambda x: x IS NOT NULL)::VARCHAR AS frameworks FROM pages")
def js_framework_detect(spark, sf_dir):
    return P.read_pages(spark, sf_dir).select("seq", F.concat(F.lit("["), F.array_join(rules.frameworks(), ", "), F.lit("]")).alias("frameworks"))


def _tech_sql() -> str:
    parts = []
    for name, _, _, markup, generator, scripts in technology.TECHNOLOGIES:
        tests = [f"regexp_matches(html, '{rx.replace(chr(39), chr(39) * 2)}')" for rx in (markup, scripts) if rx]
        if generator:
            tests.append(f"regexp_matches(regexp_extract(html, '{technology.GENERATOR.replace(chr(39), chr(39) * 2)}', 1), '{generator}')")
        if tests:
            parts.append(f"SELECT page_id AS seq, '{name}' AS name FROM pages WHERE {' OR '.join(tests)}")
    return " UNION ALL ".join(parts)


@query(_tech_sql())
def tech_detect(spark, sf_dir):
    found = P.read_pages(spark, sf_dir).select("seq", F.explode(technology.detections(c("html"))).alias("d"))
    return found.select("seq", c("d.name").alias("name"))


@query(f"WITH {PAGES}, k AS (SELECT *, lower(title) AS key FROM p WHERE title IS NOT NULL) SELECT scan_id, key, count(*) AS pages, min(seq) AS seq, arg_min(url, seq) AS url FROM k GROUP BY ALL HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    return crosspage.duplicate_groups(P.complete(_light(spark, sf_dir)), "title")


# -- issues and scores ------------------------------------------------------------------------


@query(f"WITH {ISSUES} SELECT scan_id, seq, pos, code, severity, category, impact, effort, url FROM issues")
def issue_dedupe(spark, sf_dir):
    return _issues(spark, sf_dir).select("scan_id", "seq", "pos", "code", "severity", "category", "impact", "effort", "url")


@query(f"WITH {SCORES} SELECT scan_id, category, raw, score FROM scores")
def category_scores(spark, sf_dir):
    return scoring.category_scores(_issues(spark, sf_dir)).select("scan_id", "category", c("raw").cast("long").alias("raw"), c("score").cast("int").alias("score"))


_WIDE = ", ".join(f"coalesce(max(score) FILTER (category = '{k}'), 100)::INT AS {k.lower()}" for k in scoring.WEIGHTS)


@query(f"WITH {SCORES}, w AS (SELECT scan_id, {_WIDE} FROM scores GROUP BY scan_id) SELECT *, floor({' + '.join(f'{k.lower()} * {v}::DOUBLE' for k, v in scoring.WEIGHTS.items())} + 0.5)::INT AS overall FROM w")
def overall_score(spark, sf_dir):
    return scoring.overall(scoring.category_scores(_issues(spark, sf_dir)))


@query(f"WITH {ISSUES} SELECT scan_id, {', '.join(f'count(*) FILTER (severity = {chr(39)}{s}{chr(39)}) AS {s.lower()}' for s in scoring.PENALTY)} FROM issues GROUP BY scan_id")
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(_issues(spark, sf_dir))


@query(f"WITH {ISSUES}, g AS (SELECT scan_id, code, arg_min(severity, n) AS severity, arg_min(category, n) AS category, count(*) AS count, min(n) AS first FROM issues GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, count DESC, first) AS rank FROM g) SELECT scan_id, code, severity, category, count, rank FROM r WHERE rank <= 10")
def top_issues(spark, sf_dir):
    return scoring.top_issues(_issues(spark, sf_dir)).select("scan_id", "code", "severity", "category", "count", c("rank").cast("long").alias("rank"))


@query(f"WITH {ISSUES}, r AS (SELECT *, (CASE severity WHEN 'P0' THEN 100 WHEN 'P1' THEN 40 WHEN 'P2' THEN 15 ELSE 5 END * impact)::DOUBLE / effort AS ratio FROM issues) SELECT scan_id, ratio, code, url FROM r QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ratio DESC, n) = 1")
def fix_this_first(spark, sf_dir):
    return reports.fix_first(_issues(spark, sf_dir)).select("scan_id", "ratio", "code", "url")


@query(f"WITH {ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY impact DESC, effort, n) AS rank FROM issues WHERE effort <= 2 AND severity IN ('P0', 'P1', 'P2')) SELECT scan_id, rank, code, url FROM r WHERE rank <= 5")
def quick_wins(spark, sf_dir):
    return reports.quick_wins(_issues(spark, sf_dir)).select("scan_id", c("rank").cast("long").alias("rank"), "code", "url")


@query(f"WITH {ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, impact DESC, n) AS rank FROM issues) SELECT scan_id, rank, code, url FROM r WHERE rank <= 5")
def worst_issues(spark, sf_dir):
    return reports.worst(_issues(spark, sf_dir)).select("scan_id", c("rank").cast("long").alias("rank"), "code", "url")


@query(f"WITH {ISSUES}, b AS (SELECT scan_id, category, count(*) AS count, min(n) AS first FROM issues WHERE severity IN ('P0', 'P1') GROUP BY ALL) SELECT scan_id, category, count FROM b QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY count DESC, first) = 1")
def worst_category(spark, sf_dir):
    return reports.worst_category(_issues(spark, sf_dir))


@query(f"WITH {ISSUES} SELECT scan_id, coalesce(nullif(url, ''), 'General') AS page, count(*) AS issues, count(*) FILTER (severity IN ('P0', 'P1')) AS critical FROM issues GROUP BY ALL")
def group_by_page(spark, sf_dir):
    return reports.by_page(_issues(spark, sf_dir))


@query(f"WITH {ISSUES} SELECT scan_id, severity, count(*) AS issues FROM issues GROUP BY ALL")
def print_groups(spark, sf_dir):
    return reports.by_severity(_issues(spark, sf_dir))


_AI_SQL = " - ".join(["100", *(f"max(CASE WHEN code = '{k}' THEN {v} ELSE 0 END)" for k, v in reports.AI_PENALTY.items())])
_CHECK_SQL = ", ".join(f"bool_and(code NOT IN ({', '.join(repr(x) for x in codes)})) AS {name}" for name, codes in reports.CHECKLIST.items())


@query(f"WITH {ISSUES} SELECT scan_id, greatest(0, {_AI_SQL})::INT AS score, {_CHECK_SQL} FROM issues GROUP BY scan_id")
def ai_visibility(spark, sf_dir):
    return reports.ai_visibility(_issues(spark, sf_dir)).withColumn("score", c("score").cast("int"))


@query(f"WITH {ISSUES} SELECT scan_id, seq, pos, code FROM issues WHERE severity = 'P2' AND category = 'SEO' AND (contains(lower(replace(code, '_', ' ')), 'structured data') OR contains(code, 'missing'))")
def issue_search(spark, sf_dir):
    found = _issues(spark, sf_dir)
    both = reports.search(found, "structured data", "SEO", "P2").unionByName(reports.search(found, "missing", "SEO", "P2"))
    return both.select("scan_id", "seq", "pos", "code").distinct()


_CSV = lambda x: f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}::VARCHAR, '^[=+\\-@\\t\\r]') OR regexp_matches({x}::VARCHAR, '[|;,\"\\n\\r'']') THEN '\"' || replace(CASE WHEN regexp_matches({x}::VARCHAR, '^[=+\\-@\\t\\r]') THEN '''' ELSE '' END || {x}::VARCHAR, '\"', '\"\"') || '\"' ELSE {x}::VARCHAR END"


@query(f"SELECT doc_id, {_CSV('text')} AS field FROM documents")
def csv_export_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sinks.csv_field(c("text")).alias("field"))


@query(f"WITH {ISSUES} SELECT scan_id, seq, pos, code || ',' || severity || ',' || category || ',' || upper(substr(replace(code, '_', ' '), 1, 1)) || substr(replace(code, '_', ' '), 2) || ',,,' || impact || ',' || effort AS line FROM issues")
def csv_export(spark, sf_dir):
    return sinks.csv_lines(_issues(spark, sf_dir)).select("scan_id", "n.seq", "n.pos", "line")


@query(f"""WITH {ISSUES} SELECT scan_id, category, '## ' || category || chr(10) || chr(10) || string_agg('### [' || severity || '] ' || upper(substr(replace(code, '_', ' '), 1, 1)) || substr(replace(code, '_', ' '), 2) || chr(10) || chr(10) || '**Page:** ' || url || chr(10), chr(10) ORDER BY n) AS text FROM issues GROUP BY scan_id, category""")
def markdown_export(spark, sf_dir):
    return sinks.markdown(_issues(spark, sf_dir))


@query()
def json_export(spark, sf_dir):
    return sinks.json_lines(_issues(spark, sf_dir))


@query()
def email_draft(spark, sf_dir):
    found = _issues(spark, sf_dir)
    pages = P.read_pages(spark, sf_dir).withColumns({"og_tags": F.create_map().cast("map<string,string>"), "favicon": F.lit(None).cast("string")})
    return sinks.mail_draft(scoring.summary(found, pages), reports.worst(found))


@query()
def executive_summary(spark, sf_dir):
    found = _issues(spark, sf_dir)
    pages = P.read_pages(spark, sf_dir).withColumns({"og_tags": F.create_map().cast("map<string,string>"), "favicon": F.lit(None).cast("string")})
    return reports.executive_summary(scoring.summary(found, pages), found)


# -- text -------------------------------------------------------------------------------------

_SYL = "CASE WHEN length(w) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND NOT ends_with(w, 'le') THEN 1 ELSE 0 END) END"


@query(rf"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS ws, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences FROM documents),
k AS (SELECT doc_id, len(ws) AS n, sentences, list_sum(list_transform(list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda w: {_SYL})) AS syllables FROM d)
SELECT doc_id, n::INT AS words, round(CASE WHEN n = 0 OR sentences = 0 THEN 100 ELSE greatest(0, least(100, 206.835 - 1.015 * (n / sentences) - 84.6 * (syllables / n))) END, 6) AS ease FROM k""")
def flesch_readability(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.word_count(c("text")).alias("words"), F.round(text.reading_ease(c("text")), 6).alias("ease"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS + STATE_WORDS)


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^a-z]', '', 'g')), lambda x: length(x) > 2) AS ws FROM documents),
w AS (SELECT doc_id, len(ws)::INT AS total, unnest(ws) AS word, unnest(range(len(ws))) AS spot FROM l), k AS (SELECT doc_id, word, count(*)::INT AS n, total, min(spot) AS first FROM w WHERE word NOT IN ({_STOP}) GROUP BY ALL)
SELECT doc_id, word, n, total FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def keyword_density(spark, sf_dir):
    """The most frequent word of each document, the first among equals."""
    told = P.keywords(spread(table(spark, sf_dir, "documents")).select("doc_id", F.lit("").alias("url"), "text"))
    return told.where("keyword.word <> ''").select("doc_id", "keyword.*")


_WORDS3 = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)"


_SIMILAR = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, {_WORDS3} AS w FROM documents), s AS (
  SELECT doc_id, source, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(list_slice(w, i, i + 2), ' '))) ELSE list_transform(w, lambda x: hash(x)) END) AS sh FROM d
), e AS (SELECT doc_id, source, len(sh) AS n, unnest(sh) AS t FROM s), p AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.source = b.source AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT source, a, b, k / (na + nb - k) AS similarity FROM p WHERE k / (na + nb - k) >= 0.7)"""


def _similar(spark: SparkSession, sf_dir: str) -> similar.Similar:
    """Similar documents within each source, as a site's pages; documents without a source are one."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", crosspage.comparable(c("text")).alias("text"))
    return similar.similar(docs.select("source", "doc_id", text.shingle_hashes(c("text")).alias("shingles")), 0.7, "source", "doc_id")


@query(f"{_SIMILAR} SELECT source, a, b, similarity FROM pairs")
def shingle_jaccard_pairs(spark, sf_dir):
    """All pairs, copies among them."""
    return similar.expanded(_similar(spark, sf_dir))


@query(f"""{_SIMILAR}, sides AS (SELECT source, a AS doc_id, b AS other, similarity FROM pairs UNION ALL SELECT source, b, a, similarity FROM pairs),
k AS (SELECT source, doc_id, least(doc_id, min(other) FILTER (similarity = 1)) AS class, count(*) FILTER (similarity = 1) AS copies, count(*) FILTER (similarity < 1) AS links FROM sides GROUP BY source, doc_id)
SELECT source, doc_id, coalesce(k.class, doc_id) AS class_id, coalesce(copies, 0) AS copies, coalesce(links, 0) AS links FROM s LEFT JOIN k USING (source, doc_id) WHERE len(sh) > 0""")
def similar_documents(spark, sf_dir):
    """One row for each document: its class, its copies and the other documents similar to it."""
    return similar.linked(_similar(spark, sf_dir)).withColumnRenamed("set", "class_id")


@query(f"""{_SIMILAR} SELECT source, a AS doc_id, similarity >= 0.9 AS same, min(b) AS partner, arg_min(similarity, b) AS similarity FROM pairs WHERE a // 10 <> b // 10 GROUP BY 1, 2, 3""")
def similar_partners(spark, sf_dir):
    """The first later document of another ten that is a duplicate, and that is merely similar."""
    base = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.floor(c("doc_id") / 10).alias("base"))
    return similar.first_partners(_similar(spark, sf_dir), base, 0.9)


# -- links ------------------------------------------------------------------------------------

# A site made of the whole tables: a start page links to the regions, a region to its nations, a
# nation to its suppliers, a supplier to the parts it sold; customers link to their nation, and
# nothing links to them. Parts link nowhere. The graph has no circle, so that the recursive SQL
# ends by itself.
_LEVELS = [("region", "'home'", "'r' || r_regionkey"), ("nation", "'r' || n_regionkey", "'n' || n_nationkey"), ("supplier", "'n' || s_nationkey", "'s' || s_suppkey"), ("lineitem", "'s' || l_suppkey", "'p' || l_partkey"), ("customer", "'c' || c_custkey", "'n' || c_nationkey")]
_NODES = [("region", "r_regionkey", "r"), ("nation", "n_nationkey", "n"), ("supplier", "s_suppkey", "s"), ("part", "p_partkey", "p"), ("customer", "c_custkey", "c")]
EDGES = "edges AS (" + " UNION ".join(f"SELECT {a} AS src, {b} AS dst FROM {t}" for t, a, b in _LEVELS) + "), nodes AS (SELECT 'home' AS node UNION ALL " + " UNION ALL ".join(f"SELECT '{k}' || {key} FROM {t}" for t, key, k in _NODES) + ")"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, home) of that site."""
    pairs = [table(spark, sf_dir, t).selectExpr("'s' AS scan_id", f"{a} AS src", f"{b} AS dst") for t, a, b in _LEVELS]
    pages = [spark.range(1).selectExpr("'s' AS scan_id", "'home' AS node")] + [table(spark, sf_dir, t).selectExpr("'s' AS scan_id", f"'{k}' || {key} AS node") for t, key, k in _NODES]
    node = issues.union(pages).withColumn("seq", F.lit(0))
    return node, issues.union(pairs).distinct(), spark.range(1).selectExpr("'s' AS scan_id", "'home' AS home")


@query(f"WITH {EDGES} SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS in_degree, (SELECT count(*) FROM edges WHERE src = node) AS out_degree FROM nodes")
def link_graph_degrees(spark, sf_dir):
    node, edge, _ = _edges(spark, sf_dir)
    return links.degrees(node, edge).select("node", "in_degree", "out_degree")


@query(f"WITH {EDGES} SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges) AND node <> 'home'")
def orphan_pages(spark, sf_dir):
    node, edge, home = _edges(spark, sf_dir)
    return links.degrees(node, edge).join(home, "scan_id").where("in_degree = 0 AND node <> home").select("node")


@query(f"WITH {EDGES} SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)")
def dead_end_pages(spark, sf_dir):
    node, edge, _ = _edges(spark, sf_dir)
    return links.degrees(node, edge).where("out_degree = 0").select("node")


@query(f"""WITH RECURSIVE {EDGES}, walk AS (
  SELECT 'home' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node
) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def click_depth(spark, sf_dir):
    return links.click_depths(*_edges(spark, sf_dir)).select("node", "depth")


# Three sites with circles: a ring of 25 nations that customers cut short, as they link to their own
# nation and to one further on. The SQL stops at a depth that no shortest path reaches.
_RING = [("nation", "n_nationkey", "'n' || n_nationkey", "'n' || (n_nationkey + 1) % 25"), ("customer", "c_custkey", "'n' || c_nationkey", "'c' || c_custkey"), ("customer", "c_custkey", "'c' || c_custkey", "'n' || c_nationkey"), ("customer", "c_custkey", "'c' || c_custkey", "'n' || (c_nationkey + c_custkey % 4) % 25")]
_SITES = [("a", 5), ("b", 11), ("c", 17)]  # a site has the customers of every so many keys
_CIRCLES = " UNION ".join(f"SELECT '{site}' AS scan_id, {a} AS src, {b} AS dst FROM {t}" + (f" WHERE {key} % {every} = 0" if t == "customer" else "") for site, every in _SITES for t, key, a, b in _RING)


@query(f"""WITH RECURSIVE edges AS ({_CIRCLES}), walk AS (
  SELECT unnest(['a', 'b', 'c']) AS scan_id, 'n0' AS node, 0 AS depth UNION SELECT e.scan_id, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.scan_id = w.scan_id AND e.src = w.node WHERE w.depth < 27
) SELECT scan_id, node, min(depth)::INT AS depth FROM walk GROUP BY ALL""")
def click_depth_circles(spark, sf_dir):
    pairs = []
    for name, every in _SITES:
        for t, key, a, b in _RING:
            held = table(spark, sf_dir, t)
            pairs.append((held.where(f"{key} % {every} = 0") if t == "customer" else held).selectExpr(f"'{name}' AS scan_id", f"{a} AS src", f"{b} AS dst"))
    edge = issues.union(pairs).distinct()
    node = edge.select("scan_id", c("src").alias("node")).distinct()
    home = issues.union([spark.range(1).selectExpr(f"'{name}' AS scan_id", "'n0' AS home") for name, _ in _SITES])
    return links.click_depths(node, edge.where("src <> dst"), home).select("scan_id", "node", "depth")


@query()
def crawl_frontier(spark, sf_dir):
    """What a crawl of each site would read first, from its first page."""
    pages = P.parse_pages(P.read_pages(spark, sf_dir), ("links",), html=False)
    starts = pages.groupBy("scan_id").agg(F.min_by("url", "seq").alias("url"))
    return frontier.crawl(links.links(pages), starts)


@query(f"""WITH {PAGES}, k AS (SELECT *, lower(regexp_replace(scheme || '://' || scan_id || path, '/+$', '')) AS key FROM p), listed AS (SELECT DISTINCT scan_id, key FROM k WHERE seq % 2 = 0),
firsts AS (SELECT scan_id, arg_min(key, seq) AS home FROM k GROUP BY scan_id)
SELECT k.scan_id, k.url FROM k JOIN firsts USING (scan_id) WHERE key <> home AND scan_id IN (SELECT scan_id FROM listed) AND (scan_id, key) NOT IN (SELECT (scan_id, key) FROM listed)""")
def sitemap_anti_join(spark, sf_dir):
    """Pages that a sitemap (made of every second page) doesn't name."""
    pages = P.complete(P.read_pages(spark, sf_dir))
    maps = pages.where("seq % 2 = 0").groupBy("scan_id").agg(F.collect_list("url").alias("urls"))
    found = crosspage.sitemap_issues(pages, maps, site.scans_of(pages), 1000)
    return found.where("code = 'page_not_in_sitemap'").select("scan_id", "url")


# -- comparisons ------------------------------------------------------------------------------


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The issues of a site's http pages against those of its https pages; P1 counts as P0."""
    found = _issues(spark, sf_dir).withColumn("pair_id", c("scan_id")).withColumn("severity", F.when(c("severity") == "P1", "P0").otherwise(c("severity")))
    return found.where(c("url").startswith("https:")), found.where(c("url").startswith("http:"))


PAIR = ISSUES + ", b AS (SELECT *, scan_id AS pair_id, CASE WHEN severity = 'P1' THEN 'P0' ELSE severity END AS sev FROM issues), cur AS (SELECT * FROM b WHERE starts_with(url, 'https:')), prev AS (SELECT * FROM b WHERE starts_with(url, 'http:'))"


@query(f"WITH {PAIR} SELECT pair_id, code, category, url FROM cur WHERE sev = 'P0' AND (pair_id, code, category) NOT IN (SELECT (pair_id, code, category) FROM prev WHERE sev = 'P0')")
def scan_compare_new_p0(spark, sf_dir):
    now, then = _pair(spark, sf_dir)
    return compare.p0_changes(now, then)["new"].select("pair_id", "code", "category", "url")


@query(f"WITH {PAIR} SELECT pair_id, code, category, url FROM prev WHERE sev = 'P0' AND (pair_id, code, category) NOT IN (SELECT (pair_id, code, category) FROM cur WHERE sev = 'P0')")
def scan_compare_resolved_p0(spark, sf_dir):
    now, then = _pair(spark, sf_dir)
    return compare.p0_changes(now, then)["resolved"].select("pair_id", "code", "category", "url")


@query(f"WITH {PAIR} SELECT pair_id, count(*) AS unchanged FROM cur WHERE sev = 'P0' AND (pair_id, code, category) IN (SELECT (pair_id, code, category) FROM prev WHERE sev = 'P0') GROUP BY pair_id")
def scan_compare_unchanged_p0(spark, sf_dir):
    now, then = _pair(spark, sf_dir)
    return compare.p0_changes(now, then)["unchanged"].groupBy("pair_id").agg(F.count(F.lit(1)).alias("unchanged"))


@query(f"""WITH {PAIR}, x AS (SELECT pair_id, code, arg_min(sev, n) AS s FROM cur GROUP BY ALL), y AS (SELECT pair_id, code, arg_min(sev, n) AS s FROM prev GROUP BY ALL)
SELECT pair_id, code, CASE WHEN x.s IS NULL THEN 'fixed' WHEN y.s IS NULL THEN 'new' ELSE 'persistent' END AS status, coalesce(x.s, y.s) AS severity FROM x FULL JOIN y USING (pair_id, code)""")
def scan_diff_by_code(spark, sf_dir):
    return compare.diff_by_code(*_pair(spark, sf_dir))


_SIDE = lambda t: f"SELECT pair_id, category, greatest(0, 100 - floor(100 * (1 - exp(-sum({PENALTY.replace('severity', 's')}) / 80.0)) + 0.5))::INT AS score FROM (SELECT pair_id, category, code, arg_min(sev, n) AS s, count(*) AS k FROM {t} GROUP BY ALL) GROUP BY ALL"


@query(f"WITH {PAIR}, x AS ({_SIDE('cur')}), y AS ({_SIDE('prev')}) SELECT pair_id, category, coalesce(x.score, 0) - coalesce(y.score, 0) AS delta FROM x FULL JOIN y USING (pair_id, category)")
def category_deltas(spark, sf_dir):
    now, then = (scoring.category_scores(s).withColumn("pair_id", c("scan_id")) for s in _pair(spark, sf_dir))
    return compare.category_deltas(now, then)


@query(f"""WITH {RUNS}, d AS (SELECT site, run_id, score - lag(score) OVER (PARTITION BY site ORDER BY created_at, run_id) AS delta, p0 FROM runs WHERE status = 'SUCCEEDED')
SELECT site, run_id, delta, concat_ws('; ', CASE WHEN delta < 0 AND abs(delta) >= 5 THEN 'Score dropped by ' || abs(delta) || ' points' END, CASE WHEN p0 > 0 THEN p0 || ' new critical issue(s) detected' END) AS reasons FROM d WHERE delta IS NOT NULL""")
def alert_decision(spark, sf_dir):
    runs = history.previous(_runs(spark, sf_dir)).where("previous_run IS NOT NULL").withColumn("delta", c("score") - c("previous_score"))
    return runs.select("site", "run_id", "delta", F.concat_ws("; ", compare.alert_reasons(c("delta"), c("p0"))).alias("reasons"))


# -- history ----------------------------------------------------------------------------------

_HISTORY = f"{RUNS}, h AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) AS back, count(*) OVER (PARTITION BY site) AS m FROM runs WHERE status = 'SUCCEEDED'), kept AS (SELECT site, run_id, created_at, score, least(m, 10) - back AS place FROM h WHERE back <= 10 AND m >= 2)"


@query(f"WITH {_HISTORY} SELECT site, run_id, score, place FROM kept")
def score_history(spark, sf_dir):
    return history.score_history(_runs(spark, sf_dir)).select("site", "run_id", "score", "place")


@query(f"WITH {_HISTORY}, b AS (SELECT *, greatest(0, min(score) OVER w - 5) AS low, least(100, max(score) OVER w + 5) AS high FROM kept WINDOW w AS (PARTITION BY site)) SELECT site, place, low, high, (score - low) / CASE WHEN high = low THEN 1 ELSE high - low END AS y FROM b")
def sparkline(spark, sf_dir):
    return history.sparkline(history.score_history(_runs(spark, sf_dir))).select("site", "place", "low", "high", "y")


@query(f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) AS back FROM runs) SELECT site, count(*) AS runs, arg_max(run_id, (created_at, run_id)) AS latest_run, string_agg(score::VARCHAR, ',' ORDER BY created_at, run_id) FILTER (status = 'SUCCEEDED' AND back <= 50) AS scores FROM r GROUP BY site")
def history_groups(spark, sf_dir):
    return history.by_site(_runs(spark, sf_dir)).select("site", "runs", "latest_run", F.array_join("scores", ",").alias("scores"))


_TREND = f"{RUNS}, l AS (SELECT *, score - lag(score) OVER (PARTITION BY site ORDER BY created_at, run_id) AS delta FROM runs WHERE status = 'SUCCEEDED'), t AS (SELECT site, delta FROM l QUALIFY row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) = 1)"


@query(f"WITH {_TREND} SELECT site, delta FROM t WHERE delta IS NOT NULL")
def score_trend_delta(spark, sf_dir):
    return history.trends(_runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) = 1")
def latest_runs(spark, sf_dir):
    return history.latest(_runs(spark, sf_dir)).select("site", "run_id", "created_at", "status", "score", "p0")


@query(f"""WITH {_TREND}, n AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) = 1)
SELECT floor((SELECT avg(score) FROM n WHERE status = 'SUCCEEDED') + 0.5)::INT AS avg_score, (SELECT sum(p0) FROM n WHERE status = 'SUCCEEDED')::BIGINT AS total_p0, (SELECT count(*) FROM t WHERE delta > 0) AS improving, (SELECT count(*) FROM t WHERE delta < 0) AS declining""")
def dashboard_stats(spark, sf_dir):
    return history.dashboard(_runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT run_id, created_at FROM runs WHERE created_at < TIMESTAMP '2024-01-15 00:00:00' OR (created_at = TIMESTAMP '2024-01-15 00:00:00' AND run_id < 0) ORDER BY created_at DESC, run_id DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    at = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return history.page(_runs(spark, sf_dir).withColumn("created_at", c("created_at").cast("timestamp")), (at, 0)).select("run_id", c("created_at").cast("timestamp_ntz").alias("created_at"))


@query("""WITH e AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' ELSE 'MONTHLY' END AS frequency, date_trunc('day', ts) AS day FROM events)
SELECT event_id, frequency, CASE frequency WHEN 'DAILY' THEN day + INTERVAL 6 HOUR + CASE WHEN ts >= day + INTERVAL 6 HOUR THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
WHEN 'WEEKLY' THEN day + INTERVAL 6 HOUR + to_days((8 - isodow(ts))::INT) ELSE date_trunc('month', ts) + INTERVAL 6 HOUR + to_months(CASE WHEN day(ts) > day(last_day(date_trunc('month', ts) + INTERVAL 1 MONTH)) THEN 2 ELSE 1 END) END AS next_run FROM e""")
def next_run_at(spark, sf_dir):
    frequency = F.when(c("event_id") % 3 == 0, "DAILY").when(c("event_id") % 3 == 1, "WEEKLY").otherwise("MONTHLY")
    events = table(spark, sf_dir, "events").select("event_id", c("ts").cast("timestamp").alias("ts"), frequency.alias("frequency"))
    return events.select("event_id", "frequency", labels.next_run(c("frequency"), c("ts")).cast("timestamp_ntz").alias("next_run"))


_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query(f"""WITH e AS (SELECT event_id, ts, floor((epoch_us({_NOW}) - epoch_us(ts)) / 1000000)::BIGINT AS s, floor((epoch_us(ts) - epoch_us({_NOW})) / 3600000000)::BIGINT AS h FROM events)
SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago,
CASE WHEN ts < {_NOW} THEN 'Overdue' WHEN h < 24 THEN 'in ' || h || 'h' ELSE 'in ' || h // 24 || 'd' END AS until FROM e""")
def relative_times(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-20 12:00:00"))
    t = c("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", labels.time_ago(t, now).alias("ago"), labels.until(t, now).alias("until"))


@query(f"""WITH {RUNS} SELECT run_id, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN score >= 90 THEN '#22c55e' WHEN score >= 75 THEN '#84cc16' WHEN score >= 50 THEN '#eab308' WHEN score >= 25 THEN '#f97316' ELSE '#ef4444' END AS colour,
CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Needs Improvement' ELSE 'Critical' END AS mail_grade FROM runs""")
def grades(spark, sf_dir):
    s = c("score")
    return _runs(spark, sf_dir).select("run_id", labels.grade(s).alias("grade"), labels.colour(s).alias("colour"), labels.mail_grade(s).alias("mail_grade"))


@query()
def badges(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", sinks.badge(c("score")).alias("svg"))


# -- measured and site-level checks -----------------------------------------------------------


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    viewport = F.when(c("event_id") % 4 == 0, "mobile").otherwise("desktop")
    return e.select(c("user_id").cast("string").alias("scan_id"), c("event_id").alias("seq"), F.concat(F.lit("https://s/"), c("event_id").cast("string")).alias("url"), viewport.alias("viewport"), (c("value") * 40).alias("fcp"), (c("value") * 60).alias("lcp"), (c("value") / 300).alias("cls"), (c("value") * 5).alias("inp"), (c("value") * 90).alias("load"), F.when(c("event_id") % 2 == 0, "x").alias("lcp_src"))


MEASURES = "m AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'mobile' ELSE 'desktop' END AS viewport, value * 40 AS fcp, value * 60 AS lcp, value / 300 AS cls, value * 5 AS inp, value * 90 AS load, CASE WHEN event_id % 2 = 0 THEN 'x' END AS lcp_src FROM events)"


@query(f"WITH {MEASURES} " + " UNION ALL ".join(f"SELECT seq, '{code}' AS code, '{sev}' AS severity, {i} AS impact, {e} AS effort FROM m WHERE viewport = '{v}' AND {test}" for v, ms in sitechecks.MEASURES.items() for code, sev, i, e, test in ms))
def performance_issues(spark, sf_dir):
    return sitechecks.performance_issues(_measures(spark, sf_dir)).select("seq", "code", "severity", "impact", "effort")


@query(f"""WITH {MEASURES} SELECT seq, greatest(0, 100 - CASE WHEN fcp > 3000 THEN 30 WHEN fcp > 1800 THEN 15 ELSE 0 END - CASE WHEN lcp > 4000 THEN 30 WHEN lcp > 2500 THEN 15 ELSE 0 END - CASE WHEN cls > 0.25 THEN 20 WHEN cls > 0.1 THEN 10 ELSE 0 END
- CASE WHEN inp > 500 THEN 20 WHEN inp > 200 THEN 10 ELSE 0 END - CASE WHEN load > 5000 THEN 20 WHEN load > 3000 THEN 10 ELSE 0 END)::INT AS score FROM m""")
def performance_score(spark, sf_dir):
    return _measures(spark, sf_dir).select("seq", sitechecks.performance_score(*(c(k) for k in ("fcp", "lcp", "cls", "inp", "load"))).cast("int").alias("score"))


_CSP = ["default-src *", "script-src 'unsafe-inline' data:", "script-src 'unsafe-eval' https:", "default-src 'self'", "script-src *.x.com"]
_COOKIES = [[], ["a=1; Secure"], ["b=2; HttpOnly; SameSite=Lax"], ["=x", "c=3; secure; httponly; samesite=none"]]
_SET = lambda k: f"(c_custkey // {1 << k}) % 2 = 1"


@query(" UNION ALL ".join(
    [f"SELECT c_custkey AS seq, '{code}' AS code, '{sev}' AS severity FROM customer WHERE NOT ({_SET(k)})" for k, (_, code, sev, _, _) in enumerate(rules.HEADERS)]
    + [f"SELECT c_custkey, '{code}', '{sev}' FROM customer WHERE {_SET(0)} AND c_custkey % 5 IN ({of})" for code, sev, of in (("csp_unsafe_inline", "P1", "1"), ("csp_unsafe_eval", "P1", "2"), ("csp_wildcard_source", "P2", "0, 2"), ("csp_data_uri_scripts", "P2", "1"))]
    + [f"SELECT c_custkey, '{code}', '{sev}' FROM customer WHERE c_nationkey % 4 = {of}" for code, sev, of in (("cookie_missing_secure", "P1", 2), ("cookie_missing_httponly", "P2", 1), ("cookie_missing_samesite", "P3", 1))]
))
def security_issues(spark, sf_dir):
    """Headers, policies and cookies; customers stand in for responses (bits of their key)."""
    key = c("c_custkey")
    value = F.element_at(F.array(*(F.lit(x) for x in _CSP)), (key % 5 + 1).cast("int"))
    pairs = [F.when(F.shiftright(key, k) % 2 == 1, F.struct(F.lit(name).alias("k"), (value if not k else F.lit("x")).alias("v"))) for k, (name, *_) in enumerate(rules.HEADERS)]
    jars = F.array(*(F.array(*(F.lit(x) for x in jar)).cast("array<string>") for jar in _COOKIES))
    pages = table(spark, sf_dir, "customer").select(
        F.lit("s").alias("scan_id"), key.alias("seq"), F.concat(F.lit("https://s/"), key.cast("string")).alias("url"),
        F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("response_headers"), F.element_at(jars, (c("c_nationkey") % 4 + 1).cast("int")).alias("cookies"),
    )
    return rules.evaluate(pages, [r for r in rules.SECURITY if r.code.startswith(("missing_", "csp_", "cookie_")) and r.code != "missing_noopener"]).select("seq", "code", "severity")


_STATUS = "CASE k % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 0 WHEN 3 THEN 500 ELSE 200 END"


@query(f"""WITH l AS (SELECT o_custkey::VARCHAR AS scan_id, o_orderkey AS seq, o_orderkey % 1000 AS k, o_orderkey % 3 <> 0 AS own FROM orders),
u AS (SELECT scan_id, k, min(seq) AS first, arg_max(own, seq) AS own FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, own ORDER BY first) AS rank, {_STATUS} AS st FROM u),
f AS (SELECT scan_id, k, string_agg(page, ' ' ORDER BY first) AS found_on FROM (SELECT scan_id, k, 'https://h/page/' || seq % 7 AS page, min(seq) AS first FROM l GROUP BY ALL) GROUP BY ALL),
s AS (SELECT * FROM r JOIN f USING (scan_id, k) WHERE rank <= CASE WHEN own THEN 100 ELSE 20 END)
SELECT scan_id, 'https://h/' || k AS url, 'broken_link' AS code, CASE WHEN NOT own AND st IN (403, 0) THEN 'P3' WHEN st = 404 THEN 'P1' ELSE 'P2' END AS severity, CASE WHEN NOT own AND st IN (403, 0) THEN 2 ELSE 4 END AS impact, found_on FROM s WHERE st = 0 OR st >= 400
UNION ALL SELECT scan_id, 'https://h/' || k, 'redirect_chain', 'P2', 3, found_on FROM s WHERE k % 4 = 0""")
def broken_links(spark, sf_dir):
    """Broken links and redirect chains; orders stand in for links (customer: site)."""
    key, k = c("o_orderkey"), c("o_orderkey") % 1000
    href = F.concat(F.lit("https://h/"), k.cast("string"))
    held = table(spark, sf_dir, "orders").select(c("o_custkey").cast("string").alias("scan_id"), key.alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("https://h/page/"), (key % 7).cast("string")).alias("source_url"), href.alias("href"), F.lit("t").alias("text"), (key % 3 != 0).alias("is_internal"))
    codes = F.element_at(F.array(*(F.lit(x) for x in (404, 403, 0, 500, 200, 200, 200, 200, 200, 200))), (c("id") % 10 + 1).cast("int"))
    chain = F.array_repeat(F.lit("x"), F.when(c("id") % 4 == 0, 3).otherwise(1))
    status = spark.range(1000).select(F.concat(F.lit("https://h/"), c("id").cast("string")).alias("href"), codes.alias("status_code"), F.lit(None).cast("string").alias("error"), chain.alias("chain"))
    found = links.with_sources(links.checked(links.unique_links(held), status), held)
    return links.broken_issues(found).unionByName(links.chain_issues(found)).select("scan_id", "url", "code", "severity", "impact", F.array_join(F.from_json(F.get_json_object("evidence", "$.foundOnPages"), "array<string>"), " ").alias("found_on"))


@query("SELECT n_name AS scan_id, CASE WHEN n_nationkey % 3 < 2 THEN '/a' || n_nationkey || ',' ELSE '' END || '/b' AS patterns FROM nation")
def robots_disallow(spark, sf_dir):
    """Disallow patterns by agent; nations stand in for sites."""
    agent = F.element_at(F.array(F.lit("*"), F.lit("Googlebot"), F.lit("other")), (c("n_nationkey") % 3 + 1).cast("int"))
    own = F.concat(F.lit("\nDisallow: /a"), c("n_nationkey").cast("string"))
    body = F.concat(F.lit("User-agent: "), agent, own, F.lit("\nDisallow: /"), own, F.lit("\nUser-agent: *\nDisallow: /b:c"))
    files = table(spark, sf_dir, "nation").select(c("n_name").alias("scan_id"), F.lit("/robots.txt").alias("path"), F.lit(True).alias("ok"), F.lit(200).alias("status"), body.alias("body"))
    return site.disallow_patterns(files).select("scan_id", F.array_join("disallow", ",").alias("patterns"))


@query("SELECT event_id AS seq, CASE WHEN floor(value * 40) > 2000 THEN 'slow_server_response' ELSE 'moderate_server_response' END AS code FROM events WHERE floor(value * 40) > 800")
def response_times(spark, sf_dir):
    """Slow answers; events stand in for pages (value: time to the first byte)."""
    pages = table(spark, sf_dir, "events").select(F.lit("s").alias("scan_id"), c("event_id").alias("seq"), F.lit("u").alias("url"), F.floor(c("value") * 40).alias("ttfb_ms"))
    return rules.evaluate(pages, rules.MEASURED[:2]).select("seq", "code")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1) // 50)::INT AS page FROM events QUALIFY page < 4")
def keyset_walk(spark, sf_dir):
    """The first four pages of events, each by the cursor of the one before, from a laid-out table."""
    from uuid import uuid4

    from siteloom.plans.lineage import shared_dir

    events, path, cursor, out = table(spark, sf_dir, "events").select("ts", "event_id"), f"{shared_dir(spark)}/keyset-{uuid4().hex}", None, []
    keyset.lay_out(events, path, ["ts", "event_id"], 5000)
    for number in range(4):
        got = keyset.page(spark, path, events.schema, ["ts", "event_id"], cursor, 50)
        out.append(got.limit(50).select("event_id", F.lit(number).alias("page")))
        last = got.limit(50).orderBy("ts", "event_id").first()
        if last is None:
            break
        cursor = (last["ts"], last["event_id"])
    return issues.union(out)


_SCHEDULES = "(c_custkey * 37) % 1009"


@query(f"""WITH {RUNS}, shown AS (SELECT c_custkey AS schedule_id, c_custkey % 200 AS site, {_SCHEDULES} AS created_at FROM customer WHERE c_nationkey % 2 = 0 ORDER BY created_at DESC, schedule_id DESC LIMIT 100),
k AS (SELECT site, run_id, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, run_id DESC) AS back FROM runs WHERE site IN (SELECT site FROM shown) QUALIFY back <= 10)
SELECT schedule_id, site, coalesce(string_agg(run_id::VARCHAR, ' ' ORDER BY back), '') AS runs FROM shown LEFT JOIN k USING (site) GROUP BY ALL""")
def schedule_list(spark, sf_dir):
    """The newest enabled schedules, each with its ten recent runs; customers stand in for schedules."""
    held = table(spark, sf_dir, "customer").select(c("c_custkey").alias("schedule_id"), (c("c_custkey") % 200).alias("site"), (c("c_nationkey") % 2 == 0).alias("enabled"), F.expr(_SCHEDULES).alias("created_at"))
    told = history.schedule_list(held, _runs(spark, sf_dir), enabled_only=True, limit=500)
    return told.select("schedule_id", "site", F.coalesce(F.array_join(F.transform("runs", lambda r: r["run_id"].cast("string")), " "), F.lit("")).alias("runs"))


def _store(spark: SparkSession) -> Store:
    from uuid import uuid4

    from siteloom.plans.lineage import shared_dir

    return Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def keyed_updates(spark, sf_dir):
    """The last event of each user, by merges in mixed order, one of them twice, and compaction."""
    events, made = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), _store(spark)
    for part in (2, 0, 2, 1):
        made.merge(events.where(c("event_id") % 3 == part), ["user_id"], "event_id", f"part-{part}", 8)
    made.compact()
    return made.state()


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def inserted_batches(spark, sf_dir):
    """Events by type, from a table that took them in batches, one of them twice."""
    events, made = table(spark, sf_dir, "events").select("event_id", "event_type"), _store(spark)
    for part in (0, 1, 1, 2):
        made.insert(events.where(c("event_id") % 3 == part), f"part-{part}")
    return made.rows().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT 1 AS place, 'types' AS phase, 'finished' AS outcome, (SELECT count(DISTINCT event_type) FROM events) AS rows, 1 / 3::DOUBLE AS done
UNION ALL SELECT 2, 'sites', 'finished', (SELECT count(DISTINCT user_id) FROM events), 2 / 3::DOUBLE UNION ALL SELECT 3, 'urls', 'finished', (SELECT count(*) FROM pages), 1::DOUBLE""")
def phase_progress(spark, sf_dir):
    """Progress of phases that a deadline leaves time for."""
    from uuid import uuid4

    from siteloom.plans.lineage import shared_dir

    by = lambda k: table(spark, sf_dir, "events").groupBy(k).count()
    told = phases.run(spark, {"types": lambda: by("event_type"), "sites": lambda: by("user_id"), "urls": lambda: table(spark, sf_dir, "pages").select("url")}, f"{shared_dir(spark)}/phases-{uuid4().hex}")
    return told.select("place", "phase", "outcome", "rows", "done")


# -- whole plans ------------------------------------------------------------------------------


@query()
def dom_extract(spark, sf_dir):
    """What one parse gives of each page."""
    return P.parse_pages(P.read_pages(spark, sf_dir), html=False)


@query()
def page_rule_issues(spark, sf_dir):
    """Issues of all page rules over the parsed pages."""
    return audit.page_issues(audit.with_robots(P.complete(_parsed(spark, sf_dir)), None))


@query(composed.ISSUES_SQL)
def composed_page_issues(spark, sf_dir):
    """What the page rules find on pages whose faults are known."""
    return composed.found(spark, sf_dir)


@query(composed.TECHNOLOGIES_SQL)
def composed_technologies(spark, sf_dir):
    """The technologies that these pages name."""
    found = composed.composed(spark, sf_dir).select("seq", F.explode(technology.detections(c("html"))).alias("d"))
    return found.select("seq", c("d.name").alias("name"))


@query(composed.FIELDS_SQL)
def composed_page_fields(spark, sf_dir):
    """What the parse reads from these pages."""
    return composed.fields(spark, sf_dir)


@query()
def full_audit(spark, sf_dir):
    """All issues of an audit, de-duplicated."""
    from siteloom.plans.lineage import cut

    return audit.audit(cut(_parsed(spark, sf_dir)))["issues"]


_LIMITED = """WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS key, event_id AS request_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
s AS (SELECT key, i, request_id, at_ms, TRUE AS allowed, 2 AS remaining, 86400000::BIGINT AS reset_ms, [at_ms] AS times FROM r WHERE i = 1
  UNION ALL SELECT key, i, request_id, at_ms, len(kept) < 3, CASE WHEN len(kept) < 3 THEN 2 - len(kept) ELSE 0 END::INT, CASE WHEN len(kept) < 3 THEN 86400000 ELSE kept[1] + 86400000 - at_ms END, CASE WHEN len(kept) < 3 THEN list_append(kept, at_ms) ELSE kept END
  FROM (SELECT r.*, list_filter(s.times, lambda t: t > r.at_ms - 86400000) AS kept FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1))
SELECT key, request_id, at_ms, allowed, remaining, reset_ms FROM s"""


@query(_LIMITED)
def rate_limit(spark, sf_dir):
    """Decisions of a limiter of three requests a day for each user."""
    return limiter.limit_batch(limiter.requests(table(spark, sf_dir, "events"), "user_id", "ts", "event_id"), 3, 86_400_000)


@query(_LIMITED)
def rate_limit_stream(spark, sf_dir):
    """The same decisions by a streaming query over the stored events."""
    import uuid

    from siteloom.plans.lineage import shared_dir

    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    base = f"{shared_dir(spark)}/limiter-{uuid.uuid4().hex}"
    asked = limiter.requests(stream.withColumn("ts", c("ts").cast("timestamp")), "user_id", "ts", "event_id")
    done = limiter.limit_stream(asked, 3, 86_400_000, expire_idle=False).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(limiter.OUT).parquet(f"{base}/out")


_LATE_MS = 86_400_000


@query(f"SELECT * FROM ({_LIMITED}) WHERE at_ms < (SELECT max(epoch_us(ts) // 1000) FROM events) - {_LATE_MS}")
def rate_limit_ordered(spark, sf_dir):
    """The same decisions where events come in four batches that overlap by up to a day, each taken
    by a run of the stream that goes on from the one before; the last day is still waiting."""
    import uuid

    from siteloom.plans.lineage import shared_dir

    asked = limiter.requests(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    comes = c("at_ms") + F.pmod(c("request_id") * 7919, F.lit(_LATE_MS))
    low, high = asked.agg(F.min(comes), F.max(comes)).first()
    base, buckets = f"{shared_dir(spark)}/limiter-{uuid.uuid4().hex}", limiter.buckets_for(asked)
    for batch in range(4):
        share = ((comes - (low or 0)) * 4 / ((high or 0) - (low or 0) + 1)).cast("int")
        asked.where(share == batch).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(asked.schema).parquet(f"{base}/in")
        limiter.limit_ordered(stream, 3, 86_400_000, _LATE_MS, buckets).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(limiter.OUT).parquet(f"{base}/out")
