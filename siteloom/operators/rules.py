"""The catalogue of page rules. A rule is a predicate and an evidence over the parsed page; all
rules of a page are evaluated in one projection and turned into issue rows without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls

c = F.col
ISSUE = "struct<code: string, severity: string, category: string, impact: int, effort: int, url: string, evidence: string>"


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str | Callable[[], Column]
    category: str
    impact: int | Callable[[], Column]
    effort: int
    when: Callable[[], Column]
    evidence: dict[str, Callable[[], Column]] = field(default_factory=dict)


def _value(x) -> Column:
    return x() if callable(x) else F.lit(x)


def issue(rule: Rule, url: Column, shown: bool = True) -> Column:
    """The rule's issue for a page, or null; shown says whether evidence is gathered."""
    held = F.to_json(F.struct(url.alias("url"), *(make().alias(k) for k, make in rule.evidence.items()))) if shown else F.lit(None).cast("string")
    found = F.struct(
        F.lit(rule.code).alias("code"), _value(rule.severity).alias("severity"), F.lit(rule.category).alias("category"),
        _value(rule.impact).cast("int").alias("impact"), F.lit(rule.effort).alias("effort"), url.alias("url"), held.alias("evidence"),
    )
    return F.when(F.coalesce(rule.when(), F.lit(False)), found)


def evaluate(pages: DataFrame, rules: list[Rule], keys: tuple[str, ...] = ("scan_id", "seq"), chunk: int = 12) -> DataFrame:
    """Issue rows (keys, pos, code, severity, category, impact, effort, url, evidence); pos is
    the rule's place in the list."""
    return judged(pages, rules, keys, chunk).select(*keys, F.posexplode("issues").alias("pos", "x")).where("x IS NOT NULL").select(*keys, "pos", "x.*")


def judged(pages: DataFrame, rules: list[Rule], keys: tuple[str, ...] = ("scan_id", "seq"), chunk: int = 12, shown: bool = True) -> DataFrame:
    """(keys, issues): for each page an array with each rule's issue, or null, in the order of the
    list. Rules are grouped so that generated code stays small."""
    if "disallow" not in pages.columns:  # robots patterns of the page's site
        pages = pages.withColumn("disallow", F.array().cast("array<string>"))
    groups = [rules[i : i + chunk] for i in range(0, len(rules), chunk)]
    made = known(pages).select(*keys, *(F.array(*(issue(r, c("url"), shown) for r in g)).alias(f"g{i}") for i, g in enumerate(groups)))
    return made.select(*keys, F.flatten(F.array(*(c(f"g{i}") for i in range(len(groups))))).alias("issues"))


def known(pages: DataFrame) -> DataFrame:
    """Adds known, what several rules ask of a page, once (by a generator, as plans copy plain
    expressions into each of their uses). Patterns are tried only on pages whose markup, in lower
    case, holds a word that every match has."""
    told = {"home": urls.is_homepage(c("url")), "article": urls.is_article(c("url")), "auth": urls.is_auth_page(c("url"), c("disallow")), "path_query": F.concat(urls.path(c("url")), urls.search(c("url")))}
    if "html" in pages.columns:
        low = F.lower(html())
        none = F.array().cast("array<string>")
        told |= {
            "hreflang": F.when(low.contains("hreflang"), hreflang_tags()).otherwise(F.array().cast("array<struct<lang: string, href: string>>")),
            "blocks": F.when(low.contains("application/ld+json"), F.regexp_extract_all(html(), F.lit(JSONLD), F.lit(1))).otherwise(none),
            "prev": F.when(low.contains("prev"), _rel_tag("prev")).otherwise(""), "next": F.when(low.contains("next"), _rel_tag("next")).otherwise(""),
            "fonts": F.when(low.contains("font-size"), F.size(_small_fonts())).otherwise(0), "targets": F.when(low.rlike(r"style\s*="), F.size(_small_targets())).otherwise(0),
        }
    return pages.select("*", F.explode(F.array(F.struct(*(v.alias(k) for k, v in told.items())))).alias("known"))


# -- shared expressions ---------------------------------------------------------------------

def flag(name: str) -> Column:
    return F.coalesce(c("dom.flags")[name], F.lit(False))


def og(name: str) -> Column:
    return F.nullif(F.coalesce(c("og_tags")[name], F.lit("")), F.lit(""))


auth = lambda: c("known.auth")
home = lambda: c("known.home")
article = lambda: c("known.article")
path_query = lambda: c("known.path_query")
alternates = lambda: c("known.hreflang")
html = lambda: F.coalesce(c("html"), F.lit(""))
missing = lambda name: lambda: F.coalesce(c(name), F.lit("")) == ""
chars = lambda name: lambda: F.length(c(name))
has_text = lambda: html() != ""
header = lambda name: c("response_headers")[name]
any_of = lambda arr, test: F.exists(arr, test)
blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""

SEARCHY = r"(?i)[?&](search|q|query|s)=|/(search|login|signin|signup|register|auth|preview|draft)\b"
JSONLD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
HREFLANG = r"(?i)<link[^>]*\bhreflang\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
# Link texts that say nothing about their target.
GENERIC = r"(?i)^(click\s*here|here|read\s*more|learn\s*more|more|link|this|this\s*link|go|see\s*more|continue|continue\s*reading|details|info|view|view\s*more)$"
# Traces of client-side frameworks.
FRAMEWORKS = {
    "react": r"(?i:react(?:\.min)?\.js|react-dom(?:\.min)?\.js)|/_next/|/next/|__NEXT_DATA__",
    "vue": r"(?i:vue(?:\.min)?\.js|vue\.runtime(?:\.min)?\.js)|/_nuxt/|__NUXT__",
    "angular": r"(?i:angular(?:\.min)?\.js|zone\.js|ng-version)",
    "svelte": r"(?i:svelte(?:\.min)?\.js|svelte-kit)|/__svelte/",
}


def hreflang_tags() -> Column:
    """Array of (lang, href) of alternate links, by the tag's text."""
    tags = F.filter(F.regexp_extract_all(html(), F.lit(HREFLANG), F.lit(0)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']alternate[\"']"))
    one = lambda t: F.struct(
        F.regexp_extract(t, r"(?i)\bhreflang\s*=\s*[\"']([^\"']+)[\"']", 1).alias("lang"), F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1).alias("href")
    )
    return F.transform(tags, one)


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, "/$", "")), "^//", ""), "^https?://", ""), r"^www\.", "")


def _rel_tag(name: str) -> Column:
    return F.regexp_extract(html(), rf"(?i)<link[^>]*\brel\s*=\s*[\"']{name}[\"'][^>]*>", 0)


def _rel_href(name: str) -> Column:
    return F.regexp_extract(c(f"known.{name}"), r"(?i)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)


def _small_fonts() -> Column:
    tags = F.regexp_extract_all(html(), F.lit(r"(?i)style\s*=\s*[\"'][^\"']*font-size\s*:\s*(\d+(?:\.\d+)?)(px|pt)[^\"']*[\"']"), F.lit(0))
    size = lambda t: F.regexp_extract(t, r"(?i).*font-size\s*:\s*(\d+(?:\.\d+)?)(px|pt)", 1).try_cast("double")
    unit = lambda t: F.lower(F.regexp_extract(t, r"(?i).*font-size\s*:\s*(\d+(?:\.\d+)?)(px|pt)", 2))
    return F.filter(tags, lambda t: size(t) < F.when(unit(t) == "pt", 9).otherwise(12))


def _small_targets() -> Column:
    tags = F.regexp_extract_all(html(), F.lit(r"(?i)<(button|a|input|select)\b[^>]*style\s*=\s*[\"'][^\"']*(?:width|height)\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)[^\"']*[\"'][^>]*>"), F.lit(0))

    def small(t: Column, side: str) -> Column:
        rx = rf"(?i){side}\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)"
        return F.coalesce(F.regexp_extract(t, rx, 1).try_cast("double") < F.when(F.lower(F.regexp_extract(t, rx, 2)) == "px", 48).otherwise(3), F.lit(False))

    return F.filter(tags, lambda t: small(t, "width") | small(t, "height"))


def pattern_meets(rx: str) -> Column:
    return html().rlike(rx)


SEO: list[Rule] = [
    Rule("missing_title", lambda: F.when(auth(), "P3").otherwise("P0"), "SEO", lambda: F.when(auth(), 1).otherwise(5), 1, missing("title")),
    Rule("title_too_short", "P1", "SEO", 3, 1, lambda: ~missing("title")() & (F.length("title") < 10), {"actual": lambda: c("title")}),
    Rule("title_too_long", "P2", "SEO", 2, 1, lambda: F.length("title") > 60, {"actual": chars("title")}),
    Rule("missing_meta_description", "P1", "SEO", 4, 1, missing("meta_description")),
    Rule("meta_description_too_short", "P2", "SEO", 2, 1, lambda: ~missing("meta_description")() & (F.length("meta_description") < 50), {"actual": chars("meta_description")}),
    Rule("meta_description_too_long", "P3", "SEO", 1, 1, lambda: F.length("meta_description") > 160, {"actual": chars("meta_description")}),
    Rule("missing_h1", lambda: F.when(auth(), "P3").otherwise("P1"), "SEO", lambda: F.when(auth(), 1).otherwise(4), 1, missing("h1")),
    Rule("missing_canonical", "P2", "SEO", 3, 1, missing("canonical")),
    Rule("relative_canonical", "P2", "SEO", 3, 1, lambda: ~missing("canonical")() & ~c("canonical").startswith("http"), {"actual": lambda: c("canonical")}),
    Rule("cross_domain_canonical", "P1", "SEO", 5, 1, lambda: c("canonical").startswith("http") & urls.is_url(c("canonical")) & (urls.without_www(urls.hostname(c("canonical"))) != urls.without_www(urls.hostname(c("url")))), {"actual": lambda: c("canonical")}),
    Rule("page_noindex", lambda: F.when(c("url").rlike(SEARCHY), "P2").otherwise("P0"), "SEO", lambda: F.when(c("url").rlike(SEARCHY), 2).otherwise(5), 1, lambda: F.lower("robots_meta").contains("noindex"), {"actual": lambda: c("robots_meta")}),
    Rule("missing_og_title", "P2", "SEO", 3, 1, lambda: og("og:title").isNull()),
    Rule("missing_og_description", "P3", "SEO", 2, 1, lambda: og("og:description").isNull()),
    Rule("missing_og_image", "P2", "SEO", 3, 2, lambda: og("og:image").isNull()),
    Rule("og_image_relative", "P2", "SEO", 3, 1, lambda: ~og("og:image").startswith("http"), {"actual": lambda: og("og:image")}),
    Rule("missing_twitter_card", "P3", "SEO", 2, 1, lambda: og("twitter:card").isNull()),
    Rule("missing_viewport", "P1", "SEO", 5, 1, missing("viewport")),
    Rule("viewport_not_responsive", "P2", "SEO", 4, 1, lambda: ~missing("viewport")() & ~c("viewport").contains("width=device-width"), {"actual": lambda: c("viewport")}),
    Rule("viewport_not_mobile_friendly", "P2", "SEO", 3, 1, lambda: F.lower("viewport").rlike(r"user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0)?(?!\d)"), {"actual": lambda: c("viewport")}),
    Rule("text_too_small_mobile", "P2", "SEO", 3, 2, lambda: c("known.fonts") > 0, {"count": lambda: c("known.fonts")}),
    Rule("tap_targets_too_close", "P3", "SEO", 2, 2, lambda: c("known.targets") > 0, {"count": lambda: c("known.targets")}),
    Rule("mobile_usability_interstitial", "P2", "SEO", 3, 2, lambda: F.size("dom.interstitials") > 0, {"patterns": lambda: c("dom.interstitials")}),
    Rule("missing_lang_attribute", "P2", "ACCESSIBILITY", 3, 1, missing("lang")),
    Rule("missing_favicon", "P2", "SEO", 2, 1, lambda: home() & has_text() & ~F.lower(html()).rlike(r"rel=(\"|')(icon|shortcut icon|apple-touch-icon)\1")),
    Rule("hreflang_missing_self_reference", "P2", "SEO", 3, 1, lambda: (F.size(alternates()) > 0) & ~any_of(alternates(), lambda t: _bare(t["href"]) == _bare(c("url"))), {"tags": lambda: F.size(alternates())}),
    Rule("hreflang_invalid_language", "P2", "SEO", 3, 1, lambda: any_of(alternates(), lambda t: ~F.lower(t["lang"]).rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8}){0,2}\z|^x-default\z"))),
    Rule("url_uppercase", "P3", "SEO", 1, 2, lambda: any_of(F.split(path_query(), "/"), lambda s: ~s.rlike(r"^[a-z]{2,3}[-_][A-Z]{2,4}\z") & s.rlike("[A-Z]")), {"actual": path_query}),
    Rule("url_too_long", "P3", "SEO", 1, 2, lambda: F.length(path_query()) > 115, {"actual": lambda: F.length(path_query())}),
    Rule("url_underscores", "P3", "SEO", 1, 2, lambda: path_query().contains("_"), {"actual": path_query}),
    Rule("pagination_missing_rel_links", "P2", "SEO", 3, 1, lambda: has_text() & c("url").rlike("(?i)" + urls.PAGINATION) & (c("known.prev") == "") & (c("known.next") == "")),
    Rule("pagination_prev_relative", "P3", "SEO", 2, 1, lambda: (_rel_href("prev") != "") & ~_rel_href("prev").startswith("http") & ~_rel_href("prev").startswith("/"), {"actual": lambda: _rel_href("prev")}),
    Rule("pagination_next_relative", "P3", "SEO", 2, 1, lambda: (_rel_href("next") != "") & ~_rel_href("next").startswith("http") & ~_rel_href("next").startswith("/"), {"actual": lambda: _rel_href("next")}),
]

LINK_TEXT: list[Rule] = [
    Rule("empty_anchor_text", "P2", "SEO", 3, 1, lambda: any_of(c("links"), lambda x: blank(x["text"])), {"count": lambda: F.size(F.filter("links", lambda x: blank(x["text"])))}),
    Rule("non_descriptive_anchor", "P3", "SEO", 2, 1, lambda: any_of(c("links"), lambda x: F.trim(x["text"]).rlike(GENERIC)), {"count": lambda: F.size(F.filter("links", lambda x: F.trim(x["text"]).rlike(GENERIC)))}),
    Rule("missing_structured_data", "P3", "SEO", 3, 2, lambda: has_text() & home() & (F.size("known.blocks") == 0)),
    Rule("invalid_json_ld", "P2", "SEO", 4, 1, lambda: any_of(c("known.blocks"), lambda j: F.try_parse_json(j).isNull())),
]

# -- content --------------------------------------------------------------------------------

DEPRECATED = ["center", "font", "marquee", "blink", "big", "strike", "tt"]


def stuffed() -> Column:
    k = c("dom.keyword")
    share = F.try_divide(k["n"], k["total"])
    return (k["total"] > 200) & (share > 0.08) & (c("dom.heading_text").contains(k["word"]) | (share > 0.20))


def levels() -> Column:
    return F.transform("headings", lambda h: h["level"])


def skips() -> Column:
    """Pairs of neighbouring headings that skip a level."""
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size("headings"), F.lit(2))), lambda i: F.struct(F.get(levels(), i - 2).alias("a"), F.get(levels(), i - 1).alias("b")))
    return F.filter(pairs, lambda p: p["b"] > p["a"] + 1)


def blank_alts() -> Column:
    return F.try_divide(F.size(F.filter("images", lambda i: blank(i["alt"]))) * 100.0, F.size("images"))


VISIBLE = ("hidden", "submit", "button", "reset", "image")
unlabelled = lambda: F.filter("dom.inputs", lambda i: ~i["type"].isin(*VISIBLE) & ~i["labelled"])

CONTENT: list[Rule] = [
    Rule("very_thin_content", "P1", "CONTENT", 5, 3, lambda: c("word_count") < 50, {"wordCount": lambda: c("word_count")}),
    Rule("thin_content", "P2", "CONTENT", 5, 3, lambda: (c("word_count") >= 50) & (c("word_count") < 300) & ~home(), {"wordCount": lambda: c("word_count")}),
    Rule("poor_readability", "P2", "CONTENT", 4, 4, lambda: (c("plain_words") >= 50) & (c("ease") < 30), {"score": lambda: text.round_half_up(c("ease"))}),
    Rule("difficult_readability", "P3", "CONTENT", 4, 4, lambda: (c("plain_words") >= 50) & (c("ease") >= 30) & (c("ease") < 50), {"score": lambda: text.round_half_up(c("ease"))}),
    Rule("missing_alt_text_majority", "P1", "CONTENT", 5, 2, lambda: (F.size("images") > 0) & (blank_alts() > 50), {"percentMissing": lambda: text.round_half_up(blank_alts())}),
    Rule("missing_alt_text", "P2", "CONTENT", 5, 2, lambda: (F.size("images") > 0) & (blank_alts() > 20) & (blank_alts() <= 50), {"percentMissing": lambda: text.round_half_up(blank_alts())}),
    Rule("heading_hierarchy_skip", "P2", "CONTENT", 5, 1, lambda: F.get(levels(), F.lit(0)) != 1, {"firstHeadingLevel": lambda: F.get(levels(), F.lit(0))}),
    Rule("multiple_h1", "P2", "CONTENT", 4, 1, lambda: F.size(F.filter("headings", lambda h: h["level"] == 1)) > 1, {"h1Count": lambda: F.size(F.filter("headings", lambda h: h["level"] == 1))}),
    Rule("heading_level_skip", "P3", "CONTENT", 3, 1, lambda: (F.size("headings") > 1) & (F.size(skips()) > 0), {"from": lambda: F.get(skips(), F.lit(0))["a"], "to": lambda: F.get(skips(), F.lit(0))["b"]}),
    Rule("keyword_stuffing", "P2", "CONTENT", 4, 3, stuffed, {"keyword": lambda: c("dom.keyword.word"), "occurrences": lambda: c("dom.keyword.n"), "totalWords": lambda: c("dom.keyword.total")}),
    Rule("deprecated_html_tags", "P3", "CONTENT", 2, 2, lambda: F.size(F.map_filter("dom.tag_counts", lambda k, _: k.isin(*DEPRECATED))) > 0, {"deprecated": lambda: F.map_filter("dom.tag_counts", lambda k, _: k.isin(*DEPRECATED))}),
    Rule("form_missing_labels", "P2", "ACCESSIBILITY", 4, 2, lambda: F.size(unlabelled()) > 0, {"count": lambda: F.size(unlabelled())}),
    Rule("iframe_missing_title", "P3", "ACCESSIBILITY", 3, 1, lambda: any_of(c("dom.iframes"), lambda i: blank(i["title"]))),
    Rule("empty_headings", "P2", "CONTENT", 3, 1, lambda: any_of(c("headings"), lambda h: blank(h["text"]))),
    Rule("low_text_ratio", "P3", "CONTENT", 2, 3, lambda: (F.length(html()) >= 500) & (F.try_divide(c("word_count") * 5, F.length(html())) < 0.05) & (c("word_count") > 20), {"wordCount": lambda: c("word_count")}),
    Rule("missing_lang_attribute", "P1", "ACCESSIBILITY", 5, 1, lambda: home() & (F.regexp_extract(html(), "(?i)<html[^>]*>", 0) != "") & ~F.regexp_extract(html(), "(?i)<html[^>]*>", 0).rlike(r"(?i)\blang\s*=\s*[\"'][a-z]")),
]

# -- trust ----------------------------------------------------------------------------------

anchor = lambda *parts: any_of(c("dom.anchors"), lambda a: F.coalesce(sum((F.contains(a["href"], F.lit(p)).cast("int") for p in parts), F.lit(0)) > 0, F.lit(False)))
LANDING = r"(?i)/(pricing|features|product|solutions|about)/?$"
AUTHOR_SCHEMA = r"(?i)author[\"']?\s*:\s*\{[^}]*[\"']?@type[\"']?\s*:\s*[\"']?Person"
# Parts of the addresses of trusted sources.
TRUSTED = [".gov", ".edu", ".org", "wikipedia.org", "scholar.google", "pubmed", "arxiv.org", "reuters.com", "bbc.com", "nytimes.com", "wsj.com", "nature.com", "sciencedirect.com", "researchgate.net"]
# Headers by which content delivery networks are known, in the order of the check.
CDN_HEADERS = {"Cloudflare": ["cf-ray", "cf-cache-status", "cf-request-id"], "Vercel": ["x-vercel-id", "x-vercel-cache"], "Netlify": ["x-nf-request-id"], "CloudFront": ["x-amz-cf-id", "x-amz-cf-pop"], "Fastly": ["x-served-by", "x-cache", "fastly-restarts"], "Akamai": ["x-akamai-transformed", "akamai-origin-hop"], "Bunny CDN": ["cdn-pullzone", "cdn-uid"], "KeyCDN": ["x-cache", "x-edge-location"]}


def cdn() -> Column:
    """The network that serves a page, by its headers; null if none is known."""
    found = None
    for name, keys in CDN_HEADERS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | (F.coalesce(header(k), F.lit("")) != "")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    server = F.lower(F.coalesce(header("server"), F.lit("")))
    for name in ("Cloudflare", "Netlify", "Vercel"):
        found = found.when(server.contains(name.lower()), name)
    return found


trusted = lambda: any_of(c("dom.external_links"), lambda x: sum((x.contains(t).cast("int") for t in TRUSTED), F.lit(0)) > 0)
author_any = lambda: pattern_meets(AUTHOR_SCHEMA) | flag("meta_author") | flag("rel_author") | flag("author_class") | flag("author_item")

TRUST: list[Rule] = [
    Rule("missing_author_info", "P2", "SEO", 4, 2, lambda: article() & ~author_any()),
    Rule("missing_author_schema", "P3", "SEO", 3, 2, lambda: article() & flag("author_class") & ~pattern_meets(AUTHOR_SCHEMA)),
    Rule("author_no_bio", "P3", "CONTENT", 3, 2, lambda: article() & ~flag("author_bio") & flag("author_name")),
    Rule("no_publication_date", "P2", "SEO", 3, 1, lambda: article() & ~flag("date_markup") & ~flag("published_meta")),
    Rule("missing_privacy_policy", "P3", "SEO", 3, 2, lambda: ~anchor("privacy") & ~urls.path(c("url")).rlike(r"(?i)/privacy(-policy)?$")),
    Rule("missing_contact_info", "P3", "SEO", 3, 1, lambda: ~anchor("contact", "mailto:") & ~any_of(c("dom.anchors"), lambda a: F.coalesce(a["href"].startswith("tel:"), F.lit(False))) & ~flag("contact_class") & ~flag("contact_text")),
    Rule("missing_organization_schema", "P3", "SEO", 3, 2, lambda: home() & ~pattern_meets(r"(?i)[\"']?@type[\"']?\s*:\s*[\"']?(Organization|LocalBusiness)[\"']?")),
    Rule("no_external_citations", "P3", "CONTENT", 2, 2, lambda: article() & (c("dom.content_words") > 1000) & (F.size("dom.external_links") == 0), {"wordCount": lambda: c("dom.content_words")}),
    Rule("no_authoritative_citations", "P3", "CONTENT", 2, 2, lambda: article() & (c("dom.content_words") > 1000) & (F.size("dom.external_links") > 0) & ~trusted(), {"externalLinkCount": lambda: F.size("dom.external_links")}),
    Rule("no_social_proof", "P3", "CONTENT", 3, 2, lambda: home() & ~flag("testimonials") & ~flag("logos") & ~flag("stats")),
    Rule("no_about_page_link", "P3", "SEO", 2, 2, lambda: home() & ~anchor("/about", "/company", "/team")),
    Rule("very_large_dom", "P1", "CONTENT", 5, 4, lambda: c("dom.node_count") > 3000, {"nodeCount": lambda: c("dom.node_count")}),
    Rule("large_dom", "P2", "CONTENT", 4, 3, lambda: (c("dom.node_count") > 1500) & (c("dom.node_count") <= 3000), {"nodeCount": lambda: c("dom.node_count")}),
    Rule("excessive_dom_depth", "P2", "CONTENT", 3, 3, lambda: c("dom.max_depth") > 32, {"maxDepth": lambda: c("dom.max_depth")}),
    Rule("no_cdn_detected", "P3", "CONTENT", 3, 3, lambda: home() & c("response_headers").isNotNull() & cdn().isNull()),
    Rule("no_http2", "P3", "CONTENT", 3, 2, lambda: (c("http_version") != "") & ~c("http_version").contains("2") & ~c("http_version").contains("3"), {"httpVersion": lambda: c("http_version")}),
    Rule("no_http3", "P3", "CONTENT", 2, 1, lambda: home() & c("http_version").contains("2") & ~c("http_version").contains("3"), {"httpVersion": lambda: c("http_version")}),
    Rule("no_web_manifest", "P3", "CONTENT", 2, 2, lambda: home() & ~flag("manifest")),
    Rule("missing_theme_color", "P3", "CONTENT", 1, 1, lambda: home() & flag("manifest") & ~flag("theme_color")),
    Rule("missing_apple_touch_icon", "P3", "CONTENT", 1, 1, lambda: home() & flag("manifest") & ~flag("touch_icon")),
    Rule("missing_faq_schema", "P2", "SEO", 4, 2, lambda: (flag("faq_class") | (F.regexp_count(html(), F.lit(r"(?i)\?\s*</h[2-4]>")) >= 3)) & ~pattern_meets("(?i)FAQPage")),
    Rule("missing_howto_schema", "P3", "SEO", 3, 2, lambda: flag("howto") & ~pattern_meets("(?i)HowTo")),
    Rule("missing_review_schema", "P3", "SEO", 3, 2, lambda: flag("reviews") & ~pattern_meets("(?i)Review|AggregateRating")),
    Rule("missing_breadcrumb_schema", "P3", "SEO", 2, 2, lambda: flag("breadcrumbs") & ~pattern_meets("(?i)BreadcrumbList")),
]

# -- readiness for answer engines -----------------------------------------------------------


def items() -> Column:
    """The top-level objects of all JSON-LD blocks that parse, as variants."""
    parsed = F.filter(F.transform("dom.jsonld", lambda j: F.try_parse_json(j)), lambda v: v.isNotNull())
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def item_types() -> Column:
    return F.transform(items(), lambda v: F.try_variant_get(v, "$[\"@type\"]", "string"))


def truthy(v: Column, key: str) -> Column:
    """Whether a member is there and neither null, false, 0 nor an empty string."""
    s = F.to_json(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.coalesce(~s.isin("null", "false", "0", '""'), F.lit(False))


ENTITY, ARTICLES = ("Organization", "LocalBusiness", "Corporation", "Person"), ("Article", "NewsArticle", "BlogPosting")
is_type = lambda v, names: F.coalesce(F.try_variant_get(v, "$[\"@type\"]", "string").isin(*names), F.lit(False))
has_item = lambda key: any_of(c("items"), lambda v: truthy(v, key))
of_type = lambda names: any_of(c("items"), lambda v: is_type(v, names))
same_as = lambda: any_of(c("items"), lambda v: is_type(v, ENTITY) & (F.coalesce(F.size(F.try_variant_get(v, "$.sameAs", "array<variant>")), F.lit(0)) > 0))
DEFINES = r"(?i)\b(?:is defined as|refers to|means that|is when)\b"
STATES = r"(?i)\b\d+(?:\.\d+)?%|\b(?:according to|study shows|research indicates|data shows)\b"

AI: list[Rule] = [
    Rule("no_structured_data", "P2", "SEO", 3, 2, lambda: has_text() & (F.size("dom.jsonld") == 0)),
    Rule("faq_content_no_schema", "P3", "SEO", 2, 2, lambda: flag("faq_headings") & ~of_type(("FAQPage", "Question", "HowTo"))),
    Rule("missing_author_attribution", "P3", "CONTENT", 2, 1, lambda: article() & ~has_item("author") & ~flag("meta_author")),
    Rule("missing_publish_date", "P3", "CONTENT", 2, 1, lambda: article() & ~has_item("datePublished") & ~has_item("dateCreated") & ~flag("published_meta") & ~flag("time_datetime")),
    Rule("weak_content_intro", "P3", "CONTENT", 2, 1, lambda: (F.coalesce(F.length("meta_description"), F.lit(0)) < 50) & (c("dom.intro_length") < 50), {"actual": lambda: c("dom.intro_length")}),
    Rule("low_citation_friendliness", "P3", "CONTENT", 2, 2, lambda: c("url").rlike("(?i)" + urls.ARTICLE) & (F.length("dom.paragraph_text") >= 500) & ~flag("numbered_list") & ~flag("bullet_list") & ~flag("blockquote") & ~c("dom.paragraph_text").rlike(DEFINES) & ~c("dom.paragraph_text").rlike(STATES)),
    Rule("missing_speakable_schema", "P3", "SEO", 2, 1, lambda: of_type(ARTICLES) & ~has_item("speakable")),
    Rule("missing_date_modified", "P3", "CONTENT", 2, 1, lambda: of_type(ARTICLES) & has_item("datePublished") & ~has_item("dateModified") & ~flag("modified_meta")),
    Rule("missing_brand_entity", "P2", "SEO", 4, 2, lambda: home() & ~of_type(ENTITY)),
    Rule("missing_entity_sameAs", "P3", "SEO", 2, 1, lambda: of_type(ENTITY) & ~same_as()),
    Rule("missing_og_description", "P3", "SEO", 1, 1, lambda: ~missing("meta_description")() & og("og:description").isNull()),
]

# -- images and resources -------------------------------------------------------------------

LEGACY, MODERN = r"(?i)\.(jpe?g|png|gif|bmp|tiff?)(\?|$)", r"(?i)\.(webp|avif)(\?|$)"
imgs = lambda test: F.filter("dom.imgs", test)
src = lambda i: F.coalesce(i["src"], F.lit(""))
srcset = lambda s: F.coalesce(s["srcset"], F.lit(""))


def formats() -> tuple[Column, Column]:
    """(legacy images, classified images)."""
    known = F.size(imgs(lambda i: src(i).rlike(LEGACY) | src(i).rlike(MODERN)))
    old = F.size(imgs(lambda i: src(i).rlike(LEGACY) & ~i["modern"]))
    sources = F.size(F.filter("dom.sources", lambda s: srcset(s).rlike(LEGACY) & ~s["modern"]))
    return old + sources, known + sources


def avif_webp() -> tuple[Column, Column]:
    is_avif = lambda s: F.coalesce(s["type"], F.lit("")).rlike("(?i)avif") | srcset(s).rlike(r"(?i)\.avif(\?|$)")
    is_webp = lambda s: F.coalesce(s["type"], F.lit("")).rlike("(?i)webp") | srcset(s).rlike(r"(?i)\.webp(\?|$)")
    avif = F.size(F.filter("dom.sources", is_avif)) + F.size(imgs(lambda i: src(i).rlike(r"(?i)\.avif(\?|$)")))
    webp = F.size(F.filter("dom.sources", lambda s: is_webp(s) & ~is_avif(s))) + F.size(imgs(lambda i: src(i).rlike(r"(?i)\.webp(\?|$)") & ~i["in_picture"]))
    return avif, webp


not_lazy = lambda: F.filter(F.slice("dom.imgs", 3, F.greatest(F.size("dom.imgs"), F.lit(1))), lambda i: F.coalesce(F.lower(i["loading"]), F.lit("")).isin("", "eager"))
oversized = lambda: F.slice(imgs(lambda i: F.coalesce(i["width"] > 2000, F.lit(False)) | F.coalesce(i["height"] > 2000, F.lit(False))), 1, 3)
no_size = lambda: imgs(lambda i: i["width"].isNull() & i["height"].isNull() & (F.coalesce(i["src"], i["data_src"], F.lit("")) != "") & ~F.coalesce(i["src"], i["data_src"]).startswith("data:"))

IMAGES: list[Rule] = [
    Rule("no_modern_image_format", "P2", "PERFORMANCE", 4, 2, lambda: (formats()[1] > 0) & (F.try_divide(formats()[0], formats()[1]) > 0.5), {"legacy": lambda: formats()[0], "total": lambda: formats()[1]}),
    Rule("avif_not_used", "P3", "PERFORMANCE", 2, 2, lambda: (avif_webp()[1] > 0) & (avif_webp()[0] == 0), {"webpCount": lambda: avif_webp()[1]}),
    Rule("missing_lazy_loading", "P2", "PERFORMANCE", 4, 1, lambda: (F.size("dom.imgs") > 2) & (F.size(not_lazy()) > 0), {"count": lambda: F.size(not_lazy())}),
    Rule("oversized_image", "P3", "PERFORMANCE", 3, 2, lambda: F.size(oversized()) > 0, {"count": lambda: F.size(oversized())}),
    Rule("missing_image_dimensions", "P3", "SEO", 4, 2, lambda: F.size(no_size()) > 0, {"count": lambda: F.size(no_size())}),
    Rule("no_responsive_images", "P3", "PERFORMANCE", 3, 3, lambda: (F.size("dom.imgs") > 0) & ~flag("picture") & ~flag("srcset"), {"count": lambda: F.size("dom.imgs")}),
    Rule("inline_svg_heavy", "P3", "PERFORMANCE", 3, 2, lambda: c("dom.svg_bytes") > 50_000, {"totalBytes": lambda: c("dom.svg_bytes")}),
]

rels = lambda test: F.filter("dom.rels", test)
blocking_css = lambda: rels(lambda r: r["in_head"] & (r["rel"] == "stylesheet") & F.lower(F.trim(F.coalesce(r["media"], F.lit("")))).isin("", "all"))
EXEMPT = r"(?i)/_next/|__next|__NEXT|__nuxt|nuxt\.js|chunks/framework|chunks/webpack"
blocking_js = lambda: F.filter("dom.scripts", lambda s: s["in_head"] & s["src"].isNotNull() & ~s["deferred"] & ~s["src"].rlike(EXEMPT))
requests = lambda: F.size(F.filter("dom.scripts", lambda s: s["src"].isNotNull())) + F.size(rels(lambda r: (r["rel"] == "stylesheet") & r["href"].isNotNull())) + F.size(imgs(lambda i: i["src"].isNotNull()))
faces = lambda: F.flatten(F.transform("dom.styles", lambda s: F.regexp_extract_all(s, F.lit(r"(?i)@font-face\s*\{[^}]*\}"), F.lit(0))))
bad_faces = lambda: F.size(F.filter(faces(), lambda f: ~f.rlike(r"(?i)font-display\s*:\s*(swap|optional|fallback)"))) + F.size(rels(lambda r: F.coalesce(r["href"].rlike(r"(?i)fonts\.googleapis\.com") & ~r["href"].rlike("(?i)[&?]display=swap"), F.lit(False))))
hero = lambda: F.get(imgs(lambda i: i["src"].isNotNull() & ~i["src"].startswith("data:") & ~i["src"].endswith(".svg") & ((F.coalesce(i["width"], F.lit(0)) >= 200) | (F.coalesce(i["height"], F.lit(0)) >= 200))), F.lit(0))["src"]
preloaded = lambda: any_of(c("dom.rels"), lambda r: (r["rel"] == "preload") & (r["as_"] == "image") & ((F.coalesce(r["href"], F.lit("")) == hero()) | F.contains(F.coalesce(r["imagesrcset"], F.lit("")), hero())))


def long_winded(code: Column) -> Column:
    trimmed = F.regexp_replace(code, r"^\s+|\s+$", "")
    lines = F.size(F.filter(F.split(trimmed, "\n"), lambda x: F.trim(x) != ""))
    return (F.length(trimmed) >= 500) & (lines > 0) & (F.try_divide(F.length(trimmed), lines) < 40)


inline = lambda: F.concat(F.transform(F.filter("dom.scripts", lambda s: s["src"].isNull() & (F.coalesce(s["id"], F.lit("")) != "__NEXT_DATA__") & ~F.coalesce(s["type"], F.lit("")).isin("application/json", "application/ld+json")), lambda s: s["text"]), c("dom.styles"))

RESOURCES: list[Rule] = [
    Rule("render_blocking_css", "P2", "PERFORMANCE", 4, 3, lambda: F.size(blocking_css()) > 3, {"count": lambda: F.size(blocking_css())}),
    Rule("render_blocking_js", "P2", "PERFORMANCE", 4, 2, lambda: F.size(blocking_js()) > 0, {"count": lambda: F.size(blocking_js())}),
    Rule("no_preload_hints", "P3", "PERFORMANCE", 2, 1, lambda: has_text() & ~flag("preload") & ~flag("preconnect")),
    Rule("lcp_image_not_preloaded", "P2", "PERFORMANCE", 4, 1, lambda: hero().isNotNull() & ~preloaded(), {"image": hero}),
    Rule("excessive_http_requests", "P2", "PERFORMANCE", 3, 3, lambda: requests() > 40, {"count": requests}),
    Rule("missing_font_display", "P3", "PERFORMANCE", 3, 1, lambda: bad_faces() > 0, {"count": bad_faces}),
    Rule("unminified_inline_code", "P3", "PERFORMANCE", 2, 2, lambda: any_of(inline(), long_winded)),
]

# -- security -------------------------------------------------------------------------------

# Response headers that every site should send.
HEADERS = [
    ("content-security-policy", "missing_csp", "P1", 4, 3), ("x-frame-options", "missing_x_frame_options", "P2", 3, 1), ("x-content-type-options", "missing_x_content_type_options", "P2", 3, 1),
    ("strict-transport-security", "missing_hsts", "P1", 4, 1), ("referrer-policy", "missing_referrer_policy", "P3", 2, 1), ("permissions-policy", "missing_permissions_policy", "P3", 2, 1),
    ("cross-origin-opener-policy", "missing_coop", "P3", 2, 1), ("cross-origin-embedder-policy", "missing_coep", "P3", 2, 2), ("cross-origin-resource-policy", "missing_corp", "P3", 2, 1),
]
csp = lambda: header("content-security-policy")
WILD = r"(default-src|script-src)[^;]*\s(\*|https?:\*?)([\s;]|\z)"


def cookies_without(word: str) -> Column:
    named = F.filter(F.slice(F.coalesce("cookies", F.array().cast("array<string>")), 1, 20), lambda x: F.trim(F.split(x, "=")[0]) != "")
    return F.transform(F.filter(named, lambda x: ~F.lower(x).contains(word)), lambda x: F.trim(F.split(x, "=")[0]))


insecure = lambda x: F.coalesce(x.startswith("http://"), F.lit(False))
mixed = lambda: c("url").startswith("https://") & (any_of(c("dom.imgs"), lambda i: insecure(i["src"])) | any_of(c("dom.scripts"), lambda s: insecure(s["src"])) | any_of(c("dom.rels"), lambda r: insecure(r["href"])) | any_of(c("dom.iframes"), lambda i: insecure(i["src"])))
no_opener = lambda: F.filter("dom.anchors", lambda a: F.coalesce(a["target"] == "_blank", F.lit(False)) & ~F.coalesce(a["rel"], F.lit("")).contains("noopener") & ~F.coalesce(a["rel"], F.lit("")).contains("noreferrer"))
no_sri = lambda: F.filter("dom.scripts", lambda s: F.coalesce(s["src"].startswith("http") & urls.is_url(s["src"]) & (urls.hostname(s["src"]) != urls.hostname(c("url"))), F.lit(False)) & (F.coalesce(s["integrity"], F.lit("")) == ""))

SECURITY: list[Rule] = [
    *(Rule(code, sev, "SECURITY", impact, effort, (lambda h: lambda: c("response_headers").isNotNull() & (F.coalesce(header(h), F.lit("")) == ""))(name), {"header": (lambda h: lambda: F.lit(h))(name)}) for name, code, sev, impact, effort in HEADERS),
    Rule("csp_unsafe_inline", "P1", "SECURITY", 4, 3, lambda: csp().contains("'unsafe-inline'"), {"actual": lambda: F.substring(csp(), 1, 200)}),
    Rule("csp_unsafe_eval", "P1", "SECURITY", 4, 3, lambda: csp().contains("'unsafe-eval'"), {"actual": lambda: F.substring(csp(), 1, 200)}),
    Rule("csp_wildcard_source", "P2", "SECURITY", 3, 2, lambda: csp().rlike(WILD), {"actual": lambda: F.substring(csp(), 1, 200)}),
    Rule("csp_data_uri_scripts", "P2", "SECURITY", 3, 2, lambda: F.regexp_extract(csp(), "script-src[^;]*", 0).contains("data:"), {"actual": lambda: F.substring(csp(), 1, 200)}),
    Rule("cookie_missing_secure", "P1", "SECURITY", 4, 1, lambda: F.size(cookies_without("secure")) > 0, {"cookies": lambda: F.slice(cookies_without("secure"), 1, 5)}),
    Rule("cookie_missing_httponly", "P2", "SECURITY", 3, 1, lambda: F.size(cookies_without("httponly")) > 0, {"cookies": lambda: F.slice(cookies_without("httponly"), 1, 5)}),
    Rule("cookie_missing_samesite", "P3", "SECURITY", 2, 1, lambda: F.size(cookies_without("samesite")) > 0, {"cookies": lambda: F.slice(cookies_without("samesite"), 1, 5)}),
    Rule("mixed_content", "P1", "SECURITY", 4, 2, mixed),
    Rule("missing_noopener", "P3", "SECURITY", 2, 1, lambda: F.size(no_opener()) > 0, {"count": lambda: F.size(no_opener())}),
    Rule("external_script_missing_sri", "P3", "SECURITY", 3, 2, lambda: F.size(no_sri()) > 0, {"count": lambda: F.size(no_sri())}),
]

# -- client-side rendering ------------------------------------------------------------------

mount = lambda: pattern_meets(r"<div\s+id=[\"'](root|app|__next|__nuxt|__svelte)[\"']")
bundle = lambda: pattern_meets(r"(?i)\b(react|vue|angular|svelte)\b") | pattern_meets(r"\b(chunk|bundle)\.\w+\.js\b")
indicators = lambda: mount().cast("int") + bundle().cast("int")


def body_length() -> Column:
    body = F.regexp_extract(html(), r"(?is)<body[^>]*>(.*?)</body>", 1)
    bare = text.without_tags(text.without_scripts(body, ""), "")
    return F.length(F.regexp_replace(bare, r"^\s+|\s+$", ""))


client = lambda: ((indicators() >= 2) & (F.coalesce("word_count", F.lit(0)) < 100)) | ((body_length() < 200) & (indicators() >= 1))
#: One of these words, in lower case, is in every match of a framework's pattern.
WORDS = {"react": ("react", "next"), "vue": ("vue", "nuxt"), "angular": ("angular", "zone.js", "ng-version"), "svelte": ("svelte",)}
holds = lambda low, words: sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0


def frameworks() -> Column:
    made = lambda low: F.filter(F.array(*(F.when(holds(low, WORDS[name]) & pattern_meets(rx), name) for name, rx in FRAMEWORKS.items())), lambda x: x.isNotNull())
    return text.let(F.lower(html()), made)




def above_fold() -> Column:
    """The first three content images, by their tags."""
    attr = lambda t, name: F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)
    side = lambda t, name: F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*[\"'](\d+)[\"']", 1).try_cast("long")
    real = lambda t: (attr(t, "src") != "") & ~attr(t, "src").startswith("data:") & ~attr(t, "src").rlike("(?i)icon|logo|pixel|beacon|sprite|favicon") & ~attr(t, "src").endswith(".svg") & (F.coalesce(side(t, "width"), F.lit(50)) >= 50) & (F.coalesce(side(t, "height"), F.lit(50)) >= 50)
    return F.slice(F.filter(F.regexp_extract_all(html(), F.lit(r"(?i)<img\s[^>]*>"), F.lit(0)), real), 1, 3)


lazy_first = lambda: F.filter(above_fold(), lambda t: t.rlike(r"(?i)\bloading\s*=\s*[\"']lazy[\"']"))
noscripts = lambda: F.regexp_extract_all(html(), F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), F.lit(1))
script_links = lambda: F.filter(F.transform(F.regexp_extract_all(html(), F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>"), F.lit(1)), lambda x: F.trim(x)), lambda h: h.isin("#", "", "#!", "#/") | F.lower(h).startswith("javascript:"))

RENDERING: list[Rule] = [
    Rule("spa_rendering", "P2", "SEO", 4, 4, client, {"bodyTextLength": body_length}),
    Rule("js_framework_detected", "P3", "SEO", 2, 3, lambda: F.size(frameworks()) > 0, {"frameworks": frameworks}),
    Rule("lazy_load_above_fold", "P2", "PERFORMANCE", 4, 1, lambda: F.size(lazy_first()) > 0, {"count": lambda: F.size(lazy_first())}),
    Rule("noscript_fallback_missing", "P2", "SEO", 3, 2, lambda: client() & ~any_of(noscripts(), lambda n: F.length(F.regexp_replace(F.regexp_replace(n, "<[^>]+>", ""), r"^\s+|\s+$", "")) > 100)),
    Rule("client_side_links", "P3", "SEO", 2, 2, lambda: F.size(script_links()) > 0, {"count": lambda: F.size(script_links())}),
]

# -- measured by the acquisition ------------------------------------------------------------

MEASURED: list[Rule] = [
    Rule("slow_server_response", "P1", "PERFORMANCE", 4, 3, lambda: c("ttfb_ms") > 2000, {"ttfbMs": lambda: c("ttfb_ms")}),
    Rule("moderate_server_response", "P2", "PERFORMANCE", 3, 3, lambda: (c("ttfb_ms") > 800) & (c("ttfb_ms") <= 2000), {"ttfbMs": lambda: c("ttfb_ms")}),
    Rule("js_console_errors", lambda: F.when(F.size("console_errors") >= 5, "P1").otherwise("P2"), "PERFORMANCE", 4, 3, lambda: F.size("console_errors") > 0, {"errorCount": lambda: F.size("console_errors")}),
]

#: All page rules in the order in which issues are listed, and so win over later copies.
PER_PAGE = SEO + LINK_TEXT + CONTENT + TRUST + AI + IMAGES + RESOURCES + MEASURED
#: Rules for one page of a scan: the first good one, and the first one.
FIRST_GOOD, FIRST = SECURITY, RENDERING


def prepare(pages: DataFrame) -> DataFrame:
    """Adds what several rules share: reading ease and JSON-LD items."""
    shared = pages.withColumn("plain", text.plain(html()))
    # Between the words of a plain text stands one space.
    counted = shared.withColumn("plain_words", F.length("plain") - F.length(F.replace(c("plain"), F.lit(" "), F.lit(""))) + 1)
    # No rule judges the ease of texts of under 50 words.
    return counted.withColumns({"ease": F.when(c("plain_words") >= 50, text.reading_ease(c("plain"), c("plain_words"))), "items": items()}).drop("plain")


def titles(code: Column) -> Column:
    """A readable name of a code."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
