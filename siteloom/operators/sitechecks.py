"""Checks of a site as a whole: robots.txt, sitemap, llms.txt, security.txt, redirects,
certificate, compression, and what the acquisition measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import labels, urls
from siteloom.operators.issues import PHASES, rows, union
from siteloom.sources import site

c = F.col
# Crawlers of answer engines, by their robots.txt names.
AI_AGENTS = ["GPTBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Google-Extended", "CCBot"]
# Content types that are text.
TEXT_TYPES = ["text/html", "text/css", "text/javascript", "application/javascript", "application/json", "application/xml", "text/xml", "image/svg+xml", "text/plain"]
# Accessibility rules that WCAG 2.2 added.
WCAG22 = {"focus-not-obscured-minimum": "2.4.11", "focus-not-obscured-enhanced": "2.4.12", "target-size-minimum": "2.5.8", "target-size-enhanced": "2.5.5", "dragging-movements": "2.5.7"}


def file_issues(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Checks of robots.txt, sitemap, llms.txt and security.txt. scans: (scan_id, origin)."""
    at = lambda path: files.where(c("path") == path).join(scans.select("scan_id", "origin"), "scan_id").withColumn("u", F.concat("origin", "path"))
    robots, llms, security = at("/robots.txt"), at("/llms.txt"), at("/.well-known/security.txt")
    lines = F.transform(F.split("body", "\n"), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    blocks = c("body").contains("Disallow: /") & ~c("body").contains("Allow:") & F.array_contains(lines, F.lit("disallow: /")) & ~F.exists(lines, lambda x: x.startswith("allow:"))
    maps = site.sitemap(files, scans).withColumn("u", F.concat("origin", F.lit("/sitemap.xml")))
    agents = site.robots_rules(files).where(c("rule").isin("disallow: /", "disallow: /*") & c("agent").isin(*(a.lower() for a in AI_AGENTS)))
    blocked = agents.groupBy("scan_id").agg(F.count_distinct("agent").alias("bots")).join(scans.select("scan_id", "origin"), "scan_id").withColumn("u", F.concat("origin", F.lit("/robots.txt")))
    make = lambda df, code, sev, impact, effort, pos, evidence=None, phase="robots-sitemap", category="SEO": rows(df, phase, code, sev, category, impact, effort, c("u"), None, evidence, pos)
    return union([
        make(robots.where("NOT ok"), "missing_robots_txt", "P2", 3, 1, 0),
        make(robots.where(c("ok") & blocks), "robots_blocks_all", "P0", 5, 1, 1, {"snippet": F.substring("body", 1, 200)}),
        make(robots.where(c("ok") & ~F.lower("body").contains("sitemap:")), "robots_no_sitemap_ref", "P3", 2, 1, 2),
        make(maps.where("NOT found"), "missing_sitemap", "P2", 3, 2, 3),
        make(maps.where(c("found") & (F.size("urls") == 0)), "empty_sitemap", "P2", 3, 2, 4),
        make(llms.where(~c("ok") | (F.trim("body") == "")), "missing_llms_txt", "P3", 1, 1, 5, phase="ai-readiness"),
        make(blocked, "ai_crawlers_blocked", F.when(c("bots") >= 3, "P2").otherwise("P3"), F.when(c("bots") >= 3, 4).otherwise(2), 1, 6, {"bots": c("bots")}, phase="ai-readiness"),
        make(security.where("NOT ok"), "missing_security_txt", "P3", 1, 1, 7, phase="security", category="SECURITY"),
    ])


def probe_issues(probe: DataFrame, now: Column | None = None) -> DataFrame:
    """Checks of a site's probes; those of the certificate only with a time to compare with."""
    secure = probe.where(c("url").startswith("https://"))
    plain = F.regexp_replace(urls.origin(c("url")), "^https:", "http:")
    moved = c("http_status").isin(301, 302, 307, 308)
    kind, how = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.coalesce("content_encoding", F.lit("")))
    is_text = F.lit(False)
    for t in TEXT_TYPES:
        is_text = is_text | kind.contains(t)
    out = [
        rows(secure.where("http_status = 200"), "security", "no_https_redirect", "P1", "SECURITY", 5, 1, plain, pos=8),
        rows(secure.where(moved & ~F.coalesce(c("http_location"), F.lit("")).startswith("https://")), "security", "http_redirect_not_https", "P2", "SECURITY", 4, 1, plain, evidence={"actual": c("http_location")}, pos=9),
        rows(probe.where(is_text & ~how.rlike("gzip|br|deflate")), "compression", "no_compression", "P2", "PERFORMANCE", 4, 1, c("url"), evidence={"contentType": c("content_type")}),
    ]
    if now is not None:
        dated = secure.withColumn("days", site.days_left(c("cert_valid_to"), now))
        for pos, (code, sev, impact, test) in enumerate([("certificate_expired", "P0", 5, "days < 0"), ("certificate_expiring_critical", "P0", 5, "days BETWEEN 0 AND 7"), ("certificate_expiring_soon", "P2", 4, "days BETWEEN 8 AND 30")]):
            out.append(rows(dated.where(test), "security", code, sev, "SECURITY", impact, 1, c("url"), evidence={"daysRemaining": c("days")}, pos=10 + pos))
    return union(out)


def service_worker_issues(probe: DataFrame, issues: DataFrame) -> DataFrame:
    """Home pages with a manifest but no active service worker."""
    bare = issues.where("code = 'no_web_manifest'").select("scan_id").distinct()
    idle = probe.where(c("sw_supported") & ~c("sw_active") & urls.is_homepage(c("url"))).join(bare, "scan_id", "left_anti")
    return rows(idle, "service-worker", "no_service_worker", "P3", "CONTENT", 2, 3, c("url"))


def performance_score(fcp: Column, lcp: Column, cls: Column, inp: Column, load: Column) -> Column:
    """100 less the steps of five measures, 0 at least; unmeasured ones cost nothing."""
    step = lambda x, high, a, low, b: F.coalesce(F.when(x > high, a).when(x > low, b), F.lit(0))
    lost = step(fcp, 3000, 30, 1800, 15) + step(lcp, 4000, 30, 2500, 15) + step(cls, 0.25, 20, 0.1, 10) + step(inp, 500, 20, 200, 10) + step(load, 5000, 20, 3000, 10)
    return F.greatest(F.lit(0), 100 - lost)


#: (code, severity, impact, effort, test), for each viewport.
MEASURES = {
    "desktop": [
        ("slow_fcp", "P1", 4, 3, "fcp > 3000"), ("needs_improvement_fcp", "P2", 3, 2, "fcp > 1800 AND fcp <= 3000"), ("slow_lcp", "P1", 5, 3, "lcp > 4000"), ("needs_improvement_lcp", "P2", 4, 2, "lcp > 2500 AND lcp <= 4000"),
        ("missing_lcp_preload", "P2", 3, 1, "lcp > 2000 AND lcp_src IS NOT NULL"), ("poor_cls", "P1", 4, 2, "cls > 0.25"), ("needs_improvement_cls", "P2", 3, 2, "cls > 0.1 AND cls <= 0.25"),
        ("slow_inp", "P1", 4, 3, "inp > 500"), ("moderate_inp", "P2", 3, 2, "inp > 200 AND inp <= 500"), ("slow_load", "P2", 3, 3, "load > 5000"),
    ],
    "mobile": [("mobile_slow_fcp", "P1", 4, 3, "fcp > 3000"), ("mobile_slow_lcp", "P1", 5, 3, "lcp > 4000"), ("mobile_poor_cls", "P1", 4, 2, "cls > 0.25"), ("mobile_slow_inp", "P1", 4, 3, "inp > 500"), ("mobile_slow_load", "P2", 3, 3, "load > 8000")],
}


def performance_issues(perf: DataFrame) -> DataFrame:
    """perf: (scan_id, seq, url, viewport, fcp, lcp, cls, inp, load, lcp_src). One pass: the
    measures of a page become an array of codes."""
    tests = [F.when((c("viewport") == v) & F.expr(test), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("sev"), F.lit(i).alias("imp"), F.lit(e).alias("eff"))) for v, ms in MEASURES.items() for code, sev, i, e, test in ms]
    hit = perf.select("*", F.posexplode(F.array(*tests)).alias("at", "m")).where("m IS NOT NULL")
    made = rows(hit, "performance", c("m.code"), c("m.sev"), "PERFORMANCE", c("m.imp"), 0, c("url"), c("seq"), {"fcp": c("fcp"), "lcp": c("lcp"), "cls": c("cls"), "inp": c("inp"), "load": c("load")})
    efforts = F.create_map(*(x for ms in MEASURES.values() for code, _, _, e, _ in ms for x in (F.lit(code), F.lit(e))))
    return made.withColumn("effort", efforts[c("code")])


def accessibility_issues(a11y: DataFrame, pages: int = 5) -> DataFrame:
    """a11y: (scan_id, seq, url, viewport, violations ARRAY<STRUCT<id, impact, help>>). Desktop
    results of the first pages, and mobile ones of the first page that no desktop page has."""
    seen = a11y.where((c("viewport") == "desktop") & (c("seq") < pages)).select("scan_id", "seq", "url", F.posexplode("violations").alias("p", "v"))
    wcag = F.create_map(*(x for k, v in WCAG22.items() for x in (F.lit(k), F.lit(v))))
    make = lambda df, code, pos: rows(df, "accessibility", code, labels.impact_severity(c("v.impact")), "ACCESSIBILITY", labels.impact_score(c("v.impact")), 2, c("url"), c("seq"), {"help": c("v.help"), "wcag22": wcag[c("v.id")]}, pos)
    mobile = a11y.where((c("viewport") == "mobile") & (c("seq") == 0)).select("scan_id", "seq", "url", F.posexplode("violations").alias("p", "v"))
    known = seen.select("scan_id", c("v.id").alias("rule")).distinct()
    fresh = mobile.withColumn("rule", c("v.id")).join(known, ["scan_id", "rule"], "left_anti")
    return make(seen, F.concat(F.lit("a11y_"), c("v.id")), 0).unionByName(make(fresh, F.concat(F.lit("a11y_mobile_"), c("v.id")), 1))


def shift_sources(entries: DataFrame) -> DataFrame:
    """(scan_id, url, element, shift): entries (scan_id, url, value, sources) share a layout
    shift equally among their sources; the five largest of each page."""
    from pyspark.sql import Window

    parts = entries.select("scan_id", "url", F.explode("sources").alias("element"), (c("value") / F.size("sources")).alias("part"))
    summed = parts.groupBy("scan_id", "url", "element").agg(F.sum("part").alias("shift"))
    rank = F.row_number().over(Window.partitionBy("scan_id", "url").orderBy(F.desc("shift"), "element"))
    return summed.withColumn("rank", rank).where("rank <= 5").drop("rank")


def slowest_interactions(entries: DataFrame) -> DataFrame:
    """(scan_id, url, duration, element): the longest interaction of each page. entries:
    (scan_id, url, duration, element)."""
    worst = entries.groupBy("scan_id", "url").agg(F.max("duration").alias("duration"), F.max_by("element", F.struct("duration", "element")).alias("element"))
    return worst


def timeout_issues(completed: DataFrame) -> DataFrame:
    """completed: (scan_id, url, phases ARRAY). Scans that left out a phase."""
    skipped = F.array_except(F.array(*(F.lit(p) for p in PHASES)), c("phases"))
    late = completed.withColumn("skipped", skipped).where(F.size("skipped") > 0)
    return rows(late, "service-worker", "scan_timeout_partial", "P3", "PERFORMANCE", 1, 1, F.lit(None).cast("string"), evidence={"skipped": c("skipped")}, pos=99)
