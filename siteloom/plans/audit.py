"""A whole audit as one plan: parse each page once, evaluate the rules, compare pages, add what
an acquisition measured, de-duplicate, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators import crosspage, issues, links, rules, scoring, sitechecks, technology
from siteloom.plans.lineage import cut
from siteloom.sources import pages as P
from siteloom.sources import site

c = F.col
#: Page rules of each phase, in order.
RULES = {"seo": rules.SEO + rules.LINK_TEXT, "content": rules.CONTENT, "eeat": rules.TRUST, "ai-readiness": rules.AI, "images": rules.IMAGES, "resources": rules.RESOURCES}


def page_issues(parsed: DataFrame) -> DataFrame:
    """Issues of all page rules, in one projection over the parsed pages."""
    ready = rules.prepare(parsed.where(P.is_html()))
    every = [r for rs in RULES.values() for r in rs] + rules.MEASURED
    bounds, at = [], 0
    for phase, rs in RULES.items():
        at += len(rs)
        bounds.append((at, issues.PHASES.index(phase)))
    phase = F.lit(issues.PHASES.index("console-errors"))
    phase = F.when(c("code").isin("slow_server_response", "moderate_server_response"), issues.PHASES.index("ttfb")).otherwise(phase)
    for end, index in reversed(bounds):
        phase = F.when(c("pos") < end, index).otherwise(phase)
    return rules.evaluate(ready, every).withColumn("phase", phase).withColumn("seq", c("seq").cast("long")).select(*issues.COLUMNS)


def first_page_issues(parsed: DataFrame) -> DataFrame:
    """Security rules on the first good page of a scan, rendering rules on its first page."""
    keep = [k for k in parsed.columns if k not in ("scan_id", "seq")]
    pick = lambda df: df.groupBy("scan_id").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*keep), "seq").alias("x")).select("scan_id", "seq", "x.*")
    good = rules.evaluate(pick(parsed.where(P.is_html() & P.is_success())), rules.FIRST_GOOD).withColumn("phase", F.lit(issues.PHASES.index("security")))
    first = rules.evaluate(pick(parsed), rules.FIRST).withColumn("phase", F.lit(issues.PHASES.index("tech-duplicates"))).withColumn("pos", c("pos") - 100)
    return good.unionByName(first).withColumn("seq", c("seq").cast("long")).select(*issues.COLUMNS)


def with_robots(pages: DataFrame, files: DataFrame | None) -> DataFrame:
    """Adds disallow, the robots patterns of each page's site."""
    if files is None:
        return pages.withColumn("disallow", F.array().cast("array<string>"))
    return pages.join(site.disallow_patterns(files), "scan_id", "left").withColumn("disallow", F.coalesce("disallow", F.array().cast("array<string>")))


def all_issues(parsed: DataFrame, files: DataFrame | None = None, probe: DataFrame | None = None, status: DataFrame | None = None, perf: DataFrame | None = None, a11y: DataFrame | None = None, completed: DataFrame | None = None, max_pages: int = 50, now=None) -> DataFrame:
    """Every issue of parsed pages and of the acquisition tables that are given."""
    parsed = with_robots(P.complete(parsed), files)
    scans = site.scans_of(parsed)
    held = links.links(parsed)
    home = cut(links.homes(parsed))
    node, edge = cut(links.nodes(parsed)), cut(links.edges(held, home))  # read once for each level of depth
    parts = [
        page_issues(parsed),
        first_page_issues(parsed),
        crosspage.duplicate_issues(parsed),
        crosspage.similarity_issues(parsed),
        crosspage.hreflang_issues(parsed),
        links.graph_issues(links.degrees(node, edge), links.click_depths(node, edge, home), home),
        links.error_page_issues(parsed, held),
    ]
    if files is not None:
        parts += [sitechecks.file_issues(files, scans), crosspage.sitemap_issues(parsed, site.sitemap(files, scans), scans, max_pages)]
    if status is not None:
        checked = links.with_sources(links.checked(links.unique_links(held), status), held)
        parts += [links.broken_issues(checked), links.chain_issues(checked), crosspage.target_issues(parsed, status)]
    if probe is not None:
        parts += [sitechecks.probe_issues(probe, now), sitechecks.service_worker_issues(probe, parts[0])]
    if perf is not None:
        parts.append(sitechecks.performance_issues(perf))
    if a11y is not None:
        parts.append(sitechecks.accessibility_issues(a11y))
    if completed is not None:
        parts.append(sitechecks.timeout_issues(completed))
    return issues.union(parts)


def audit(parsed: DataFrame, **tables) -> dict[str, DataFrame]:
    """issues (de-duplicated, with their places and platform advice), technologies and summary. parsed
    should be stored or cached: several branches read it."""
    found = issues.placed(issues.dedupe(all_issues(parsed, **tables)))
    tech = technology.detect(P.complete(parsed))
    return {"issues": issues.advice(found, tech), "technologies": tech, "summary": scoring.summary(found, parsed)}
