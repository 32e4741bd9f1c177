"""Issue rows: building, ordering, de-duplication, advice by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["scan_id", "phase", "seq", "pos", "code", "severity", "category", "impact", "effort", "url", "evidence"]
#: Phases of an audit in the order in which their issues are listed.
PHASES = ["crawl", "seo", "content", "eeat", "ai-readiness", "images", "resources", "security", "robots-sitemap", "tech-duplicates", "internal-linking", "compression", "sitemap-xref", "ttfb", "console-errors", "broken-links", "error-page-links", "accessibility", "performance", "service-worker"]


def rows(df: DataFrame, phase: str, code, severity, category: str, impact, effort: int, url: Column, seq: Column | None = None, evidence: dict[str, Column] | None = None, pos: int = 0) -> DataFrame:
    """Issue rows from the rows of df, which has scan_id."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = F.to_json(F.struct(url.alias("url"), *(v.alias(k) for k, v in (evidence or {}).items())))
    return df.select(
        "scan_id", F.lit(PHASES.index(phase)).alias("phase"), (F.lit(0).cast("long") if seq is None else seq.cast("long")).alias("seq"), F.lit(pos).alias("pos"),
        lit(code).alias("code"), lit(severity).alias("severity"), F.lit(category).alias("category"), lit(impact).cast("int").alias("impact"), F.lit(effort).alias("effort"), url.alias("url"), shown.alias("evidence"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """All issues; duplicates stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def place() -> Column:
    """Where an issue stands in its scan's list."""
    return F.struct("phase", "seq", "pos", "url", "evidence")


def dedupe(issues: DataFrame) -> DataFrame:
    """The first issue of each code and url in a scan. The first is a minimum, so it is taken
    before the shuffle; nothing is sorted."""
    keys = [c for c in issues.columns if c not in ("scan_id", "code")]
    first = issues.groupBy("scan_id", "code", F.coalesce("url", F.lit("")).alias("at")).agg(F.min_by(F.struct(*keys), place()).alias("x"))
    return first.select("scan_id", "code", "x.*").select(*issues.columns)


def placed(issues: DataFrame) -> DataFrame:
    """Adds n, the issue's place in its scan: a struct to order by. Numbers would take a sort of
    each scan in one task."""
    return issues.withColumn("n", F.struct("phase", "seq", "pos", "code", F.coalesce("url", F.lit("")).alias("at")))


# Codes for which a platform has advice of its own.
ADVICE_CODES = {
    "WordPress": "missing_meta_description missing_title no_structured_data missing_viewport missing_lang_attribute missing_llms_txt missing_organization_schema large_dom no_cdn_detected missing_h1",
    "Shopify": "missing_meta_description missing_title no_structured_data missing_viewport missing_llms_txt missing_organization_schema large_dom missing_h1",
    "Webflow": "missing_meta_description missing_title no_structured_data missing_viewport missing_llms_txt missing_organization_schema large_dom missing_h1",
    "Next.js": "missing_meta_description missing_title no_structured_data missing_viewport missing_llms_txt large_dom missing_h1",
    "Wix": "missing_meta_description missing_title no_structured_data missing_llms_txt large_dom missing_h1",
    "Squarespace": "missing_meta_description missing_title no_structured_data missing_llms_txt large_dom missing_h1",
}


def advice(issues: DataFrame, technologies: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds advice_platform: the first detected platform with advice for the code. The advice
    table has a fixed size, so it is broadcast. Where texts (name, code, advice: a table of the
    same kind) are given, the column fix of an issue that has one gets the platform's advice."""
    spark = issues.sparkSession
    table = spark.createDataFrame([(p, c) for p, codes in ADVICE_CODES.items() for c in codes.split()], "name string, code string")
    known = technologies.select("scan_id", "name", F.col("pos").alias("rank")).join(F.broadcast(table), "name")
    best = known.groupBy("scan_id", "code").agg(F.min_by("name", "rank").alias("advice_platform"))
    out = issues.join(best, ["scan_id", "code"], "left")
    if texts is None:
        return out
    told = out.join(texts.select(F.col("name").alias("advice_platform"), "code", "advice"), ["advice_platform", "code"], "left")
    more = F.concat("fix", F.lit("\n\n**"), "advice_platform", F.lit(":** "), "advice")
    return told.withColumn("fix", F.coalesce(more, "fix")).select(*out.columns)
