"""Queries that a report asks of the issues of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.labels import effort as effort_label
from siteloom.functions.labels import severity_rank

c = F.col
# What a missing answer-engine signal costs, and the weights of the first fix.
AI_PENALTY = {"no_structured_data": 30, "ai_crawlers_blocked": 25, "missing_brand_entity": 20, "missing_llms_txt": 12, "faq_content_no_schema": 8, "missing_author_attribution": 8, "low_citation_friendliness": 8, "missing_entity_sameAs": 5, "missing_publish_date": 5, "missing_date_modified": 3, "weak_content_intro": 3, "missing_speakable_schema": 3, "missing_og_description": 2}
FIX_WEIGHT = {"P0": 100, "P1": 40, "P2": 15, "P3": 5}
CHECKLIST = {
    "structured_data": ["no_structured_data"], "brand_entity": ["missing_brand_entity"], "crawlers_allowed": ["ai_crawlers_blocked"], "llms_txt": ["missing_llms_txt"],
    "faq_schema": ["faq_content_no_schema"], "author": ["missing_author_attribution"], "answer_ready": ["low_citation_friendliness"], "fresh": ["missing_date_modified", "missing_publish_date"],
}


def _case(key: Column, values: dict, rest) -> Column:
    out = F.lit(rest)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def ai_visibility(issues: DataFrame) -> DataFrame:
    """(scan_id, score, a flag for each point of the checklist)."""
    return issues.groupBy("scan_id").agg(
        F.greatest(F.lit(0), F.lit(100) - sum((F.max(F.when(c("code") == k, v).otherwise(0)) for k, v in AI_PENALTY.items()), F.lit(0))).alias("score"),
        *(F.bool_and(~c("code").isin(*codes)).alias(name) for name, codes in CHECKLIST.items()),
    )


def fix_first(issues: DataFrame) -> DataFrame:
    """The issue of each scan with the best ratio of weighted impact to effort, the first among
    equals."""
    ratio = _case(c("severity"), FIX_WEIGHT, 5) * F.coalesce("impact", F.lit(3)) / F.coalesce("effort", F.lit(3))
    keys = [k for k in issues.columns if k != "scan_id"]
    return issues.groupBy("scan_id").agg(F.min_by(F.struct(*keys), F.struct((-ratio).alias("ratio"), "n")).alias("x"), F.max(ratio).alias("ratio")).select("scan_id", "ratio", "x.*")


def quick_wins(issues: DataFrame, limit: int = 5) -> DataFrame:
    """Easy issues that matter: by impact, then effort, then place."""
    easy = issues.where((c("effort") <= 2) & c("severity").isin("P0", "P1", "P2"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc(F.coalesce("impact", F.lit(0))), F.coalesce("effort", F.lit(0)), "n"))
    return easy.withColumn("rank", rank).where(c("rank") <= limit)


def worst(issues: DataFrame, limit: int = 5) -> DataFrame:
    """The issues of a scan by severity, then impact, then place."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(severity_rank(c("severity")), F.desc(F.coalesce("impact", F.lit(0))), "n"))
    return issues.withColumn("rank", rank).where(c("rank") <= limit)


def worst_category(issues: DataFrame) -> DataFrame:
    """(scan_id, category, n): most critical issues; the category seen first among equals."""
    bad = issues.where(c("severity").isin("P0", "P1")).groupBy("scan_id", "category").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("first"))
    best = F.struct((-c("count")).alias("count"), "first")
    return bad.groupBy("scan_id").agg(F.min_by("category", best).alias("category"), F.max("count").alias("count"))


def by_page(issues: DataFrame) -> DataFrame:
    """(scan_id, page, issues, critical); issues without an address are "General"."""
    page = F.coalesce(F.nullif("url", F.lit("")), F.lit("General"))
    return issues.groupBy("scan_id", page.alias("page")).agg(F.count(F.lit(1)).alias("issues"), F.count_if(c("severity").isin("P0", "P1")).alias("critical"))


def search(issues: DataFrame, term: str = "", category: str | None = None, severity: str | None = None, title: Column | None = None) -> DataFrame:
    """Issues whose title or code holds the term, of a category and severity."""
    from siteloom.operators.rules import titles

    shown, t = F.lower(titles(c("code")) if title is None else title), F.lit(term.lower())
    out = issues.where(F.contains(shown, t) | F.contains(F.lower("code"), t))
    out = out.where(c("category") == category) if category else out
    return out.where(c("severity") == severity) if severity else out


def executive_summary(summary: DataFrame, issues: DataFrame) -> DataFrame:
    """(scan_id, text): score, critical issues and the first thing to fix, in three sentences."""
    from siteloom.operators.rules import titles

    worst_of = worst_category(issues).select("scan_id", c("category").alias("worst"))
    first = fix_first(issues).select("scan_id", titles(c("code")).alias("fix"), F.lower(effort_label(F.coalesce("effort", F.lit(3)))).alias("how"))
    s = summary.join(worst_of, "scan_id", "left").join(first, "scan_id", "left")
    score, critical = c("overall"), c("p0") + c("p1")
    band = F.when(score >= 90, "is in excellent health").when(score >= 70, "is in good shape").when(score >= 50, "needs work in several places").otherwise("has serious problems")
    head = F.format_string("The site %s (%d of 100).", band, score)
    mid = F.when(critical == 0, "It has no critical issues.").otherwise(F.concat(F.lit("It has "), critical.cast("string"), F.lit(" critical or high-priority "), F.when(critical == 1, "issue").otherwise("issues"), F.coalesce(F.concat(F.lit(", most of them in "), F.lower("worst")), F.lit("")), F.lit(".")))
    end = F.when(c("fix").isNull(), "Review the list of issues.").otherwise(F.concat(F.lit("Start with: "), c("fix"), F.lit(" ("), c("how"), F.lit(" to fix).")))
    return s.select("scan_id", F.concat_ws(" ", head, mid, end).alias("text"))


def by_severity(issues: DataFrame) -> DataFrame:
    """(scan_id, severity, issues): counts of the severities that occur, as a print groups them."""
    return issues.groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


def sort_by_category(issues: DataFrame) -> DataFrame:
    """Issues by category in the order of a dictionary, then by place."""
    return issues.orderBy(F.collate("category", "UNICODE"), "scan_id", "n")


def listed(issues: DataFrame) -> DataFrame:
    """Issues by severity, then place."""
    return issues.orderBy("scan_id", severity_rank(c("severity")), "n")
