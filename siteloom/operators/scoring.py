"""Scores: categories, overall, performance-independent summary, top issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.labels import severity_rank
from siteloom.functions.text import round_half_up

c = F.col
PENALTY = {"P0": 20, "P1": 8, "P2": 3, "P3": 1}
OTHER_PENALTY = 3
#: Categories with their weight in the overall score; terms are added in this order.
WEIGHTS = {"SEO": 0.25, "ACCESSIBILITY": 0.2, "PERFORMANCE": 0.15, "LINKS": 0.1, "CONTENT": 0.1, "SECURITY": 0.2}


def by_code(issues: DataFrame, order: Column | str = "n") -> DataFrame:
    """(scan_id, category, code, severity, n): issues of a code, with the severity seen first."""
    return issues.groupBy("scan_id", "category", "code").agg(F.min_by("severity", order).alias("severity"), F.count(F.lit(1)).alias("n"))


def penalty(severity: Column, n: Column) -> Column:
    """A code's base penalty, and up to 3 more for its repeats (whole binary logarithms)."""
    base = F.lit(OTHER_PENALTY)
    for name, value in PENALTY.items():
        base = F.when(severity == name, value).otherwise(base)
    return base + F.when(n <= 1, 0).when(n == 2, 1).when(n <= 4, 2).otherwise(3)


def score_of(raw: Column) -> Column:
    return F.greatest(F.lit(0), 100 - round_half_up(100 * (1 - F.exp(-raw / F.lit(80.0)))))


def category_scores(issues: DataFrame, order: Column | str = "n") -> DataFrame:
    """(scan_id, category, raw, score) of the categories that have issues."""
    raw = by_code(issues, order).groupBy("scan_id", "category").agg(F.sum(penalty(c("severity"), c("n"))).alias("raw"))
    return raw.withColumn("score", score_of(c("raw")))


def overall(scores: DataFrame) -> DataFrame:
    """(scan_id, a column for each category, overall); a category without issues has 100."""
    wide = scores.groupBy("scan_id").pivot("category", list(WEIGHTS)).agg(F.first("score"))
    wide = wide.select("scan_id", *(F.coalesce(k, F.lit(100)).cast("int").alias(k.lower()) for k in WEIGHTS))
    total = None
    for k, w in WEIGHTS.items():
        total = c(k.lower()) * F.lit(w) if total is None else total + c(k.lower()) * F.lit(w)
    return wide.withColumn("overall", round_half_up(total))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("scan_id").agg(*(F.count_if(c("severity") == s).alias(s.lower()) for s in PENALTY))


def top_issues(issues: DataFrame, limit: int = 10, order: Column | str = "n") -> DataFrame:
    """The codes of each scan by severity, then count, then first appearance; limit of them."""
    from pyspark.sql import Window

    grouped = issues.groupBy("scan_id", "code").agg(F.min_by("severity", order).alias("severity"), F.min_by("category", order).alias("category"), F.count(F.lit(1)).alias("count"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(severity_rank(c("severity")), F.desc("count"), "first"))
    return grouped.withColumn("rank", rank).where(c("rank") <= limit).drop("first")


def summary(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a scan: counts, scores, pages, social preview of the first page. Scans without
    issues have full scores."""
    scans = pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("pages"), F.min_by(F.struct("og_tags", "favicon"), "seq").alias("x"))
    scores = overall(category_scores(issues))
    out = scans.join(scores, "scan_id", "left").join(severity_counts(issues), "scan_id", "left")
    filled = out.fillna(100, [k.lower() for k in WEIGHTS] + ["overall"]).fillna(0, [s.lower() for s in PENALTY])
    tag = lambda k: c("x.og_tags")[k]
    names = {"og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "og_site_name": "og:site_name", "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_image": "twitter:image"}
    return filled.withColumn("social_preview", F.struct(*(tag(v).alias(k) for k, v in names.items()), c("x.favicon").alias("favicon"))).drop("x")
