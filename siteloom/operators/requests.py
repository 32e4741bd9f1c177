"""Requests for scans: defaults, bounds, normal form of the address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls

c = F.col
# Bounds and defaults of the settings of a scan and of its alerts.
MAX_PAGES, MAX_DEPTH, SCORE_DROP = (1, 2000, 50), (1, 10, 5), (1, 100, 5)
SCREENSHOTS = ["none", "above-fold", "full-page"]
FREQUENCIES = ["DAILY", "WEEKLY", "MONTHLY"]


def validated(requests: DataFrame) -> DataFrame:
    """requests: (url, max_pages, max_depth, include_performance, screenshot_mode), settings may
    be null. Adds normalized_url, the settings with defaults, and problems (codes; empty if the
    request is good)."""
    within = lambda name, b: c(name).isNull() | c(name).between(b[0], b[1])
    normal = urls.normalize(c("url"))
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "missing_url").when(normal.isNull(), "invalid_url").when(~urls.is_safe(normal), "unsafe_url"),
            F.when(~within("max_pages", MAX_PAGES), "max_pages"),
            F.when(~within("max_depth", MAX_DEPTH), "max_depth"),
            F.when(c("screenshot_mode").isNotNull() & ~c("screenshot_mode").isin(SCREENSHOTS), "screenshot_mode"),
        )
    )
    return requests.select(
        "url",
        normal.alias("normalized_url"),
        F.coalesce("max_pages", F.lit(MAX_PAGES[2])).alias("max_pages"),
        F.coalesce("max_depth", F.lit(MAX_DEPTH[2])).alias("max_depth"),
        F.coalesce("include_performance", F.lit(True)).alias("include_performance"),
        F.coalesce("screenshot_mode", F.lit("none")).alias("screenshot_mode"),
        problems.alias("problems"),
    )


def alerts(settings: DataFrame) -> DataFrame:
    """Alert settings with defaults: score_drop (kept in its bounds) and on_new_p0."""
    drop = F.least(F.lit(SCORE_DROP[1]), F.greatest(F.lit(SCORE_DROP[0]), F.coalesce("score_drop", F.lit(SCORE_DROP[2]))))
    return settings.withColumns({"score_drop": drop, "on_new_p0": F.coalesce("on_new_p0", F.lit(True))})
