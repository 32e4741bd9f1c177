"""The frontier of a crawl over stored pages: which of them a crawl of a site would have read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.plans.lineage import cut

c = F.col


def crawl(links: DataFrame, starts: DataFrame, max_pages: int = 50, max_depth: int = 5) -> DataFrame:
    """(scan_id, url, depth, place): breadth first from starts (scan_id, url), all sites at once.
    links: (scan_id, source_url, pos, href, is_internal). Addresses are compared without tracking
    parameters and fragments; excluded ones are not read. A site's frontier ends at max_pages."""
    clean = lambda u: F.regexp_replace(urls.strip_tracking(u), "#.*$", "")
    step = links.where("is_internal").select("scan_id", clean(c("source_url")).alias("from_"), clean(c("href")).alias("url"), "pos").where(~urls.is_excluded(c("url")))
    step = cut(step.groupBy("scan_id", "from_", "url").agg(F.min("pos").alias("pos")))
    seen = cut(starts.select("scan_id", clean(c("url")).alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")).distinct())
    now = seen
    for depth in range(1, max_depth + 1):
        met = now.select("scan_id", c("url").alias("from_"), c("place").alias("at")).join(step, ["scan_id", "from_"])
        fresh = met.groupBy("scan_id", "url").agg(F.min(F.struct("at", "pos")).alias("first")).join(seen.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
        held = seen.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
        order = F.row_number().over(Window.partitionBy("scan_id").orderBy("first", "url"))
        placed = fresh.join(held, "scan_id").withColumn("place", (c("n") + order - 1).cast("long")).where(c("place") < max_pages)
        now = cut(placed.select("scan_id", "url", F.lit(depth).alias("depth"), "place"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen


def health(spark) -> DataFrame:
    """One row if the session answers."""
    return spark.sql("SELECT 1 AS ok")
