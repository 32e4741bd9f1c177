"""Site-level inputs that an acquisition stores: files of a site, and probes of it.

site_files: (scan_id, path, ok BOOLEAN, status INT, body STRING); a path that could not be
fetched at all has no row (checks stay silent then). site_probe: one row a scan with http_status,
http_location, cert_valid_to, content_encoding, content_type, sw_supported, sw_active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls

SITE_FILES = "scan_id string, path string, ok boolean, status int, body string"
SITE_PROBE = "scan_id string, url string, http_status int, http_location string, cert_valid_to timestamp, content_encoding string, content_type string, sw_supported boolean, sw_active boolean"

#: Agents whose robots groups apply to the audit.
AGENTS = r"googlebot|bingbot"


def robots_rules(files: DataFrame) -> DataFrame:
    """(scan_id, pos, agent, rule): robots.txt lines, each with the agent named before it."""
    from pyspark.sql import Window

    lines = files.where("path = '/robots.txt' AND ok").select("scan_id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lower = F.lower(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    named = lines.select("scan_id", "pos", "line", lower.alias("rule"), F.when(lower.startswith("user-agent:"), F.trim(F.substr(lower, F.lit(12)))).alias("ua"))
    before = Window.partitionBy("scan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return named.select("scan_id", "pos", "line", "rule", F.coalesce(F.last("ua", ignorenulls=True).over(before), F.lit("")).alias("agent"))


def disallow_patterns(files: DataFrame) -> DataFrame:
    """(scan_id, disallow): distinct patterns in order; a bare slash is left out, and a pattern
    ends at a second colon."""
    own = F.col("agent").isin("*", "") | F.col("agent").rlike(AGENTS)
    pattern = F.trim(F.regexp_replace(F.get(F.split("line", ":"), F.lit(1)), r"^\s+|\s+$", ""))
    found = robots_rules(files).where(F.col("rule").startswith("disallow:") & own).select("scan_id", "pos", pattern.alias("p")).where("p <> '' AND p <> '/'")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])
    return found.groupBy("scan_id").agg(F.array_distinct(listed).alias("disallow"))


def sitemap(files: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, origin, found, urls): the first candidate that is a sitemap; one that robots.txt
    names comes first. Index files are not followed."""
    robots = files.where("path = '/robots.txt' AND ok").select("scan_id", F.nullif(F.trim(F.regexp_extract("body", r"(?im)^Sitemap:\s*(.+)$", 1)), F.lit("")).alias("named"))
    wanted = scans.select("scan_id", "origin").join(robots, "scan_id", "left")
    rank = F.when(F.col("path") == F.col("named"), 0).when(F.col("path").isin("/sitemap.xml", F.concat("origin", F.lit("/sitemap.xml"))), 1).when(F.col("path").isin("/sitemap_index.xml", F.concat("origin", F.lit("/sitemap_index.xml"))), 2)
    fits = F.col("ok") & (F.col("body").contains("<urlset") | F.col("body").contains("<sitemapindex"))
    candidates = wanted.join(files, "scan_id").withColumn("rank", rank).where(F.col("rank").isNotNull() & fits)
    best = candidates.groupBy("scan_id").agg(F.min_by("body", "rank").alias("body"))
    locs = F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u)), lambda u: u != "")
    return wanted.select("scan_id", "origin").join(best, "scan_id", "left").select("scan_id", "origin", F.col("body").isNotNull().alias("found"), F.coalesce(locs, F.array().cast("array<string>")).alias("urls"))


def scans_of(pages: DataFrame) -> DataFrame:
    """(scan_id, home_url, origin): the first page of each scan."""
    first = pages.groupBy("scan_id").agg(F.min_by("url", "seq").alias("home_url"))
    return first.select("scan_id", "home_url", urls.origin(F.col("home_url")).alias("origin"))


def days_left(valid_to: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(valid_to) - F.unix_micros(now)) / 86_400_000_000)
