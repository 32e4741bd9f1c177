"""Checks that compare pages: duplicates, similar content, hreflang, shared images and canonical
addresses, and the sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text, urls
from siteloom.operators import rules, similar
from siteloom.operators.issues import rows, union
from siteloom.plans.lineage import cut
from siteloom.sources.pages import is_success, once

c = F.col


def duplicate_groups(pages: DataFrame, column: str) -> DataFrame:
    """(scan_id, key, pages, seq, url): values that several fetched pages share (trimmed, lower
    case), with the first page."""
    key = F.lower(F.trim(c(column)))
    held = pages.where(is_success() & (F.coalesce(key, F.lit("")) != "")).select("scan_id", "seq", "url", key.alias("key"))
    grouped = held.groupBy("scan_id", "key").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("seq", "url")).alias("x"))
    return grouped.where("pages > 1").select("scan_id", "key", "pages", "x.*")


def duplicate_issues(pages: DataFrame) -> DataFrame:
    make = lambda col, code, impact, pos: rows(duplicate_groups(pages, col), "tech-duplicates", code, "P2", "SEO", impact, 2, c("url"), c("seq"), {"pages": c("pages"), "shared": c("key")}, pos)
    return make("title", "duplicate_title", 3, 0).unionByName(make("meta_description", "duplicate_meta_description", 2, 1))


# -- similar content ------------------------------------------------------------------------

MIN_WORDS, MIN_TEXT_WORDS, SIMILAR, SAME = 50, 30, 0.7, 0.9


def comparable(raw: Column) -> Column:
    """Lower case, only word characters and single spaces."""
    return F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9_]+", " "))


def contents(pages: DataFrame) -> DataFrame:
    """(scan_id, seq, url, base, text, shingles): the pages long enough to compare; shingles as hashes."""
    body = comparable(c("dom.main_text"))
    made = pages.where(c("error").isNull() & (c("word_count") > MIN_WORDS)).select("scan_id", "seq", "url", once(body).alias("text"))
    base = F.regexp_replace(F.regexp_replace(F.split("url", r"\?")[0], r"/page/\d+", ""), r"/\d+$", "")
    return made.where(F.size(F.split("text", " ")) > MIN_TEXT_WORDS).select("scan_id", "seq", "url", base.alias("base"), "text", text.shingle_hashes(c("text")).alias("shingles"))


def similar_pairs(docs: DataFrame, threshold: float, group: str = "scan_id", key: str = "seq") -> DataFrame:
    """All pairs of similar texts, copies among them; see similar.expanded()."""
    return similar.expanded(similar.similar(docs, threshold, group, key))


def similarity_issues(pages: DataFrame) -> DataFrame:
    """For each page the first later page of another base address that is its duplicate, and the
    first that is merely similar: of an issue's code and page, an audit keeps the first only."""
    docs = cut(contents(pages))
    if len(docs.take(2)) < 2:  # nothing to compare, as on sites of short pages
        partners = docs.limit(0).select("scan_id", "seq", F.lit(True).alias("same"), c("seq").alias("partner"), F.lit(1.0).alias("similarity"))
    else:
        partners = similar.first_partners(similar.similar(docs, SIMILAR), docs.select("scan_id", "seq", "base"), SAME)
    left, right = docs.select("scan_id", "seq", "url", c("text").alias("text_a")), docs.select("scan_id", c("seq").alias("partner"), c("url").alias("other"), c("text").alias("text_b"))
    met = partners.join(left, ["scan_id", "seq"]).join(right, ["scan_id", "partner"])
    same = c("same")
    evidence = {"similarUrl": c("other"), "similarity": text.round_half_up(c("similarity") * 100), "sharedContent": text.shared_snippet(c("text_a"), c("text_b"))}
    return rows(met, "tech-duplicates", F.when(same, "duplicate_content").otherwise("high_content_similarity"), F.when(same, "P2").otherwise("P3"), "SEO", F.when(same, 4).otherwise(2), 2, c("url"), c("seq"), evidence, 2)


# -- hreflang -------------------------------------------------------------------------------


def hreflang_issues(pages: DataFrame) -> DataFrame:
    """Pages that don't name themselves, and alternates that don't link back."""
    tags = F.filter(rules.hreflang_tags(), lambda t: t["href"] != "")
    held = pages.where("error IS NULL AND html IS NOT NULL").select("scan_id", "seq", "url", tags.alias("tags")).where(F.size("tags") > 0).withColumn("key", urls.for_hreflang(c("url")))
    page = held.groupBy("scan_id", "key").agg(F.max_by(F.struct("seq", "url", "tags"), "seq").alias("x")).select("scan_id", "key", "x.*")
    alone = page.where(~F.exists("tags", lambda t: urls.for_hreflang(t["href"]) == c("key")))
    refs = page.select("scan_id", "key", "seq", "url", F.posexplode("tags").alias("pos", "t")).withColumn("target", urls.for_hreflang(c("t.href"))).where("target <> key")
    known = page.select("scan_id", c("key").alias("target"), F.lit(True).alias("known"))
    back = refs.select("scan_id", c("key").alias("target"), c("target").alias("key"), F.lit(True).alias("back")).distinct()
    met = refs.join(known, ["scan_id", "target"], "left").join(back, ["scan_id", "key", "target"], "left")
    same_host = urls.is_url(c("t.href")) & (urls.hostname(c("t.href")) == urls.hostname(c("url")))
    one_way = met.where((c("known").isNull() & same_host) | (c("known") & c("back").isNull()))
    evidence = {"lang": c("t.lang"), "href": c("t.href"), "targetHasTags": F.coalesce("known", F.lit(False))}
    return rows(alone, "tech-duplicates", "hreflang_missing_self", "P2", "SEO", 3, 1, c("url"), c("seq"), {"tags": F.size("tags")}, 3).unionByName(
        rows(one_way, "tech-duplicates", "hreflang_not_bidirectional", "P2", "SEO", 3, 2, c("url"), c("seq"), evidence, 4)
    )


# -- shared targets -------------------------------------------------------------------------


def target_issues(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Social images and canonical addresses that don't resolve, once for each distinct address
    on the first page that has it. status: (href, status_code, error, content_type)."""
    good = pages.where("error IS NULL")
    images = good.select("scan_id", "seq", "url", F.explode(F.array(rules.og("og:image"), rules.og("twitter:image"))).alias("href"))
    canonical = good.select("scan_id", "seq", "url", c("canonical").alias("href"))
    first = lambda df: df.where(c("href").startswith("http")).groupBy("scan_id", "href").agg(F.min(F.struct("seq", "url")).alias("x")).select("scan_id", "href", "x.*")
    told = status.select("href", "status_code", "content_type")
    bad = F.coalesce(c("status_code"), F.lit(0)).isin(0) | (c("status_code") >= 400)
    im, ca = first(images).join(told, "href"), first(canonical).join(told, "href")
    make = lambda df, code, sev, impact, pos, extra: rows(df, "tech-duplicates", code, sev, "SEO", impact, 1, c("url"), c("seq"), {"target": c("href"), **extra}, pos)
    return union([
        make(im.where(bad), "og_image_broken", "P1", 4, 5, {"httpStatus": c("status_code")}),
        make(im.where(~bad & ~F.coalesce(c("content_type"), F.lit("")).startswith("image/")), "og_image_not_image", "P2", 3, 6, {"contentType": c("content_type")}),
        make(ca.where(bad), "canonical_url_broken", "P1", 5, 7, {"httpStatus": c("status_code")}),
    ])


# -- sitemap --------------------------------------------------------------------------------


def sitemap_issues(pages: DataFrame, sitemaps: DataFrame, home: DataFrame, max_pages: int = 50) -> DataFrame:
    """Sitemap addresses that are broken or weren't reached, and pages that no sitemap names.
    sitemaps: (scan_id, urls ARRAY); home: (scan_id, home_url)."""
    listed = sitemaps.where(F.size("urls") > 0).select("scan_id", F.size("urls").alias("total"), F.posexplode("urls").alias("pos_", "sm")).withColumn("key", urls.for_compare(c("sm")))
    crawled = pages.select("scan_id", "seq", "url", "status_code", "error", urls.for_compare(c("url")).alias("key"))
    last = crawled.groupBy("scan_id", "key").agg(F.max_by(F.struct("seq", "url", "status_code"), "seq").alias("x")).select("scan_id", "key", "x.*")
    broken = listed.join(last, ["scan_id", "key"]).where("status_code >= 400")
    lost = listed.where(c("total") <= 3 * max_pages).join(last.select("scan_id", "key"), ["scan_id", "key"], "left_anti")
    good = crawled.where(is_success()).join(home.select("scan_id", urls.for_compare(c("home_url")).alias("home_key")), "scan_id").where("key <> home_key")
    with_map = listed.select("scan_id").distinct()
    unlisted = good.join(with_map, "scan_id", "left_semi").join(listed.select("scan_id", "key").distinct(), ["scan_id", "key"], "left_anti")
    return union([
        rows(broken, "sitemap-xref", "sitemap_url_broken", "P1", "SEO", 4, 1, c("url"), c("pos_"), {"httpStatus": c("status_code"), "sitemapUrl": c("sm")}, 0),
        rows(lost, "sitemap-xref", "sitemap_url_not_crawled", "P2", "SEO", 3, 1, c("sm"), c("pos_"), {}, 1),
        rows(unlisted, "sitemap-xref", "page_not_in_sitemap", "P3", "SEO", 2, 1, c("url"), c("seq"), {}, 2),
    ])
