"""Links: broken ones, redirect chains, error pages, the link graph and click depths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.issues import rows, union
from siteloom.plans.lineage import cut
from siteloom.sources.pages import once

c = F.col
#: Links of a scan that are checked: the first internal and external ones.
CHECK_INTERNAL, CHECK_EXTERNAL = 100, 20
DEEP, FEW_IN, MANY_OUT = 3, 2, 100
#: Links that one task sorts, on average.
LINKS_A_TASK = 300_000


def links(pages: DataFrame) -> DataFrame:
    """(scan_id, seq, pos, source_url, href, text, is_internal): one row for each link."""
    out = pages.select("scan_id", "seq", c("url").alias("source_url"), F.posexplode("links").alias("pos", "x"))
    return out.select("scan_id", "seq", "pos", "source_url", "x.*")


def unique_links(all_links: DataFrame) -> DataFrame:
    """One row for each href of a scan: where it stood first, with the values it had last."""
    at = F.struct("seq", "pos")
    one = all_links.groupBy("scan_id", "href").agg(F.min(at).alias("first"), F.max_by(F.struct("text", "is_internal"), at).alias("x"))
    return one.select("scan_id", "href", "first", "x.text", "x.is_internal")


def sampled(unique: DataFrame) -> DataFrame:
    """The links that a scan checks, in order of their first appearance. Each limit is a constant,
    so Spark keeps that many rows of a scan before it shuffles, and sorts no more in one task."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("first"))
    top = lambda rows, most: rows.withColumn("rank", rank).where(c("rank") <= most)
    return top(unique.where("is_internal"), CHECK_INTERNAL).unionByName(top(unique.where("NOT is_internal"), CHECK_EXTERNAL))


def checked(unique: DataFrame, status: DataFrame) -> DataFrame:
    """Sampled links with their status (href, status_code, error, chain); see with_sources()."""
    return sampled(unique).join(status.select("href", "status_code", "error", "chain"), "href")


def is_broken():
    return (c("status_code") == 0) | (c("status_code") >= 400)


def with_sources(found: DataFrame, all_links: DataFrame) -> DataFrame:
    """Adds found_on: the pages that link to a broken or redirected target, by first link."""
    # As many tasks as the links need: by the size of what is shuffled, Spark would make a few large ones.
    tasks = max(all_links.sparkSession.sparkContext.defaultParallelism, -(-all_links.count() // LINKS_A_TASK))
    found, all_links = (x.repartition(tasks, "scan_id", "href") for x in (found, all_links.where(c("source_url") != "").select("scan_id", "href", "source_url", "seq", "pos")))
    found = cut(found)  # several branches read both
    wanted = found.where(is_broken() | (F.size("chain") >= 3)).select("scan_id", "href")
    pages = all_links.join(wanted, ["scan_id", "href"], "left_semi").groupBy("scan_id", "href", "source_url").agg(F.min(F.struct("seq", "pos")).alias("at"))
    lists = pages.groupBy("scan_id", "href").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_url"))), lambda x: x["source_url"]).alias("found_on"))  # a site's pages at most
    return found.join(cut(lists), ["scan_id", "href"], "left")


def broken_issues(found: DataFrame) -> DataFrame:
    bad = found.where(is_broken())
    soft = ~c("is_internal") & c("status_code").isin(403, 0)
    severity = F.when(soft, "P3").when(c("status_code") == 404, "P1").otherwise("P2")
    return rows(bad, "broken-links", "broken_link", severity, "LINKS", F.when(soft, 2).otherwise(4), 1, c("href"), c("rank"), {"httpStatus": c("status_code"), "error": c("error"), "linkText": c("text"), "foundOnPages": c("found_on")})


def chain_issues(found: DataFrame) -> DataFrame:
    """Redirects over two hops or more; the chain lists every address."""
    long = found.where(F.size("chain") >= 3)
    return rows(long, "broken-links", "redirect_chain", "P2", "LINKS", 3, 1, c("href"), c("rank"), {"finalUrl": F.element_at("chain", -1), "hops": F.size("chain") - 1, "foundOnPages": c("found_on")}, pos=1)


def resolve_redirects(redirects: DataFrame, max_hops: int = 5) -> DataFrame:
    """(href, chain, looped): redirects (href, target) followed for up to max_hops turns."""
    now = redirects.select("href", F.array("href", "target").alias("chain"))
    step = redirects.select(c("href").alias("from_"), c("target").alias("to_"))
    for _ in range(max_hops - 1):
        met = now.join(step, F.element_at("chain", -1) == c("from_"), "left")
        grow = c("to_").isNotNull() & ~F.array_contains("chain", c("to_"))
        now = met.select("href", F.when(grow, F.concat("chain", F.array("to_"))).otherwise(c("chain")).alias("chain"))
    return now.join(step, F.element_at("chain", -1) == c("from_"), "left").select("href", "chain", c("to_").isNotNull().alias("looped"))


def error_page_issues(pages: DataFrame, all_links: DataFrame) -> DataFrame:
    """Crawled error pages that some page links to."""
    bad = pages.where("status_code >= 400 OR (status_code = 0 AND error IS NOT NULL)").select("scan_id", "seq", "url", "status_code", "error")
    sources = all_links.groupBy("scan_id", "href").agg(F.count_distinct("source_url").alias("sources"))
    met = bad.join(sources, (bad["scan_id"] == sources["scan_id"]) & (bad["url"] == sources["href"])).drop(sources["scan_id"])
    return rows(met, "error-page-links", "internal_link_to_error_page", F.when(c("status_code") == 404, "P1").otherwise("P2"), "LINKS", 4, 1, c("url"), c("seq"), {"httpStatus": c("status_code"), "linkedFrom": c("sources")})


# -- the graph ------------------------------------------------------------------------------


def nodes(pages: DataFrame) -> DataFrame:
    """(scan_id, node, seq): crawled pages by their graph address, with the first seq."""
    return pages.select("scan_id", "seq", once(urls.for_graph(c("url"))).alias("node")).where("node IS NOT NULL").groupBy("scan_id", "node").agg(F.min("seq").alias("seq"))


def homes(pages: DataFrame) -> DataFrame:
    """(scan_id, home, base_host): the first page of each scan."""
    first = pages.groupBy("scan_id").agg(F.min_by("url", "seq").alias("u"))
    return first.select("scan_id", urls.for_graph(c("u")).alias("home"), urls.hostname(c("u")).alias("base_host"))


def edges(all_links: DataFrame, home: DataFrame) -> DataFrame:
    """(scan_id, src, dst): distinct links inside a scan's host, without loops. Hosts are
    compared as they are; targets need not be crawled."""
    named = all_links.join(home.select("scan_id", "base_host"), "scan_id").select("scan_id", "base_host", "source_url", "href", once(urls.hostname(c("href"))).alias("host"))
    own = named.where("host = base_host").select("scan_id", "source_url", "href").distinct()
    pairs = own.select("scan_id", once(F.struct(urls.for_graph(c("source_url")).alias("src"), urls.for_graph(c("href")).alias("dst"))).alias("x")).select("scan_id", "x.*")
    return pairs.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def degrees(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """(scan_id, node, seq, in_degree, out_degree); edges are distinct, so plain counts do."""
    into = graph_edges.groupBy("scan_id", c("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = graph_edges.groupBy("scan_id", c("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    return graph_nodes.join(into, ["scan_id", "node"], "left").join(out, ["scan_id", "node"], "left").fillna(0, ["in_degree", "out_degree"])


def click_depths(graph_nodes: DataFrame, graph_edges: DataFrame, home: DataFrame) -> DataFrame:
    """(scan_id, node, depth, crawled): shortest paths from the home page for all scans at once,
    level by level until no page is new; uncrawled targets get a depth but lead nowhere."""
    crawled = graph_nodes.select("scan_id", "node")
    start = home.select("scan_id", c("home").alias("node")).join(crawled, ["scan_id", "node"], "left_semi")
    seen = cut(start.select("scan_id", "node", F.lit(0).alias("depth")))
    frontier = seen
    for depth in count(1):
        there = frontier.select("scan_id", c("node").alias("src")).join(graph_edges, ["scan_id", "src"]).select("scan_id", c("dst").alias("node")).distinct()
        fresh = cut(there.join(seen, ["scan_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if depth % 10 == 0:  # a long chain's plan stays short
            seen = cut(seen)
        frontier = fresh.join(crawled, ["scan_id", "node"], "left_semi")
    return seen.join(crawled.withColumn("crawled", F.lit(True)), ["scan_id", "node"], "left").fillna(False, ["crawled"])


def graph_issues(degree: DataFrame, depths: DataFrame, home: DataFrame) -> DataFrame:
    """Orphans, deep pages, pages with one inbound link, and with too many or no links."""
    other = degree.join(home.select("scan_id", "home"), "scan_id").where(F.coalesce(c("node") != c("home"), F.lit(True)))
    make = lambda df, code, sev, impact, effort, pos, evidence: rows(df, "internal-linking", code, sev, "SEO", impact, effort, c("node"), c("seq"), evidence, pos)
    deep = depths.where(c("depth") > DEEP).withColumn("seq", F.lit(0).cast("long"))
    return union([
        make(other.where("in_degree = 0"), "orphan_page", "P1", 4, 2, 0, {}),
        make(deep, "deep_page", "P2", 3, 2, 1, {"depth": c("depth"), "crawled": c("crawled")}),
        make(other.where((c("in_degree") > 0) & (c("in_degree") < FEW_IN)), "low_internal_links", "P2", 3, 2, 2, {"inbound": c("in_degree")}),
        make(degree.where(c("out_degree") > MANY_OUT), "excessive_outgoing_links", "P3", 2, 3, 3, {"outgoing": c("out_degree")}),
        make(degree.where("out_degree = 0"), "no_outgoing_internal_links", "P2", 3, 1, 4, {}),
    ])


def crawl_map(pages: DataFrame, all_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the map of a crawl: internal links between crawled pages, without loops
    and repeats; a node's radius grows with its share of the most inbound links."""
    at = pages.select("scan_id", "seq", "url", "status_code", urls.for_map(c("url")).alias("key"))
    first = at.groupBy("scan_id", "key").agg(F.min_by(F.struct("seq", "url", "status_code"), "seq").alias("x")).select("scan_id", "key", "x.*")
    keys = first.select("scan_id", "key")
    pairs = all_links.where("is_internal").select("scan_id", urls.for_map(c("source_url")).alias("src"), urls.for_map(c("href")).alias("dst")).where("src <> dst").distinct()
    known = pairs.join(keys.withColumnRenamed("key", "src"), ["scan_id", "src"], "left_semi").join(keys.withColumnRenamed("key", "dst"), ["scan_id", "dst"], "left_semi")
    inbound = known.groupBy("scan_id", c("dst").alias("key")).agg(F.count(F.lit(1)).alias("inbound"))
    counted = first.join(inbound, ["scan_id", "key"], "left").fillna(0, ["inbound"])
    most = counted.groupBy("scan_id").agg(F.greatest(F.lit(1).cast("long"), F.max("inbound")).alias("most"))
    radius = F.when(urls.is_homepage(c("url")), 20.0).otherwise(6 + 14 * c("inbound") / c("most"))
    return counted.join(most, "scan_id").withColumns({"radius": radius, "label": urls.shorten(c("url")), "colour": urls.status_colour(c("status_code"))}).drop("most"), known
