"""Page snapshots: the schema of a crawled page, and the parse that fills it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions import urls
from siteloom.plans.lineage import spread
from siteloom.sources import dom, fields

_LINK = "struct<href: string, text: string, is_internal: boolean>"
DOM = (
    "struct<node_count: int, max_depth: int, tag_counts: map<string, int>, "
    "anchors: array<struct<href: string, target: string, rel: string>>, "
    "imgs: array<struct<src: string, data_src: string, width: long, height: long, loading: string, in_picture: boolean, modern: boolean>>, "
    "sources: array<struct<type: string, srcset: string, modern: boolean>>, "
    "scripts: array<struct<src: string, type: string, id: string, deferred: boolean, integrity: string, in_head: boolean, text: string>>, "
    "rels: array<struct<rel: string, href: string, media: string, as_: string, imagesrcset: string, in_head: boolean>>, "
    "styles: array<string>, iframes: array<struct<src: string, title: string>>, "
    "inputs: array<struct<type: string, name: string, labelled: boolean>>, jsonld: array<string>, svg_bytes: long, "
    "interstitials: array<string>, content_words: int, external_links: array<string>, paragraph_text: string, "
    "intro_length: int, heading_text: string, keyword: struct<word: string, n: int, total: int>, main_text: string, flags: map<string, boolean>>"
)
#: Columns that the parse fills.
PARSED = {
    "title": "string", "meta_description": "string", "h1": "string", "canonical": "string", "robots_meta": "string", "word_count": "int",
    "headings": "array<struct<level: int, text: string>>", "images": "array<struct<src: string, alt: string, width: string, height: string>>",
    "og_tags": "map<string, string>", "viewport": "string", "script_count": "int", "stylesheet_count": "int", "lang": "string", "favicon": "string",
    "links": f"array<{_LINK}>", "dom": DOM,
}
#: Columns of an acquisition that stored pages may lack; they are null then, never invented.
ACQUIRED = {
    "status_code": "int", "load_time_ms": "long", "error": "string", "response_headers": "map<string, string>", "cookies": "array<string>",
    "content_type": "string", "console_errors": "array<string>", "ttfb_ms": "long", "http_version": "string",
}
#: Console messages that say nothing about the page, and the share that is kept of the others.
NOISE, MAX_ERRORS, ERROR_CHARS = r"(?i)Content Security Policy|\[Violation\]|upgrade-insecure-requests|report-only", 10, 200


#: Characters of html after which the elements parsed so far are handed on: what a worker holds as
#: Python objects doesn't grow with the number of pages in a batch.
HELD_CHARS = 1 << 20


def tables(pages: DataFrame, html: bool = True) -> DataFrame:
    """Adds tree, the table of a page's elements (dom.TREE); each page is parsed once. html says
    whether the markup is kept."""
    kept = [c for c in pages.columns if c not in PARSED and c != "tree" and (html or c != "html")]
    out = T.StructType([pages.schema[c] for c in kept] + [T.StructField("tree", T._parse_datatype_string(dom.TREE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in {*kept, "url", "html"}}
            made, begin, size = dom.Table(), 0, 0
            for k in range(batch.num_rows):
                markup = at["html"][k].as_py() or ""
                made.add(at["url"][k].as_py() or "", markup)
                size += len(markup)
                if size >= HELD_CHARS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(at[c].slice(begin, k + 1 - begin) for c in kept), made.arrow()], names=[*kept, "tree"])
                    made, begin, size = dom.Table(), k + 1, 0

    return pages.select(*dict.fromkeys([*kept, "url", "html"])).mapInArrow(run, out)


def once(x: Column) -> Column:
    """A value for a column that later plans read often: a generator, as plans copy plain
    expressions into each of their uses."""
    return F.explode(F.array(x))


@lru_cache(maxsize=4)
def _page_fields(application: str, names: tuple[str, ...]) -> Column:
    """The fields' expression, of some thousand calls, is made once for an application."""
    return fields.page_fields(F.col("tree"), F.col("url"), names)


def parse_pages(pages: DataFrame, names: tuple[str, ...] = tuple(PARSED), html: bool = True) -> DataFrame:
    """Adds the parsed columns to (url, html, ...); each page is parsed once. Pages without html
    have nulls and empty lists. Of the columns only those named are made, as Spark can't tell
    which parts of a generated struct nobody reads; html says whether the markup is kept."""
    held = tables(pages, html)
    rest = [c for c in held.columns if c != "tree"]
    made = held.select(*rest, once(_page_fields(pages.sparkSession.sparkContext.applicationId, names)).alias("tree"))
    return made.select(*rest, *(F.col("tree")[k].cast(PARSED[k]).alias(k) for k in names))


def keywords(docs: DataFrame) -> DataFrame:
    """Replaces url and text by keyword, a struct of the most frequent word, its count and the
    number of all words (see fields.keyword)."""
    kept = [c for c in docs.columns if c not in ("url", "text", "keyword")]
    return docs.select(*kept, once(fields.keyword(F.col("url"), F.coalesce("text", F.lit("")))).alias("keyword"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table (page_id, url, html) as a crawl: each host is one scan, in page_id order."""
    raw = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return raw.select(urls.hostname(F.col("url")).alias("scan_id"), F.col("page_id").alias("seq"), "url", "html")


def complete(pages: DataFrame) -> DataFrame:
    """Adds missing acquisition columns as nulls; header names in lower case; console errors
    without noise."""
    for name, kind in ACQUIRED.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    errors = F.slice(F.transform(F.filter("console_errors", lambda e: ~e.rlike(NOISE)), lambda e: F.substring(e, 1, ERROR_CHARS)), 1, MAX_ERRORS)
    return pages.withColumns({"response_headers": F.transform_keys("response_headers", lambda k, _: F.lower(k)), "console_errors": errors})


def split_cookies(header: Column) -> Column:
    """Cookies of a joined Set-Cookie header; commas inside dates don't split."""
    return F.split(header, r",(?=\s*\w+=)")


def is_html() -> Column:
    """Pages that the rules apply to: no error, html content, and not a bare JSON body."""
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    json = (F.coalesce(F.col("word_count"), F.lit(0)) == 0) & F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"^\s+", "").startswith("{")
    return F.col("error").isNull() & ((kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")) & ~json


def is_success() -> Column:
    """No error and a status from 200 to 399; stored pages without a status count as fetched."""
    return F.col("error").isNull() & F.coalesce(F.col("status_code").between(200, 399), F.lit(True))
