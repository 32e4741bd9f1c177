"""The parsed columns against a walk of the tree: stored pages, composed pages and odd markup."""

import os
import random

import pytest

from siteloom import composed
from siteloom.sources import fields
from siteloom.sources import pages as P
from tests import plain_parse

SF = "/root/testdata/sf0.001"
TAGS = "div p ul ol li table tr td a img h1 h2 h3 span nav header footer aside main article section form input label dialog picture source svg script style title meta link blockquote time iframe button html head body noscript template option select b dl dt dd".split()
VALUES = {
    "class": ["nav", "content", "post entry", "author", "byline x", "faq-list", "modal", "popup hide", "menu", "quote", "step instruction", "steps", "review", "stat-1", "overlay", "contact us"],
    "role": ["main", "navigation", "dialog", "banner"], "id": ["a", "b", "overlay", "x1"], "for": ["a", "b", ""], "href": ["/x", "y?q#z", "https://o.org/a", "http://[bad", "#t", "mailto:a@b", "", "//h.ex/p", "../up", "javascript:x", "https://www.e.com/s"],
    "src": ["/i.png", "", "b.webp"], "srcset": ["x.avif 2x", "y.jpg"], "type": ["application/ld+json", "image/webp", "TEXT", ""], "alt": ["", "pic", " p "], "rel": ["canonical", "icon", "author", "stylesheet", "preload", "manifest"],
    "name": ["description", "robots", "viewport", "author", "twitter:card", "q"], "property": ["og:title", "og:title", "article:published_time", ""], "content": [" text ", "", " nb "], "style": ["position: fixed", "position:fixed; display: none", "color: red"],
    "aria-hidden": ["true", "false"], "aria-label": ["breadcrumb", "", "Go"], "width": ["10", " 7px", "x", "99999999999999999999"], "open": [""], "hidden": [""], "title": ["t", ""], "itemprop": ["author", "review", "datePublished"], "datetime": ["2024"], "lang": ["en", ""],
    "async": [""], "data-rating": ["1"],
}
TEXTS = ["word", " two words ", "\n", " ", "contact", "How-to", "step 1", "FAQ?", "Why?", "&amp;", "&#39;", "café 日本", "shoes shoes", "<", "<!-- c -->", "<![CDATA[x]]>", "</", "a<b", "<3", "&notanentity;", "\U0001f600"]


def soup(seed):
    draw = random.Random(seed)
    out = []
    for _ in range(draw.randrange(60)):
        kind = draw.random()
        if kind < 0.5:
            given = " ".join(f'{k}="{draw.choice(v)}"' if draw.random() < 0.9 else k for k, v in draw.sample(sorted(VALUES.items()), draw.randrange(4)))
            out.append(f"<{draw.choice(TAGS)}{' ' * bool(given)}{given}{draw.choice(['', '', '', '/'])}>")
        elif kind < 0.75:
            out.append(f"</{draw.choice(TAGS)}>")
        else:
            out.append(draw.choice(TEXTS))
    return "".join(out)


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def check(pages):
    rows = P.parse_pages(pages).collect()
    for r in rows:
        want = plain_parse.extract(r["url"] or "", r["html"] or "")
        for name, value in want.items():
            if name == "dom":
                for k, v in value.items():
                    assert plain(r["dom"][k]) == plain(v), (k, r["url"], r["html"])
            else:
                assert plain(r[name]) == plain(value), (name, r["url"], r["html"])
    return rows


def test_odd_markup(spark):
    urls = ["https://www.e.com/a/shoes", "https://e.com/", "http://sub.tools-css.io/x_y", "no url", None]
    held = [(urls[i % 5], soup(i)) for i in range(600)] + [("https://e.com/", x) for x in ("", " ", "plain text", "<", "<p", "<a href=x>" * 600 + "deep", "<ol>" * 3 + "<li>" * 4, "<picture><picture><source type=image/webp></picture><img src=a></picture>")] + [("https://e.com/", None)]
    assert len(check(spark.createDataFrame(held, "url string, html string"))) == len(held)


@pytest.mark.skipif(not os.path.exists(SF), reason="no stored tables")
def test_stored_and_composed_pages(spark):
    check(spark.read.parquet(f"{SF}/pages.parquet").select("url", "html"))
    check(composed.composed(spark, SF).select("url", "html"))


def test_subtrees_are_slices(spark):
    """The table of elements: order, subtrees, depths and ranges of text."""
    html = "<title>T</title><body>a<div>b<p>c</p><script>s</script></div>d"
    tree = P.tables(spark.createDataFrame([("https://e.com/", html)], "url string, html string")).first()["tree"]
    assert bytes(tree["text"]) == b"Tabcd"
    got = [(x["n"], x["tag"], x["parent"], x["last"], x["depth"], bytes(tree["text"])[x["t0"] : x["t1"]], x["body"]) for x in tree["nodes"]]
    assert got == [(1, "html", 0, 7, 0, b"Tabcd", None), (2, "head", 1, 3, 1, b"T", None), (3, "title", 2, 3, 2, b"T", None), (4, "body", 1, 7, 1, b"abcd", None), (5, "div", 4, 7, 2, b"bc", None), (6, "p", 5, 6, 3, b"c", None), (7, "script", 5, 7, 3, b"", "s")]


def test_keyword_against_counting(spark):
    held = [("https://shoes.com/", "shoes shoes boots"), ("https://e.com/red-hats", "hats red hats hat blue"), ("", ""), (None, None), ("x", "tie one tie one tie"), ("x", "béta don't DON'T 123 ab " * 3)]
    for r in spark.createDataFrame(held, "url string, text string").withColumn("k", fields.keyword(plain_column("url"), plain_column("text"))).collect():
        assert r["k"].asDict() == plain_parse.keyword(r["url"] or "", r["text"] or "")


def plain_column(name):
    from pyspark.sql import functions as F

    return F.coalesce(name, F.lit(""))
