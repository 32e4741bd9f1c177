"""URL, text and label functions on hand-made cases."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from siteloom.functions import labels, text, urls
from siteloom.operators import scoring, sitechecks
from siteloom.sources import sinks


def one(spark, make, *values):
    """make(column) over each value."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v"))).collect()]


def test_normalizers(spark):
    given = ["example.com", "http://WWW.Example.com/a/?b=2&a=1#x", "ftp://e.com/", "https://e.com:8080/p/", "http://e.com:80/", "not a url at all"]
    assert one(spark, urls.normalize, *given[:3]) == ["https://example.com/", "https://example.com/a?a=1&b=2", "https://e.com/"]
    assert one(spark, urls.for_compare, "https://E.com/A/B//?q#f") == ["https://e.com/a/b"]
    assert one(spark, urls.for_graph, "https://E.com/a/?q=1#f", "https://e.com/", "x") == ["https://e.com/a?q=1", "https://e.com/", None]
    assert one(spark, urls.for_hreflang, "https://www.E.com/A/") == ["https://e.com/a"]
    assert one(spark, urls.strip_tracking, "https://e.com/?utm_source=a&x=1&gclid=2#f", "https://e.com/?fbclid=1", "rel") == ["https://e.com/?x=1#f", "https://e.com/", "rel"]


@pytest.mark.parametrize("url,safe", [
    ("https://example.com/", True), ("example.com", True), ("http://localhost/", False), ("http://127.0.0.1", False), ("http://10.1.2.3/", False), ("http://172.16.0.1", False), ("http://172.32.0.1", True),
    ("http://192.168.1.1", False), ("http://169.254.169.254/", False), ("http://metadata.google.internal/", False), ("http://x.metadata/", False), ("file:///etc/passwd", False), ("javascript:alert(1)", False),
    ("http://[::1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://[::ffff:7f00:1]/", False), ("http://[fd00::1]/", False), ("http://[2606:4700::1]/", True), ("http://a.local", False), ("http://224.0.0.1", False), ("http://8.8.8.8", True), ("http://100.64.0.1", False),
])
def test_safe_urls(spark, url, safe):
    assert one(spark, urls.is_safe, url) == [safe]


def test_predicates(spark):
    assert one(spark, urls.is_article, "https://e.com/blog/a-post", "https://e.com/blog/", "https://e.com/news/topics/x", "https://e.com/2024/05/x", "https://e.com/about") == [True, False, False, True, False]
    assert one(spark, urls.is_auth_page, "https://e.com/Dashboard/x", "https://e.com/my-orders", "https://e.com/happy") == [True, True, False]
    assert one(spark, urls.is_excluded, "https://e.com/a.PDF", "https://e.com/cart", "https://e.com/blog", "https://e.com/feed/") == [True, True, False, True]
    pats = F.array(F.lit("/private"), F.lit("/*/edit"))
    assert one(spark, lambda u: urls.disallowed(u, pats), "https://e.com/private/x", "https://e.com/a/edit", "https://e.com/a/editor", "https://e.com/") == [True, True, False, False]
    assert one(spark, urls.shorten, "https://e.com/" + "a" * 60, "https://e.com/")[1] == "e.com" and len(one(spark, urls.shorten, "https://e.com/" + "a" * 60)[0]) == 40


def test_text(spark):
    assert one(spark, text.syllables, "table", "make", "a", "beautiful", "the", "rhythm") == [2, 1, 1, 3, 1, 1]
    assert one(spark, text.reading_ease, "", "The cat sat.")[0] == 100.0
    assert one(spark, text.plain, "<p>a&amp;b</p><script>x</script> &copy;&#169; c") == ["a&b c"]
    sh = one(spark, text.shingles, "one two three four", "the cat", "a b")
    assert sorted(sh[0]) == ["one two three", "two three four"] and sorted(sh[1]) == ["cat", "the"] and sh[2] == []
    assert one(spark, lambda v: text.shared_snippet(v, F.lit("b c d x y")), "a b c d e x y", "q") == ["b c d", "(similar structure detected)"]


def test_next_runs(spark):
    cases = [("DAILY", "2024-01-31 05:59:59", "2024-01-31 06:00:00"), ("DAILY", "2024-01-31 06:00:00", "2024-02-01 06:00:00"), ("WEEKLY", "2024-01-01 00:00:00", "2024-01-08 06:00:00"), ("WEEKLY", "2024-01-07 23:00:00", "2024-01-08 06:00:00"), ("MONTHLY", "2024-01-15 00:00:00", "2024-02-01 06:00:00"), ("MONTHLY", "2023-01-31 00:00:00", "2023-03-01 06:00:00")]
    frame = spark.createDataFrame([(f, dt.datetime.fromisoformat(s), dt.datetime.fromisoformat(e)) for f, s, e in cases], "f string, s timestamp, e timestamp")
    assert frame.where(labels.next_run(F.col("f"), F.col("s")) != F.col("e")).count() == 0


def test_scores(spark):
    def score(*codes):
        data = [("s", i, code, sev, "SEO") for i, (code, sev) in enumerate(codes)]
        found = spark.createDataFrame(data, "scan_id string, n int, code string, severity string, category string")
        return scoring.category_scores(found).first()["score"]

    assert [score(("a", s)) for s in ("P0", "P1", "P2", "P3")] == [78, 90, 96, 99]
    assert score(*[("a", "P1")] * 10) == 87 and score(("a", "P1"), ("b", "P1"), ("c", "P1")) == 74 and score(*[(f"c{i}", "P3") for i in range(20)]) == 78
    perf = spark.range(1).select(sitechecks.performance_score(F.lit(3500), F.lit(2600), F.lit(0.3), F.lit(None).cast("int"), F.lit(4000)).alias("p"))
    assert perf.first()["p"] == 25


def test_exports(spark):
    assert one(spark, sinks.csv_field, "plain", "=1+1", "a,b", 'say "x"', "it's", None, "a|b") == ["plain", "\"'=1+1\"", '"a,b"', '"say ""x"""', '"it\'s"', "", '"a|b"']
    assert one(spark, sinks.escape_html, "<a href='x'>&") == ["&lt;a href=&#039;x&#039;&gt;&amp;"]
    assert "B" in spark.range(1).select(sinks.badge(F.lit(85))).first()[0]


def test_scripts_and_tags_are_cut_as_by_plain_patterns(spark):
    """Random markup, and pages of starts without ends."""
    random.seed(5)
    pieces = ["<script>", "</SCRIPT>", "<Script x>", "</script>", "<style>", "</style>", "<", ">", "<>", "a b", "\n", "<p>", "</p", "é😀", "</script"]
    pages = ["".join(random.choices(pieces, k=random.randrange(14))) for _ in range(500)] + ["", None]
    frame = spark.createDataFrame([(p,) for p in pages], "h string")
    h = F.col("h")
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " "), "<[^>]+>", " ")
    new = text.without_tags(text.replace_spans(text.without_scripts(h), "(?is)<style.*?</style>", "</style>", " "))
    assert frame.where(~old.eqNullSafe(new)).count() == 0
    began = time.time()
    for start in ("<script ", "<style ", "<"):
        page = F.repeat(F.lit(start), 1_000_000 // len(start))
        assert spark.range(1).select(F.length(text.plain(F.when(F.col("id") == 0, page))).alias("n")).first()["n"] > 0
    assert time.time() - began < 60  # some seconds; hours by plain patterns
