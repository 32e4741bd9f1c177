"""What must not grow with the input: what is held, made and repeated."""

import pyarrow as pa
from pyspark.sql import functions as F

from siteloom.functions import text, urls
from siteloom.operators import similar, technology
from siteloom.sources import dom
from siteloom.sources import pages as P


def test_a_worker_hands_on_its_pages_in_slices(spark, monkeypatch):
    """What a worker holds as Python objects has a bound, whatever a batch holds."""
    most = []
    add = dom.Table.add

    def watched(self, url, html):
        add(self, url, html)
        most.append(len(self.pages) - 1)

    monkeypatch.setattr(dom.Table, "add", watched)
    monkeypatch.setattr(P, "HELD_CHARS", 1000)
    pages = spark.range(50).select(F.col("id"), F.lit("https://e.com/").alias("url"), F.concat(F.lit("<title>"), "id", F.lit("</title>" + "<p>words</p>" * 40)).alias("html"))
    ran = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, out: ran.setdefault("run", run))
    P.tables(pages)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in pages.collect()])
    made = list(ran["run"](iter([batch])))
    assert max(most) <= 3 and [i for b in made for i in b.column(0).to_pylist()] == list(range(50))
    assert all(b.column(b.num_columns - 1)[k]["text"].as_py().startswith(str(i).encode()) for b in made for k, i in enumerate(b.column(0).to_pylist()))


def test_only_named_fields_are_made(spark):
    pages = spark.createDataFrame([("https://e.com/", "<title>T</title><a href='/x'>x</a>")], "url string, html string")
    found = P.parse_pages(pages, ("title", "links"), html=False)
    assert found.columns == ["url", "title", "links"] and found.first()["links"][0]["href"] == "https://e.com/x"
    assert "keyword" not in found._jdf.queryExecution().analyzed().toString()


def test_class_marks_are_whole_names_of_one_element(spark):
    pages = spark.createDataFrame([("u", "<b class='post'></b><b class='date'></b>"), ("u", "<b class='a\n published\tb'></b>"), ("u", "<b class='author-x'></b>")], "url string, html string")
    told = [r["f"] for r in P.parse_pages(pages).select(F.col("dom.flags").alias("f")).collect()]
    assert [f["date_markup"] for f in told] == [False, True, False] and [f["author_class"] for f in told] == [False, False, True]


def test_an_address_is_taken_apart_a_few_times_only(spark):
    plan = spark.sql("SELECT 'http://10.0.0.1/' AS u").select(urls.is_safe(F.col("u")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[a-z][a-z0-9+.-]*)://") <= 6
    rows = [("http://10.1.2.3/", False), ("http://8.8.8.8/", True), ("http://[::ffff:10.0.0.1]/", False), ("http://99999999999999999999.1.1.1/", True), ("http://localhost", False), ("x.corp", False), ("ftp://a.b/", False), ("a.b/c", True), ("", False), (None, False)]
    held = spark.createDataFrame([(u,) for u, _ in rows], "u string")
    assert [r[0] for r in held.select(urls.is_safe(F.col("u"))).collect()] == [safe for _, safe in rows]


def test_patterns_of_technologies_hold_their_words(spark):
    """Each alternative of each pattern matches a text that holds one of the words, so no page is spared wrongly."""
    marks = {"React": ["DATA-REACTROOT", "__NEXT_DATA__", "react-dom", "react.production.min.js"], "Vue.js": ["DATA-V-A", "vue.runtime", "vue.min.js", "vue.global"], "Angular": ["[ngClass]", "(click)", "@angular/core", "ng-app"], "Svelte": ["SVELTE-x", "__sveltekit"],
        "WordPress": ["wp-json/", '<meta name="generator" content="WORDPRESS">'], "Drupal": ["sites/default/files", "drupal.js"], "Hotjar": ["hj('identify')", "hotjar.com"], "Google Tag Manager": ["GTM-A"], "Google Analytics": ["ga.js", "GoogleAnalyticsObject", "gtag/js"], "Wix": ["_wix_browser_sess"],
        "Vercel Analytics": ["va.vercel-scripts.com", "vercel-insights"], "Tailwind CSS": ['class="p-1"'], "Bootstrap": ['class="row"', "bootstrap.min"], "Google Fonts": ["fonts.gstatic.com"], "Gatsby": ["___gatsby", "gatsby-image"], "Squarespace": ["sqsp"], "Shopify": ["Shopify.theme"]}
    rows = [(name, text) for name, texts in marks.items() for text in texts]
    found = spark.createDataFrame(rows, "name string, html string").select("name", "html", F.transform(technology.detections(F.col("html")), lambda d: d["name"]).alias("names"))
    assert [(r["name"], r["html"]) for r in found.collect() if r["name"] not in r["names"]] == []
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains(") >= 50


def test_texts_are_taken_apart_once_for_their_pairs(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(t):
        calls.add(1)
        return t

    docs = spark.createDataFrame([(i, f"one two three four five {'six' if i % 3 else 'seven'}") for i in range(30)], "id long, t string").repartition(2)
    counted = docs.select(F.lit("g").alias("scan_id"), F.col("id").alias("seq"), text.shingle_hashes(F.udf(count)("t")).alias("shingles"))
    found = similar.similar(counted, 0.5)
    assert found.members.count() == 30 and [(r["a"], r["b"], r["similarity"]) for r in found.pairs.collect()] == [(0, 1, 0.6)]
    assert calls.value == 30


def test_hashes_of_shingles_are_those_of_their_strings(spark):
    rows = spark.createDataFrame([("one two three four one two three",), ("the cat",), ("a b",), ("",)], "t string")
    told = rows.select(F.size(text.shingles(F.col("t"))).alias("a"), F.size(text.shingle_hashes(F.col("t"))).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in told] == [(4, 4), (2, 2), (0, 0), (0, 0)]


def test_pages_of_broken_links_take_tasks_by_the_number_of_links(spark, monkeypatch):
    from siteloom.operators import links

    monkeypatch.setattr(links, "LINKS_A_TASK", 50)
    held = spark.range(1000).selectExpr("CAST(id % 7 AS string) AS scan_id", "id AS seq", "0 AS pos", "concat('p', id % 3) AS source_url", "concat('h', id % 20) AS href", "'t' AS text", "true AS is_internal")
    status = spark.range(20).selectExpr("concat('h', id) AS href", "404 AS status_code", "CAST(null AS string) AS error", "array('x') AS chain")
    found = links.with_sources(links.checked(links.unique_links(held), status), held)
    assert found.rdd.getNumPartitions() == 20
    rows = found.collect()
    assert len(rows) == 140 and all(sorted(r["found_on"]) == ["p0", "p1", "p2"] for r in rows)


def test_texts_to_compare_are_made_once_and_plain_spaces_stay(spark):
    from siteloom.operators import crosspage

    plan = crosspage.contents(spark.createDataFrame([("s", 1, "u", None, 60, ("w " * 60,))], "scan_id string, seq long, url string, error string, word_count int, dom struct<main_text: string>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9_]") == 1
    odd = spark.createDataFrame([("A--b\t c é d\n", "a<b>x</b>\r\n c &#7; d")], "t string, html string")
    assert odd.select(crosspage.comparable(F.col("t")), text.plain(F.col("html"))).first()[:] == ("a b c d", "a x c d")
    node = urls.for_graph(F.lit("HTTPS://A.b:443/x/?q#f"))
    assert spark.range(1).select(node).first()[0] == "https://a.b/x?q" and node._jc.toString().count("regexp_extract") <= 6
