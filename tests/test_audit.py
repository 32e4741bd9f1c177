"""Page rules, cross-page checks, site checks and whole audits on hand-made pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteloom.operators import compare, crosspage, history, issues, links, reports, requests, rules, sitechecks, technology
from siteloom.plans import audit, frontier
from siteloom.plans.lineage import cut
from siteloom.sources import site
from siteloom.sources import pages as P
from siteloom.streaming import limiter

SCHEMA = "scan_id string, seq long, url string, html string, status_code int, ttfb_ms long, response_headers map<string,string>, cookies array<string>, console_errors array<string>, http_version string, error string, content_type string, load_time_ms long"
HEADERS = {"Content-Security-Policy": "default-src *; script-src 'unsafe-inline' data:", "Server": "nginx"}


def page(seq, html, url=None, scan="s", status=200, ttfb=None, headers=None, cookies=None, errors=None, http=None, error=None, kind=None):
    return (scan, seq, url or f"https://e.com/{'' if not seq else f'p{seq}'}", html, status, ttfb, headers, cookies, errors, http, error, kind, None)


def parsed(spark, *pages):
    return cut(P.parse_pages(spark.createDataFrame(list(pages), SCHEMA)))  # stored, as several branches read it


def codes(spark, *pages, **tables):
    out: dict = {}
    for r in audit.all_issues(parsed(spark, *pages), **tables).collect():
        out.setdefault(r["code"], []).append(r)
    return out


def test_extraction(spark):
    html = (
        '<html lang=en><head><title> A &amp; B </title><meta name=description content=" d "><link rel=canonical href="/c"><meta property="og:title" content=T><link rel=icon href="f.ico"></head><body><h1>Head</h1><p>one  two<p>three'
        '<script>var x="<p>no</p>"</script><a href="x?y#z">go</a><a href="#top">no</a><a href="x?y#z"><img alt="pic" src=i.png></a><a href="https://o.org">out</a><div role=dialog><h2>hidden</h2></div><ul><li>a<li>b</ul></body></html>'
    )
    r, none, words = parsed(spark, page(0, html, url="https://e.com/dir/page"), page(1, ""), page(2, "plain words here")).orderBy("seq").collect()
    assert (r["title"], r["meta_description"], r["h1"], r["canonical"], r["lang"], r["favicon"]) == ("A & B", "d", "Head", "/c", "en", "https://e.com/dir/f.ico")
    assert [(x["href"], x["text"], x["is_internal"]) for x in r["links"]] == [("https://e.com/dir/x?y#z", "pic", True), ("https://o.org/", "out", False)]
    assert [tuple(h) for h in r["headings"]] == [(1, "Head")] and r["og_tags"] == {"og:title": "T"} and r["dom"]["tag_counts"]["li"] == 2
    assert none["word_count"] == 0 and words["word_count"] == 3


def test_bare_homepage(spark):
    found = codes(spark, page(0, "<html><head></head><body><p>few words</p></body></html>"))
    for code in "missing_title missing_meta_description missing_h1 missing_canonical missing_og_title missing_viewport missing_lang_attribute missing_favicon missing_structured_data very_thin_content missing_privacy_policy missing_contact_info missing_organization_schema no_social_proof no_about_page_link no_web_manifest no_structured_data missing_brand_entity no_preload_hints no_outgoing_internal_links".split():
        assert code in found, code
    assert found["missing_title"][0]["severity"] == "P0" and "missing_csp" not in found and "orphan_page" not in found
    kept = issues.dedupe(audit.all_issues(parsed(spark, page(0, "<html><body>x</body></html>")))).where("code = 'missing_lang_attribute'").collect()
    assert [(r["severity"], r["impact"]) for r in kept] == [("P2", 3)]


def test_rules_of_a_full_page(spark):
    imgs = '<img src="a.jpg" width=3000><img src="b.png" loading=lazy width=300 height=200><img src="http://x.org/c.gif"><img src="d.webp" alt=" ">'
    html = (
        '<html lang="en"><head><title>Short</title><meta name=viewport content="width=500, user-scalable=no"><link rel=canonical href="https://other.org/"><link rel="alternate" hreflang="xx_1" href="/q"><link rel="stylesheet" href=1><link rel="stylesheet" href=2><link rel="stylesheet" href=3><link rel="stylesheet" media=all href=4>'
        '<link rel="stylesheet" media=print href=5><script src="https://cdn.x/y.js"></script><meta name=robots content="NOINDEX"><style>@font-face{font-family:X}</style><script type="application/ld+json">{bad</script><meta property="og:image" content="/i.png"></head>'
        f'<body><h2>a</h2><h4></h4><font>f</font>{imgs}<input name=q><iframe src=x></iframe><a href="#" target=_blank>here</a><a href="/x"> </a><a href="/y">click here</a><p style="font-size: 10px">s</p><button style="width:20px">b</button><dialog open>d</dialog></body></html>'
    )
    found = codes(spark, page(0, "<html><body>home</body></html>"), page(1, html, url="https://e.com/Blog_x/page/2?A=1", headers=HEADERS, ttfb=900, errors=["e"] * 6 + ["[Violation] x"], http="HTTP/1.1", cookies=["a=1; Secure", "b=2; HttpOnly; SameSite=Lax"]))
    want = (
        "title_too_short viewport_not_responsive viewport_not_mobile_friendly cross_domain_canonical page_noindex og_image_relative hreflang_missing_self_reference hreflang_invalid_language url_uppercase url_underscores pagination_missing_rel_links invalid_json_ld "
        "missing_alt_text_majority heading_hierarchy_skip heading_level_skip empty_headings deprecated_html_tags form_missing_labels iframe_missing_title empty_anchor_text non_descriptive_anchor text_too_small_mobile tap_targets_too_close mobile_usability_interstitial "
        "no_modern_image_format missing_lazy_loading oversized_image missing_image_dimensions no_responsive_images avif_not_used render_blocking_css render_blocking_js missing_font_display lcp_image_not_preloaded moderate_server_response js_console_errors no_http2"
    ).split()
    missing = [code for code in want if code not in found]
    assert not missing and found["js_console_errors"][0]["severity"] == "P1"


def test_security_runs_on_the_first_good_page(spark):
    html = '<html><body><a href=x target=_blank>t</a><script src="https://cdn.x/y.js"></script><img src="http://i.x/1.png"></body></html>'
    found = codes(spark, page(0, "no", status=500), page(1, html, headers=HEADERS, cookies=["a=1; Secure", "b=2; HttpOnly; SameSite=Lax"]), page(2, "<p>x", headers={}))
    assert {r["seq"] for r in found["missing_hsts"]} == {1}
    for code in "csp_unsafe_inline csp_wildcard_source csp_data_uri_scripts cookie_missing_secure cookie_missing_httponly cookie_missing_samesite mixed_content missing_noopener external_script_missing_sri missing_corp".split():
        assert code in found, code
    assert "csp_unsafe_eval" not in found and "missing_csp" not in found


def test_json_ld(spark):
    block = '<script type="application/ld+json">%s</script>'
    article = block % '[{"@type":"Article","author":{"name":"x"},"datePublished":"2024"},{"@type":"Organization","sameAs":[]}]'
    found = codes(spark, page(0, f"<html><body>{article}</body></html>"), page(1, "<html><body>" + block % '{"@type":"Person","sameAs":["a"]}' + "</body></html>", url="https://e.com/blog/x"))
    assert {"missing_speakable_schema", "missing_date_modified", "missing_entity_sameAs"} <= set(found)
    assert [r["seq"] for r in found["missing_author_attribution"]] == [1] and "missing_brand_entity" not in found and [r["seq"] for r in found["missing_entity_sameAs"]] == [0]


def test_keyword_and_readability(spark):
    stuffed = "<title>cheap shoes</title><body>" + "shoes " * 40 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)) + "</body>"
    hard = "<body>" + "Incomprehensible organizational responsibilities necessitate multidimensional considerations " * 12 + ".</body>"
    found = codes(spark, page(0, stuffed), page(1, hard))
    assert [r["seq"] for r in found["keyword_stuffing"]] == [0] and 1 in {r["seq"] for r in found["poor_readability"]}


def graph_page(seq, name, *targets):
    return page(seq, "<body>" + "".join(f'<a href="/{t}">l{t}</a>' for t in targets) + "</body>", url=f"https://e.com/{name}")


def test_link_graph(spark):
    pages = [graph_page(0, "", "a", "a"), graph_page(1, "a", "b", "a"), graph_page(2, "b", "c"), graph_page(3, "c", "d"), graph_page(4, "d", "u"), graph_page(5, "o")]
    found = codes(spark, *pages)
    at = lambda code: sorted(r["url"].rsplit("/", 1)[1] for r in found.get(code, []))
    assert at("orphan_page") == ["o"] and at("deep_page") == ["d", "u"] and at("low_internal_links") == ["a", "b", "c", "d"] and at("no_outgoing_internal_links") == ["o"]
    p = parsed(spark, *pages)
    node, edge = links.crawl_map(p, links.links(p))
    assert edge.count() == 4 and node.where("url LIKE '%/' AND radius = 20").count() == 1


def test_frontier(spark):
    data = [("s", "https://e.com/", i, f"https://e.com/{t}", True) for i, t in enumerate(["a?utm_id=1", "a#x", "cart", "b"])] + [("s", "https://e.com/a", 0, "https://e.com/c", True), ("s", "https://e.com/c", 0, "https://e.com/d", True), ("s", "https://e.com/c", 1, "https://o.org/", False)]
    held = spark.createDataFrame(data, "scan_id string, source_url string, pos int, href string, is_internal boolean")
    start = spark.createDataFrame([("s", "https://e.com/")], "scan_id string, url string")
    got = lambda **k: [(r["url"][14:], r["depth"]) for r in frontier.crawl(held, start, **k).orderBy("place").collect()]
    assert got() == [("", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3)] and got(max_pages=3) == [("", 0), ("a", 1), ("b", 1)] and got(max_depth=1) == [("", 0), ("a", 1), ("b", 1)]


def test_broken_links_and_targets(spark):
    html = '<head><meta property="og:image" content="https://i.x/1.png"><link rel=canonical href="https://e.com/gone"></head><a href="/gone">g</a><a href="https://o.org/f">o</a><a href="/r">r</a>'
    status = spark.createDataFrame([("https://e.com/gone", 404, None, [], "text/html"), ("https://o.org/f", 403, None, [], None), ("https://e.com/r", 200, None, ["a", "b", "c"], None), ("https://i.x/1.png", 200, None, [], "text/html")], "href string, status_code int, error string, chain array<string>, content_type string")
    found = codes(spark, page(0, html), page(1, "x", url="https://e.com/gone", status=404), status=status)
    assert sorted((r["url"], r["severity"]) for r in found["broken_link"]) == [("https://e.com/gone", "P1"), ("https://o.org/f", "P3")]
    assert found["redirect_chain"][0]["url"] == "https://e.com/r" and found["og_image_not_image"] and found["canonical_url_broken"][0]["url"] == "https://e.com/"
    assert found["internal_link_to_error_page"][0]["severity"] == "P1"
    hops = links.resolve_redirects(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "href string, target string"))
    assert {r["href"]: (r["chain"], r["looped"]) for r in hops.collect()}["a"] == (["a", "b", "c"], True)


def test_similar_and_duplicate_pages(spark):
    words = [f"token{i:03d}" for i in range(120)]
    body = lambda w: f"<title>Same</title><main>{' '.join(w)}</main>"
    found = codes(spark, page(0, body(words)), page(1, body(words)), page(2, body(words[:-8] + ["other"] * 8)), page(3, body([f"x{w}" for w in words])), page(4, body(words), url="https://e.com/p1?x=1"))
    pairs = {(r["url"], r["evidence"].split('"similarUrl":"')[1].split('"')[0]) for r in found["duplicate_content"]}
    assert ("https://e.com/", "https://e.com/p1") in pairs and ("https://e.com/p1", "https://e.com/p1?x=1") not in pairs
    assert len(found["duplicate_title"]) == 1 and found["duplicate_title"][0]["seq"] == 0


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9])
def test_prefix_join_is_exact(spark, threshold):
    import random

    random.seed(1)
    sets = [(f"g{i % 2}", i, [f"t{random.randrange(12)}" for _ in range(random.randint(0, 8))]) for i in range(60)]
    frame = spark.createDataFrame(sets, "scan_id string, seq int, shingles array<string>").withColumn("shingles", F.array_distinct("shingles"))
    got = {(r["a"], r["b"]) for r in crosspage.similar_pairs(frame, threshold).collect()}
    want = {(i, j) for g, i, a in sets for h, j, b in sets if g == h and i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold}
    assert got == want


def test_hreflang_pairs(spark):
    link = lambda *t: "".join(f'<link rel="alternate" hreflang="{x}" href="https://e.com/{x}">' for x in t)
    pages = [page(0, link("en", "de", "fr"), url="https://e.com/en"), page(1, link("en", "de"), url="https://www.e.com/de"), page(2, link("de"), url="https://e.com/fr"), page(3, link("en", "es"), url="https://e.com/es")]
    found = codes(spark, *pages)
    assert [r["url"] for r in found["hreflang_missing_self"]] == ["https://e.com/fr"]
    assert sorted((r["url"], r["evidence"].split('"lang":"')[1][:2]) for r in found["hreflang_not_bidirectional"]) == [("https://e.com/en", "fr"), ("https://e.com/es", "en"), ("https://e.com/fr", "de")]


ROBOTS = "User-agent: *\nDisallow: /private\nDisallow: /\nDisallow: /a:b\nUser-agent: other\nDisallow: /o\nUser-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\ndisallow: /*\nSitemap: https://e.com/map.xml"


def test_site_files(spark):
    files = spark.createDataFrame([
        ("s", "/robots.txt", True, 200, ROBOTS), ("s", "https://e.com/map.xml", True, 200, "<urlset><loc> https://e.com/p1/ </loc><loc>https://e.com/lost</loc><loc>https://e.com/p2</loc></urlset>"), ("s", "/sitemap.xml", True, 200, "<urlset></urlset>"),
        ("s", "/llms.txt", True, 200, "  "), ("s", "/.well-known/security.txt", False, 404, None), ("t", "/robots.txt", False, 404, None), ("t", "/sitemap.xml", True, 200, "<urlset></urlset>"),
    ], site.SITE_FILES)
    assert site.disallow_patterns(files).first()["disallow"] == ["/private", "/a"]
    found = codes(spark, page(0, "h"), page(1, "x"), page(2, "x", status=404), page(3, "x", url="https://e.com/private"), page(0, "h", scan="t", url="https://t.com/"), files=files)
    at = lambda code: sorted(r["scan_id"] for r in found.get(code, []))
    assert at("missing_robots_txt") == ["t"] and at("robots_no_sitemap_ref") == [] and at("empty_sitemap") == ["t"] and at("missing_sitemap") == [] and at("missing_llms_txt") == ["s"] and at("missing_security_txt") == ["s"]
    assert found["ai_crawlers_blocked"][0]["severity"] == "P3" and found["sitemap_url_broken"][0]["url"] == "https://e.com/p2"
    assert [r["url"] for r in found["sitemap_url_not_crawled"]] == ["https://e.com/lost"] and [r["url"] for r in found["page_not_in_sitemap"]] == ["https://e.com/private"]
    assert {r["url"]: r["severity"] for r in found["missing_title"]}["https://e.com/private"] == "P3"


def test_probes_and_measures(spark):
    now = dt.datetime(2024, 5, 1)
    probe = spark.createDataFrame([("s", "https://e.com/", 200, None, now + dt.timedelta(days=5), None, "text/html; charset=x", True, False), ("t", "https://t.com/", 301, "http://t.com/x", now - dt.timedelta(days=1), "gzip", "text/html", True, True)], site.SITE_PROBE)
    perf = spark.createDataFrame([("s", 0, "u", "desktop", 3500.0, 2600.0, 0.2, 600.0, 100.0, "x"), ("s", 0, "u", "mobile", 3500.0, 0.0, 0.0, 0.0, 9000.0, None)], "scan_id string, seq long, url string, viewport string, fcp double, lcp double, cls double, inp double, load double, lcp_src string")
    vio = [("color-contrast", "serious", "h"), ("target-size-minimum", "critical", "h")]
    a11y = spark.createDataFrame([("s", 0, "u", "desktop", vio[:1]), ("s", 0, "u", "mobile", vio), ("s", 9, "u9", "desktop", vio)], "scan_id string, seq long, url string, viewport string, violations array<struct<id:string,impact:string,help:string>>")
    done = spark.createDataFrame([("s", "u", issues.PHASES[:-1]), ("t", "u", issues.PHASES)], "scan_id string, url string, phases array<string>")
    found = codes(spark, page(0, '<head><link rel=manifest href=m></head>'), page(0, "x", scan="t"), probe=probe, perf=perf, a11y=a11y, completed=done, now=F.lit(now))
    for code in "no_https_redirect http_redirect_not_https certificate_expired certificate_expiring_critical no_compression slow_fcp needs_improvement_lcp missing_lcp_preload needs_improvement_cls slow_inp mobile_slow_fcp mobile_slow_load a11y_color-contrast a11y_mobile_target-size-minimum no_service_worker missing_theme_color".split():
        assert code in found, code
    assert "a11y_mobile_color-contrast" not in found and [r["scan_id"] for r in found["scan_timeout_partial"]] == ["s"] and found["a11y_mobile_target-size-minimum"][0]["severity"] == "P0"
    shift = sitechecks.shift_sources(spark.createDataFrame([("s", "u", 0.2, ["a", "b"]), ("s", "u", 0.1, ["a"])], "scan_id string, url string, value double, sources array<string>"))
    assert {r["element"]: round(r["shift"], 3) for r in shift.collect()} == {"a": 0.2, "b": 0.1}


def test_technologies_and_advice(spark):
    html = '<html><body class="x"><script id="__NEXT_DATA__"></script><link href="/wp-content/x"></body></html>'
    result = audit.audit(parsed(spark, page(0, html, headers={"X-Powered-By": "Next.js"})))
    tech = {r["name"]: r["source"] for r in result["technologies"].collect()}
    assert tech == {"React": "html", "Next.js": "header", "WordPress": "html"} or set(tech) >= {"React", "Next.js", "WordPress"}
    told = {r["code"]: r["advice_platform"] for r in result["issues"].collect()}
    assert told["missing_title"] == "Next.js" and told["missing_organization_schema"] == "WordPress" and told["missing_canonical"] is None
    s = result["summary"].first()
    assert 0 <= s["overall"] <= 100 and s["links"] == 100 and s["pages"] == 1


def test_reports_and_comparison(spark):
    data = [("s", 1, "missing_title", "P0", "SEO", 5, 1, "u"), ("s", 2, "thin_content", "P2", "CONTENT", 5, 3, ""), ("s", 3, "no_structured_data", "P2", "SEO", 3, 2, "u"), ("s", 4, "missing_title", "P0", "SEO", 5, 1, "v")]
    found = spark.createDataFrame(data, "scan_id string, n int, code string, severity string, category string, impact int, effort int, url string")
    assert reports.fix_first(found).first()["n"] == 1 and reports.worst_category(found).first()["category"] == "SEO"
    assert {r["page"]: r["issues"] for r in reports.by_page(found).collect()} == {"u": 2, "General": 1, "v": 1}
    v = reports.ai_visibility(found).first()
    assert v["score"] == 70 and not v["structured_data"] and v["fresh"]
    assert [r["code"] for r in reports.quick_wins(found).orderBy("rank").collect()] == ["missing_title", "missing_title", "no_structured_data"]
    now, then = found.withColumn("pair_id", F.lit(1)), found.where("n = 3").withColumn("pair_id", F.lit(1))
    assert compare.p0_changes(now, then)["new"].count() == 2 and compare.p0_changes(then, now)["resolved"].count() == 2
    assert {r["code"]: r["status"] for r in compare.diff_by_code(now, then).collect()} == {"missing_title": "new", "thin_content": "new", "no_structured_data": "persistent"}


def test_history_pages_cover_everything(spark):
    runs = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1 + i % 9), "SUCCEEDED" if i % 4 else "FAILED", 50 + i, i % 2) for i in range(25)], "site string, run_id long, created_at timestamp, status string, score int, p0 int")
    seen, cursor = [], None
    while True:
        got = history.page(runs, cursor, 7).collect()
        seen += got[:7]
        if len(got) <= 7:
            break
        cursor = (got[6]["created_at"], got[6]["run_id"])
    assert [r["run_id"] for r in seen] == [r["run_id"] for r in runs.orderBy(F.desc("created_at"), F.desc("run_id")).collect()]
    assert history.score_history(runs, 3).count() == 4
    left = history.spend_quota(spark.createDataFrame([("A@x.org", 1)], "email string, quota int"), spark.createDataFrame([("a@x.org",), ("a@X.org",), ("n@x.org",)], "email string"))
    assert {r["email"]: r["left"] for r in left.collect()} == {"a@x.org": 0, "n@x.org": 2}


def test_limiter(spark):
    times: list[int] = []
    told = []
    for _ in range(6):
        allowed, left, reset, times = limiter.decide(times, 1000, 5, 60_000)
        told.append((allowed, left))
    assert told == [(True, 4), (True, 3), (True, 2), (True, 1), (True, 0), (False, 0)] and limiter.decide(times, 61_000, 5, 60_000)[0]
    data = [("k" if i % 3 else "l", i, (i * 7919) % 5000) for i in range(300)]
    stored = spark.createDataFrame(data, "key string, request_id long, at_ms long")
    got = {(r["key"], r["request_id"]): r["allowed"] for r in limiter.limit_batch(stored, 3, 400).collect()}
    state: dict = {}
    for key, ident, at in sorted(data, key=lambda x: (x[2], x[1])):
        allowed, _, _, state[key] = limiter.decide(state.get(key, []), at, 3, 400)
        assert got[key, ident] == allowed


def test_requests(spark):
    data = [("e.com/", None, None, None, None), ("http://10.0.0.1/", 5000, 0, False, "x"), (" ", 1, 1, True, "none"), (None, None, None, None, None)]
    out = requests.validated(spark.createDataFrame(data, "url string, max_pages int, max_depth int, include_performance boolean, screenshot_mode string")).collect()
    assert [r["problems"] for r in out] == [[], ["unsafe_url", "max_pages", "max_depth", "screenshot_mode"], ["missing_url"], ["missing_url"]]
    assert (out[0]["normalized_url"], out[0]["max_pages"], out[0]["max_depth"], out[0]["screenshot_mode"]) == ("https://e.com/", 50, 5, "none")
    told = requests.alerts(spark.createDataFrame([(None, None), (500, False)], "score_drop int, on_new_p0 boolean")).collect()
    assert [tuple(r) for r in told] == [(5, True), (100, False)]
    slow = sitechecks.slowest_interactions(spark.createDataFrame([("s", "u", 5, "a"), ("s", "u", 9, "b")], "scan_id string, url string, duration int, element string"))
    assert slow.first()["element"] == "b"


def test_every_code_has_one_rule():
    listed = [r.code for r in rules.PER_PAGE + rules.FIRST_GOOD + rules.FIRST]
    assert len(listed) > 120 and {c for c in listed if listed.count(c) > 1} == {"missing_lang_attribute", "missing_og_description"}


def test_click_depths_of_a_long_chain(spark):
    node = spark.createDataFrame([("s", str(i), i) for i in range(14)], "scan_id string, node string, seq long")
    edge = spark.createDataFrame([("s", str(i), str(i + 1)) for i in range(13)] + [("s", "13", "0")], "scan_id string, src string, dst string")
    home = spark.createDataFrame([("s", "0", "e.com")], "scan_id string, home string, base_host string")
    depths = links.click_depths(node, edge, home)
    assert {r["node"]: r["depth"] for r in depths.collect()} == {str(i): i for i in range(14)}
    deep = [r["url"] for r in links.graph_issues(links.degrees(node, edge), depths, home).where("code = 'deep_page'").collect()]
    assert sorted(deep, key=int) == [str(i) for i in range(4, 14)]
