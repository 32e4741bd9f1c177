"""URL functions as column expressions. Five normalisers exist on purpose: each feature that
compares URLs has its own rules, and results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it; as text.let."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Query parameters that only track a visit.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid fb_action_ids fb_action_types fb_source gclid gclsrc dclid msclkid mc_cid mc_eid _hsenc _hsmi __hstc __hsfp __hssc ref referer referrer _ga _gl trk trkInfo si igshid share_source".split()
# Path parts of pages behind a login.
AUTH_PARTS = ["/dashboard", "/admin", "/account", "/settings", "/profile", "/billing", "/app/", "/console", "/portal", "/my-", "/user/", "/member/"]
# URLs that a crawl leaves out.
EXCLUDED = [r"/wp-admin", r"/admin", r"/login", r"/logout", r"/account", r"/cart", r"/checkout", r"\.(pdf|jpg|jpeg|png|gif|svg|webp|ico|mp4|mp3|zip|tar|gz)$", r"\?.*logout", r"/feed/?$", r"/rss/?$", r"/api/", r"/_next/", r"/\.well-known/"]
# Names of metadata services, and endings of private networks.
BLOCKED_HOSTS = ["metadata.aws.internal", "instance-data.ec2.internal", "metadata.google.internal", "metadata", "metadata.azure.com", "metadata.oraclecloud.com"]
PRIVATE_ENDINGS = [".local", ".internal", ".corp", ".lan", ".home", ".localdomain"]
UNSAFE_SCHEMES = ["file:", "ftp:", "javascript:", "data:", "blob:", "about:", "chrome:", "view-source:"]

PARTS = r"^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"
ARTICLE, HUB, LISTING = r"/blog/|/article/|/post/|/news/|/\d{4}/\d{2}/", r"/(news|blog|articles?)/?$", r"/(topics|categories|tags|recently-published|media-contacts)/"
PAGINATION = r"[?&]page=\d+|/page/\d+|/p/\d+|[?&]p=\d+|[?&]offset=\d+|/\d+/?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?is)" + PARTS, group)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?is)" + PARTS), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def hostname(url: Column) -> Column:
    """Lower-case host without port; empty if url is none."""
    return F.coalesce(F.lower(_part(url, 2)), F.lit(""))


def port(url: Column) -> Column:
    """":port" unless it is the scheme's own."""
    n = _part(url, 3)
    own = ((scheme(url) == "https") & (n == "443")) | ((scheme(url) == "http") & (n == "80"))
    return F.when((n == "") | own, "").otherwise(F.concat(F.lit(":"), n))


def path(url: Column) -> Column:
    """"/" for an empty path; empty if url is none."""
    return F.when(is_url(url), F.coalesce(F.nullif(_part(url, 4), F.lit("")), F.lit("/"))).otherwise("")


def search(url: Column) -> Column:
    """"?query", or empty (also for a lone question mark)."""
    return F.coalesce(F.regexp_replace(_part(url, 5), r"^\?$", ""), F.lit(""))


def fragment(url: Column) -> Column:
    return F.coalesce(_part(url, 6), F.lit(""))


def origin(url: Column) -> Column:
    return F.when(is_url(url), F.concat(scheme(url), F.lit("://"), hostname(url), port(url)))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_homepage(url: Column) -> Column:
    return path(url) == "/"


def is_internal(url: Column, base_host: Column) -> Column:
    return is_url(url) & (without_www(hostname(url)) == without_www(F.lower(base_host)))


def normalize(url: Column) -> Column:
    """Canonical form: https, no www, no fragment, sorted query, no closing slash; null if invalid."""
    text = F.trim(url)
    https = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")))
    tail = F.when(path(https) == "/", "/").otherwise(F.regexp_replace(path(https), "/$", ""))
    pairs = F.filter(F.split(F.substr(search(https), F.lit(2)), "&"), lambda p: p != "")
    name = lambda p: F.split(p, "=")[0]
    ordered = F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise("")
    return F.when(is_url(https), F.concat(F.lit("https://"), without_www(hostname(https)), port(https), tail, query))


def strip_tracking(url: Column) -> Column:
    """Without tracking parameters; the url itself where it is none."""
    pairs = F.filter(F.split(F.substr(search(url), F.lit(2)), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.split(p, "=")[0].isin(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(is_url(url), F.concat(origin(url), path(url), query, fragment(url))).otherwise(url)


def for_compare(url: Column) -> Column:
    """Origin and path in lower case without closing slashes (sitemap checks)."""
    whole = F.when(is_url(url), F.concat(origin(url), path(url))).otherwise(url)
    return F.lower(F.regexp_replace(whole, "/+$", ""))


def for_graph(url: Column) -> Column:
    """Origin, path without one closing slash, query (link graph); null if invalid."""
    # The address is taken apart once, as plans copy plain expressions into each of their uses.
    parts = F.struct(is_url(url).alias("is_url"), _part(url, 1).alias("scheme"), hostname(url).alias("host"), _part(url, 3).alias("port"), _part(url, 4).alias("path"), search(url).alias("search"))

    def of(v: Column) -> Column:
        own = ((F.lower(v["scheme"]) == "https") & (v["port"] == "443")) | ((F.lower(v["scheme"]) == "http") & (v["port"] == "80"))
        port = F.when((v["port"] == "") | own, "").otherwise(F.concat(F.lit(":"), v["port"]))
        tail = F.when(v["path"].isin("", "/"), "/").otherwise(F.regexp_replace(v["path"], "/$", ""))
        return F.when(v["is_url"], F.concat(F.lower(v["scheme"]), F.lit("://"), v["host"], port, tail, v["search"]))

    return let(parts, of)


def for_hreflang(url: Column) -> Column:
    """Scheme, host without www, path; lower case, no closing slashes."""
    whole = F.when(is_url(url), F.concat(scheme(url), F.lit("://"), without_www(hostname(url)), path(url))).otherwise(url)
    return F.lower(F.regexp_replace(whole, "/+$", ""))


def for_map(url: Column) -> Column:
    """Origin and path without closing slashes (map of a crawl)."""
    tail = F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(is_url(url), F.concat(origin(url), tail)).otherwise(url)


def is_excluded(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(EXCLUDED))


def _private_v4(a: Column, b: Column, c: Column) -> Column:
    return (
        a.isin(0, 10, 127) | (a >= 224)
        | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )


def _private_dotted(ip: Column) -> Column:
    octets = lambda x: F.transform(F.split(x, r"\."), lambda o: o.try_cast("long"))
    private = let(octets(ip), lambda o: _private_v4(F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.get(o, F.lit(2))))
    return F.coalesce(ip.rlike(r"^\d+\.\d+\.\d+\.\d+$") & private, F.lit(False))


def is_safe(url: Column) -> Column:
    """Whether a URL may be fetched: http(s), and no local, private or metadata host."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    # The address is taken apart once, as plans copy plain expressions into each of their uses.
    parts = F.struct(F.trim(F.lower(url)).alias("lower"), hostname(full).alias("host"), scheme(full).alias("scheme"), is_url(full).alias("is_url"))
    return let(parts, lambda v: _is_safe(v["lower"], v["host"], v["scheme"], v["is_url"]))


def _is_safe(lower: Column, host: Column, scheme: Column, is_url: Column) -> Column:
    ip6 = F.regexp_replace(host, r"^\[|\]$", "")
    mapped = F.regexp_extract(ip6, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    word = lambda k: F.conv(F.regexp_extract(ip6, r"^::ffff:([0-9a-f]+):([0-9a-f]+)$", k), 16, 10).try_cast("long")
    byte = lambda w, s: F.shiftright(w, s).bitwiseAND(F.lit(255))
    hexed = F.coalesce(ip6.rlike(r"^::ffff:[0-9a-f]+:[0-9a-f]+$") & _private_v4(byte(word(1), 8), byte(word(1), 0), byte(word(2), 8)), F.lit(False))
    v6 = host.startswith("[") & ((ip6 == "::1") | _private_dotted(mapped) | hexed | ip6.rlike("^(fc|fd|fe[89a-f])"))
    bad = F.lit(False)
    for s in UNSAFE_SCHEMES:
        bad = bad | lower.startswith(s)
    for h in BLOCKED_HOSTS:
        bad = bad | (host == h) | host.endswith("." + h)
    for e in PRIVATE_ENDINGS:
        bad = bad | host.endswith(e)
    bad = bad | host.isin("localhost", "0.0.0.0") | _private_dotted(host) | v6
    return F.coalesce(is_url & scheme.isin("http", "https") & ~bad, F.lit(False))


def disallowed(url: Column, patterns: Column) -> Column:
    """Whether any robots pattern (array) covers the path: "*" matches anything up to the end,
    other patterns are prefixes."""
    p = path(url)
    return F.coalesce(F.exists(patterns, lambda x: F.when(F.contains(x, F.lit("*")), F.rlike(p, F.concat(F.lit("^"), F.replace(x, F.lit("*"), F.lit(".*")), F.lit("$")))).otherwise(p.startswith(x))), F.lit(False))


def is_auth_page(url: Column, patterns: Column | None = None) -> Column:
    lower = F.lower(path(url))
    found = disallowed(url, patterns) if patterns is not None else F.lit(False)
    for part in AUTH_PARTS:
        found = found | lower.contains(part)
    return found


def is_article(url: Column) -> Column:
    return url.rlike("(?i)" + ARTICLE) & ~path(url).rlike("(?i)" + HUB) & ~url.rlike("(?i)" + LISTING)


def display(url: Column) -> Column:
    """Host and path, without the path of a homepage."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(is_url(full), F.concat(hostname(full), F.when(path(full) == "/", "").otherwise(path(full)))).otherwise(url)


def shorten(url: Column, size: int = 40) -> Column:
    shown = F.when(is_url(url), F.when(path(url) == "/", hostname(url)).otherwise(F.concat(hostname(url), path(url)))).otherwise(url)
    return F.when(F.length(shown) > size, F.concat(F.substring(shown, 1, size - 1), F.lit("…"))).otherwise(shown)


def status_colour(code: Column) -> Column:
    return F.when(code.isNull(), "#64748b").when(code.between(200, 299), "#34d399").when(code.between(300, 399), "#fbbf24").otherwise("#ef4444")
