"""What the rules need of a page, as column expressions over its table of elements (dom.TREE).

Elements of a tag are a filter, what is inside an element is a slice, and what an element is inside
of is a bit, so each field takes time in proportion to the page (a subtree once for each element
around it of the same tag, of which there are dom.MAX_OPEN at most)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.functions.text import let
from siteloom.functions.wordlists import STATE_WORDS, STOP_WORDS
from siteloom.sources import dom

#: White space, as characters; as a class of patterns, in which ASCII is decided by one test; and
#: within ASCII, for text that spaced() has gone over.
_WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), *_WIDE]))
WIDE = r"[\x{80}-\x{3000}&&[" + "".join(f"\\x{{{x:x}}}" for x in _WIDE) + "]]"
PLAIN = r"\t-\r\x1c-\x20"
SPACE = f"[{PLAIN}{WIDE}]"
# Fixed value: endings of a host's name that are left out of its words.
ENDINGS = "(css|js|dev|app|io|hq|ai|ml)$"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NOT_PAGES = ("#", "javascript:", "mailto:", "tel:")
SHOWN = r"(?i)\b(modal|popup|overlay|lightbox|interstitial)\b"
HIDDEN_CLASS = r"(?i)\b(d-none|hidden|is-hidden|hide|ng-hide|sr-only|visually-hidden|invisible)\b"

#: Elements that many fields ask for; a page's are looked up once.
HELD = ("meta", "link", "script", "a", "img", "p", "h1", "body")

Make = Callable[[Column], Column]


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def spaced(x: Column) -> Column:
    """Text with plain spaces for all white space beyond ASCII."""
    return F.regexp_replace(x, WIDE, " ")


def filled(x: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(x, F.lit(""))


def first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def attr(x: Column, name: str) -> Column:
    return x["attrs"][name]


def given(x: Column, name: str) -> Column:
    return attr(x, name).isNotNull()


def said(x: Column, name: str) -> Column:
    """Whether an attribute is there and not empty."""
    return F.coalesce(attr(x, name) != "", F.lit(False))


def is_(x: Column, name: str, *values: str) -> Column:
    return F.coalesce(attr(x, name).isin(*values), F.lit(False))


def classed(x: Column, *names: str) -> Column:
    """Whether an element has one of the classes."""
    return F.coalesce(attr(x, "class").rlike(rf"(?:^|{SPACE})(?:{'|'.join(names)})(?:{SPACE}|$)"), F.lit(False))


def within(x: Column, kind: int) -> Column:
    return x["above"].bitwiseAND(F.lit(kind)) != 0


def own(x: Column, kind: int) -> Column:
    return x["own"].bitwiseAND(F.lit(kind)) != 0


def whole_number(x: Column) -> Column:
    return filled(F.regexp_extract(x, rf"^{SPACE}*([+-]?\d+)", 1)).try_cast("long")


class Page:
    """A page's elements and text, as expressions."""

    def __init__(self, nodes: Column, text: Column, held: Column | None = None):
        self.nodes, self.raw, self.held = nodes, text, held

    def tag(self, *names: str) -> Column:
        if self.held is not None and len(names) == 1 and names[0] in HELD:
            return self.held[names[0]]
        return F.filter(self.nodes, lambda x: x["tag"].isin(*names))

    @property
    def classes(self) -> Column:
        """The class attributes of all elements, one a line."""
        if self.held is not None:
            return self.held["classes"]
        return F.array_join(F.transform(self.nodes, lambda x: F.regexp_replace(attr(x, "class"), "\n", " ")), "\n")

    def under(self, x: Column) -> Column:
        """What is inside an element."""
        return F.slice(self.nodes, x["n"] + 1, x["last"] - x["n"])

    def span(self, start: Column, end: Column) -> Column:
        return F.substr(self.raw, start + 1, end - start).cast("string")

    def text(self, x: Column) -> Column:
        return F.coalesce(x["body"], self.span(x["t0"], x["t1"]))

    def without(self, start: Column, end: Column, left_out: Column) -> Column:
        """Text from start to end without that of elements, none of which is inside another."""
        starts = F.concat(F.array(start), F.transform(left_out, lambda x: x["t1"]))
        ends = F.concat(F.transform(left_out, lambda x: x["t0"]), F.array(end))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: self.span(a, b)), "")

    def text_less(self, x: Column, kind: int) -> Column:
        """An element's text without what is inside it of a kind; the element itself may be of it."""
        depth = x["above"].bitwiseOR(x["own"]).bitwiseAND(F.lit(kind))
        outermost = F.filter(self.under(x), lambda y: own(y, kind) & ~within(y, kind))
        return F.when(depth == 0, self.without(x["t0"], x["t1"], outermost)).otherwise(F.lit(""))


def last_of_runs(x: Column, key: str) -> Column:
    """Of sorted structs, the last one of each key."""
    return F.filter(x, lambda v, i: F.coalesce(F.get(x, i + 1)[key] != v[key], F.lit(True)))


def run_ends(s: Column) -> Column:
    """Places of the last of each run of equal items in a sorted array."""
    return F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i + 1) != F.get(s, i), F.lit(True)))).otherwise(F.array().cast("array<int>"))


def run_lengths(ends: Column) -> Column:
    return F.transform(ends, lambda i, k: i - F.coalesce(F.get(ends, k - 1), F.lit(-1)))


def counts(x: Column) -> Column:
    """A map from each string of an array to its number."""
    return let(F.sort_array(x), lambda s: let(run_ends(s), lambda e: F.map_from_arrays(F.transform(e, lambda i: F.get(s, i)), run_lengths(e))))


def own_words(url: Column) -> Column:
    """Words of the host and path, which a page may well repeat."""
    long = lambda x: F.filter(x, lambda w: F.length(w) > 2)
    named = long(F.split(F.regexp_replace(urls.hostname(url), r"^www\.", ""), "[.-]"))
    cores = F.filter(F.transform(named, lambda w: F.regexp_replace(w, ENDINGS, "")), lambda w: F.length(w) > 2)
    steps = F.transform(long(F.split(urls.path(url), "[/_-]")), F.lower)
    singular = F.transform(F.filter(steps, lambda w: w.endswith("s") & (F.length(w) > 3)), lambda w: F.regexp_replace(w, "s$", ""))
    return F.array_distinct(F.concat(named, cores, steps, singular))


def keyword(url: Column, text: Column) -> Column:
    """struct<word, n, total>: the most frequent word of a text that is neither common nor the
    site's own, the first among equals; its count, and the number of all words."""
    letters = F.regexp_replace(spaced(F.lower(text)), f"[^a-z{PLAIN}]", "")
    words = F.filter(F.split(letters, f"[{PLAIN}]+"), lambda w: F.length(w) > 2)

    def told(v: Column, s: Column, ends: Column, n: Column) -> Column:
        def of(most: Column) -> Column:
            top = F.transform(F.filter(ends, lambda i, k: F.get(n, k) == most), lambda i: F.get(s, i))
            word = first(F.array_intersect(v["words"], top))  # in the order of the text
            return F.struct(F.coalesce(word, F.lit("")).alias("word"), F.coalesce(most, F.lit(0)).alias("n"), F.size(v["words"]).alias("total"))

        return let(F.array_max(n), of)

    def of(v: Column) -> Column:
        free = F.filter(v["words"], lambda w: ~w.isin(*STOP_WORDS, *STATE_WORDS) & ~F.array_contains(v["own"], w))
        return let(F.sort_array(free), lambda s: let(run_ends(s), lambda e: let(run_lengths(e), lambda n: told(v, s, e, n))))

    return let(F.struct(words.alias("words"), own_words(url).alias("own")), of)


# -- parts of a page --------------------------------------------------------------------------


def _metas(p: Page) -> tuple[Make, Make]:
    """content(key, value) of the first such meta element, and whether there is one."""
    metas = p.tag("meta")
    find = lambda key, value: F.filter(metas, lambda x: is_(x, key, value))
    return (lambda key, value: F.coalesce(attr(first(find(key, value)), "content"), F.lit(""))), (lambda key, value: F.size(find(key, value)) > 0)


def headings(p: Page) -> Column:
    shown = F.filter(p.tag(*HEADINGS), lambda x: ~own(x, dom.CONCEALED) & ~within(x, dom.CONCEALED))
    return F.transform(shown, lambda x: F.struct(F.substring(x["tag"], 2, 1).cast("int").alias("level"), F.substring(strip(p.text(x)), 1, 200).alias("text")))


def social(p: Page) -> Column:
    """The og: and twitter: elements by name; of several the last."""
    property_, name = lambda x: F.coalesce(attr(x, "property"), F.lit("")), lambda x: F.coalesce(attr(x, "name"), F.lit(""))
    held = F.filter(p.tag("meta"), lambda x: property_(x).startswith("og:") | name(x).startswith("twitter:"))
    placed = F.transform(held, lambda x, i: F.struct(F.coalesce(filled(property_(x)), name(x)).alias("k"), i.alias("i"), filled(attr(x, "content")).alias("v")))
    return let(F.sort_array(placed), lambda s: let(last_of_runs(s, "k"), lambda e: F.map_from_arrays(F.transform(e, lambda x: x["k"]), F.transform(e, lambda x: x["v"]))))


def page_links(p: Page, url: Column) -> Column:
    """Links in the order in which their targets come first; of several to one target the last."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    followed = F.filter(p.tag("a"), lambda x: x["url"].isNotNull() & said(x, "href") & ~reduce(lambda a, b: a | b, (attr(x, "href").startswith(s) for s in NOT_PAGES)))

    def shown(x: Column) -> Column:
        alt = attr(first(F.filter(p.under(x), lambda y: (y["tag"] == "img") & given(y, "alt"))), "alt")
        return F.substring(strip(F.coalesce(filled(attr(x, "aria-label")), filled(attr(x, "title")), filled(alt), p.text(x))), 1, 100)

    def of(own_host: Column) -> Column:
        placed = F.transform(followed, lambda x, i: F.struct(x["url"].alias("href"), i.alias("i"), shown(x).alias("text"), (bare(urls.hostname(x["url"])) == own_host).alias("is_internal")))

        def ordered(s: Column) -> Column:
            begins = F.filter(s, lambda v, i: F.coalesce(F.get(s, i - 1)["href"] != v["href"], F.lit(True)))
            runs = F.zip_with(begins, last_of_runs(s, "href"), lambda a, b: F.struct(a["i"].alias("i"), b["href"].alias("href"), b["text"].alias("text"), b["is_internal"].alias("is_internal")))
            return F.transform(F.sort_array(runs), lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["is_internal"].alias("is_internal")))

        return let(F.sort_array(placed), ordered)

    return let(bare(urls.hostname(url)), of)


def interstitials(p: Page) -> Column:
    """Names of elements that lie over the page when it opens."""

    def fits(x: Column) -> Column:
        style = F.lower(F.coalesce(attr(x, "style"), F.lit("")))
        hidden = given(x, "hidden") | is_(x, "aria-hidden", "true") | ((x["tag"] == "dialog") & ~given(x, "open")) | style.rlike("display: ?none|visibility: ?hidden")
        return (F.coalesce(attr(x, "class"), F.lit("")).rlike(SHOWN) | F.coalesce(attr(x, "id"), F.lit("")).rlike(SHOWN)) & ~hidden & ~F.coalesce(attr(x, "class"), F.lit("")).rlike(HIDDEN_CLASS) & style.rlike("position: ?fixed")

    named = lambda x, k: filled(F.regexp_extract(attr(x, k), SHOWN, 1))
    over = F.transform(F.filter(p.nodes, fits), lambda x: F.lower(F.coalesce(named(x, "class"), named(x, "id"))))
    dialogs = F.transform(F.filter(p.tag("dialog"), lambda x: given(x, "open")), lambda x: F.lit("dialog"))
    return F.array_distinct(F.concat(over, dialogs))


def markup_bytes(p: Page) -> Column:
    """About the bytes of all svg elements, each with what is inside it."""

    def size(x: Column) -> Column:
        each = lambda y: 2 * F.length(y["tag"]) + 5 + F.octet_length(F.coalesce(y["body"], F.lit(""))) + F.aggregate(F.map_entries(y["attrs"]), F.lit(0), lambda s, e: s + F.length(e["key"]) + F.octet_length(e["value"]) + 4)
        return F.aggregate(F.concat(F.array(x), p.under(x)), x["t1"] - x["t0"], lambda s, y: s + each(y))

    return F.aggregate(p.tag("svg"), F.lit(0).cast("long"), lambda s, x: s + size(x))


def intro(p: Page) -> Column:
    """Characters of the first paragraph behind the first h1, beside it; null without an h1."""

    def of(h: Column) -> Column:
        after = F.filter(p.nodes, lambda x: (x["tag"] == "p") & (x["parent"] == h["parent"]) & (x["n"] > h["n"]))
        return F.when(h.isNotNull(), F.coalesce(F.length(strip(p.text(first(after)))), F.lit(0)))

    return let(first(p.tag("h1")), of)


def main_text(p: Page, body: Column) -> Column:
    """The text of main elements, or of the body, without what stands beside it."""

    def is_main(x: Column) -> Column:
        return (x["tag"].isin("main", "article") | is_(x, "role", "main") | classed(x, "content", "post", "entry")) & ~own(x, dom.BESIDE) & ~within(x, dom.BESIDE)

    of = lambda found: F.array_join(F.transform(found, lambda x: p.text_less(x, dom.BESIDE)), "")
    return let(F.filter(p.nodes, is_main), lambda mains: F.when(F.size(mains) > 0, of(mains)).when(body.isNotNull(), p.text_less(body, dom.BESIDE)).otherwise(F.lit("")))


def flags(p: Page, has_meta: Make, rel: Make) -> dict[str, Column]:
    """Marks of authors, dates, trust and structure."""
    any_node = lambda test: F.exists(p.nodes, test)
    has_class = lambda *names: p.classes.rlike(rf"(?:^|{SPACE})(?:{'|'.join(names)})(?:{SPACE}|$)")
    part = lambda *parts: reduce(lambda a, b: a | b, (p.classes.contains(s) for s in parts))
    with_class = lambda x, name: F.coalesce(attr(x, "class").contains(name), F.lit(False))
    some = lambda found: F.size(found) > 0
    asked = F.transform(p.tag("h2", "h3"), lambda x: strip(p.text(x)))
    faq = lambda t: t.rlike(rf"(?i)^{SPACE}*faq")
    steps = F.size(F.filter(asked, lambda t: t.rlike(rf"(?i)^step{SPACE}*\d")))
    ordered = F.exists(p.tag("ol"), lambda x: F.size(F.filter(p.under(x), lambda y: y["tag"] == "li")) >= 3)
    items = lambda kind: F.size(F.filter(p.tag("li"), lambda x: within(x, kind)))
    title = F.array_join(F.transform(p.tag("h1"), p.text), "")
    review = lambda x: classed(x, "review", "reviews", "star-rating") | is_(x, "itemprop", "review", "reviewRating") | given(x, "data-rating")
    dated = any_node(lambda x: (x["tag"] == "time") & given(x, "datetime"))
    return {
        "meta_author": has_meta("name", "author"), "rel_author": any_node(lambda x: is_(x, "rel", "author")),
        "author_class": has_class("author", "byline") | part("author") | any_node(lambda x: given(x, "data-author")),
        "author_name": has_class("author", "byline") | part("author"), "author_item": any_node(lambda x: is_(x, "itemprop", "author")),
        "author_bio": part("author-bio", "author-info"), "date_markup": any_node(lambda x: is_(x, "itemprop", "datePublished")) | dated | has_class("published", "post-date"),
        "published_meta": has_meta("property", "article:published_time"), "modified_meta": has_meta("property", "article:modified_time"), "time_datetime": dated,
        "contact_class": part("contact"), "contact_text": F.exists(p.tag("a"), lambda x: F.lower(p.text(x)).contains("contact")),
        "testimonials": has_class("testimonial", "testimonials", "review", "reviews") | part("testimonial", "customer-review", "customer-quote") | F.exists(p.tag("blockquote"), lambda x: classed(x, "quote")),
        "logos": has_class("logos", "client-logos", "partner-logos", "trusted-by") | part("logo-wall", "client-logo", "as-seen"), "stats": has_class("stats", "numbers") | part("stat-", "metric", "counter"),
        "manifest": said(first(rel("manifest")), "href"), "theme_color": has_meta("name", "theme-color"), "touch_icon": some(rel("apple-touch-icon", "apple-touch-icon-precomposed")),
        "faq_class": part("faq"), "faq_headings": (F.size(F.filter(asked, lambda t: t.endswith("?") | faq(t))) >= 3) | F.exists(asked, faq),
        "howto": (steps >= 3) | any_node(lambda x: with_class(x, "step") & with_class(x, "instruction")) | F.exists(p.tag("ol"), lambda x: classed(x, "steps")) | (ordered & title.rlike(rf"(?i)how({SPACE}|-)?to")),
        "reviews": F.size(F.filter(p.nodes, review)) >= 2, "breadcrumbs": part("breadcrumb") | any_node(lambda x: is_(x, "aria-label", "breadcrumb")),
        "numbered_list": items(dom.ORDERED) >= 3, "bullet_list": items(dom.BULLETS) >= 3, "blockquote": some(p.tag("blockquote")),
        "srcset": any_node(lambda x: given(x, "srcset")), "picture": some(p.tag("picture")), "preload": some(rel("preload")), "preconnect": some(rel("preconnect")),
    }


def page_fields(tree: Column, url: Column, names: tuple[str, ...]) -> Column:
    """A struct of those parsed columns (pages.PARSED) of a page that are named."""

    def held(v: Column) -> Column:
        p = Page(v["nodes"], v["text"])
        return F.struct(*(p.tag(t).alias(t) for t in HELD), p.classes.alias("classes"))

    page = F.struct(tree["nodes"].alias("nodes"), tree["text"].alias("text"), F.coalesce(url, F.lit("")).alias("url"))
    return let(page, lambda v: let(held(v), lambda h: _fields(Page(v["nodes"], v["text"], h), v["url"], names)))


def _fields(p: Page, url: Column, names: tuple[str, ...]) -> Column:
    content, has_meta = _metas(p)
    rels = p.tag("link")
    rel = lambda *values: F.filter(rels, lambda x: is_(x, "rel", *values))
    body = first(p.tag("body"))
    tell = lambda x, *keys: [attr(x, k).alias(k) for k in keys]
    every = lambda name, make: F.transform(p.tag(name), make)
    area = F.filter(p.nodes, lambda x: own(x, dom.AREA))
    kind = lambda x: F.lower(F.coalesce(attr(x, "type"), F.lit("text")))
    labelled = lambda x: said(x, "aria-label") | said(x, "aria-labelledby") | own(x, dom.NAMED) | within(x, dom.LABEL)
    outside = lambda x: F.coalesce(attr(x, "href").startswith("http") & (urls.hostname(attr(x, "href")) != "") & (urls.hostname(attr(x, "href")) != urls.hostname(url)), F.lit(False))
    shown = lambda x: ~own(x, dom.CHROME) & ~within(x, dom.CHROME)
    read = F.array_join(F.transform(area, p.text), "")
    page = F.filter(p.nodes, lambda x: own(x, dom.CHROME) & ~within(x, dom.CHROME))
    parsed = {
        "title": lambda: filled(strip(p.text(first(p.tag("title"))))), "meta_description": lambda: filled(strip(content("name", "description"))), "h1": lambda: filled(strip(p.text(first(p.tag("h1"))))),
        "canonical": lambda: filled(attr(first(rel("canonical")), "href")), "robots_meta": lambda: filled(content("name", "robots")),
        "word_count": lambda: F.coalesce(F.regexp_count(spaced(p.text(body)), F.lit(f"[^{PLAIN}]+")), F.lit(0)),
        "headings": lambda: headings(p), "images": lambda: F.transform(F.filter(p.tag("img"), lambda x: said(x, "src")), lambda x: F.struct(*tell(x, "src", "alt", "width", "height"))),
        "og_tags": lambda: social(p), "viewport": lambda: filled(content("name", "viewport")), "script_count": lambda: F.size(F.filter(p.tag("script"), lambda x: given(x, "src"))), "stylesheet_count": lambda: F.size(rel("stylesheet")),
        "lang": lambda: filled(attr(first(p.tag("html")), "lang")), "favicon": lambda: first(rel(*dom.ICONS))["url"], "links": lambda: page_links(p, url),
    }
    if "dom" not in names:
        return F.struct(*(parsed[k]().alias(k) for k in names))
    dug = {
        "node_count": F.size(p.nodes), "max_depth": F.when(body.isNotNull(), F.least(F.lit(50), F.aggregate(p.under(body), body["depth"], lambda s, x: F.greatest(s, x["depth"])) - body["depth"])).otherwise(0),
        "tag_counts": counts(F.transform(p.nodes, lambda x: x["tag"])), "anchors": every("a", lambda x: F.struct(*tell(x, "href", "target", "rel"))),
        "imgs": every("img", lambda x: F.struct(attr(x, "src").alias("src"), attr(x, "data-src").alias("data_src"), whole_number(attr(x, "width")).alias("width"), whole_number(attr(x, "height")).alias("height"), attr(x, "loading").alias("loading"), within(x, dom.PICTURE).alias("in_picture"), within(x, dom.MODERN).alias("modern"))),
        "sources": F.transform(F.filter(p.tag("source"), lambda x: within(x, dom.PICTURE)), lambda x: F.struct(*tell(x, "type", "srcset"), within(x, dom.MODERN).alias("modern"))),
        "scripts": every("script", lambda x: F.struct(*tell(x, "src", "type", "id"), (given(x, "async") | given(x, "defer")).alias("deferred"), attr(x, "integrity").alias("integrity"), within(x, dom.HEAD).alias("in_head"), F.when(~given(x, "src"), x["body"]).alias("text"))),
        "rels": F.transform(rels, lambda x: F.struct(*tell(x, "rel", "href", "media"), attr(x, "as").alias("as_"), attr(x, "imagesrcset").alias("imagesrcset"), within(x, dom.HEAD).alias("in_head"))),
        "styles": every("style", lambda x: x["body"]), "iframes": every("iframe", lambda x: F.struct(*tell(x, "src", "title"))),
        "inputs": every("input", lambda x: F.struct(kind(x).alias("type"), F.coalesce(filled(attr(x, "name")), filled(attr(x, "id")), kind(x)).alias("name"), labelled(x).alias("labelled"))),
        "jsonld": F.transform(F.filter(p.tag("script"), lambda x: is_(x, "type", "application/ld+json")), lambda x: x["body"]), "svg_bytes": markup_bytes(p), "interstitials": interstitials(p),
        "content_words": F.regexp_count(spaced(read), F.lit(f"[{PLAIN}]+")) + 1, "external_links": F.transform(F.filter(p.tag("a"), lambda x: within(x, dom.AREA) & outside(x)), lambda x: attr(x, "href")),
        "paragraph_text": F.array_join(F.transform(F.filter(p.tag("p"), lambda x: within(x, dom.AREA)), p.text), " "), "intro_length": intro(p),
        "heading_text": F.lower(F.array_join(F.transform(F.filter(p.tag("title", "h1", "h2", "h3"), shown), lambda x: p.text_less(x, dom.CHROME)), "")),
        "keyword": keyword(url, p.without(F.lit(0), F.octet_length(p.raw), page)), "main_text": main_text(p, body),
    }
    marks = flags(p, has_meta, rel)
    told = F.map_from_arrays(F.array(*map(F.lit, marks)), F.array(*(F.coalesce(v, F.lit(False)) for v in marks.values())))
    return F.struct(*(parsed[k]().alias(k) for k in names if k != "dom"), F.struct(*(v.alias(k) for k, v in dug.items()), told.alias("flags")).alias("dom"))
