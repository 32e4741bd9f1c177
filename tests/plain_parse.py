"""What the parse must give of a page, walked node by node over the tree: the brute-force version
of the column expressions."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from siteloom.functions.wordlists import STATE_WORDS, STOP_WORDS
from siteloom.sources.dom import Node, host, parse, resolve

_WORD_RE = re.compile(r"\s+")
_MODERN = re.compile(r"\.(webp|avif)(\?|$)", re.I)
_INTERSTITIAL = re.compile(r"\b(modal|popup|overlay|lightbox|interstitial)\b", re.I | re.A)
_HIDDEN_CLASS = re.compile(r"\b(d-none|hidden|is-hidden|hide|ng-hide|sr-only|visually-hidden|invisible)\b", re.I | re.A)
_CHROME = frozenset("nav header footer aside script style".split())
_CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo"))
_SIMILAR_DROPPED = frozenset("script style noscript nav footer header aside".split())
_SIMILAR_CLASSES = frozenset("nav navigation header footer sidebar menu cookie-banner cookie-notice".split())


def _find(node, test):
    nodes = node.walk()
    next(nodes)
    return [n for n in nodes if test(n)]


def _ancestors(node, own=False):
    at = node if own else node.parent
    while at is not None:
        yield at
        at = at.parent


def _text(node, skip=lambda n: False):
    out, stack = [], [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                out.append(child)
            elif child.tag not in ("script", "style") and not skip(child):
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
    return "".join(out)


def _classes(n):
    return (n.attrs.get("class") or "").split()


def _int(value: str | None) -> int | None:
    found = re.match(r"\s*([+-]?\d+)", value or "")
    return int(found[1]) if found and abs(int(found[1])) < 1 << 63 else None


def _serialised(node: Node) -> int:
    """About the bytes of an element's markup."""
    total = 0
    for n in node.walk():
        total += 2 * len(n.tag) + 5 + sum(len(k) + len((v or "").encode()) + 4 for k, v in n.attrs.items())
        total += sum(len(c.encode()) for c in n.children if isinstance(c, str))
    return total


_COMMON = frozenset(STOP_WORDS + STATE_WORDS)
# Fixed value: endings of a host's name that are left out of its words.
_ENDINGS = re.compile("(css|js|dev|app|io|hq|ai|ml)$")
_NOT_LETTER = re.compile("[^a-z]")


def _under(roots) -> tuple[set[int], set[int]]:
    """The ids of the nodes at and below the roots, and of the outermost roots; these come in
    the order of the page."""
    out: set[int] = set()
    outermost = set()
    for n in roots:
        if id(n) not in out:
            outermost.add(id(n))
            out.update(id(x) for x in n.walk())
    return out, outermost


def brand_words(url: str) -> set[str]:
    """Words of the host and path, which a page may well repeat."""
    own: set[str] = set()
    for part in re.split("[.-]", (host(url) or "").removeprefix("www.")):
        if len(part) > 2:
            core = _ENDINGS.sub("", part)
            own |= {part} | ({core} if len(core) >= 3 else set())
    for step in re.split("[/_-]", urlsplit(url).path if host(url) else ""):
        if len(step) > 2:
            own |= {step.lower()} | ({step.lower()[:-1]} if step.lower().endswith("s") and len(step) > 3 else set())
    return own


def keyword(url: str, text: str) -> dict:
    """The most frequent word of a text that is neither common nor the site's own, the first
    among equals; its count and the number of all words."""
    every = [w for w in (_NOT_LETTER.sub("", x) for x in text.lower().split()) if len(w) > 2]
    own = brand_words(url)
    counts: dict[str, int] = {}
    for w in every:
        if w not in _COMMON and w not in own:
            counts[w] = counts.get(w, 0) + 1
    word = max(counts, key=counts.__getitem__) if counts else ""
    return {"word": word, "n": counts.get(word, 0), "total": len(every)}


def extract(url: str, html: str) -> dict:
    """Everything the rules need from a page, as a dict in the shape of pages.DOM."""
    root = parse(html)
    nodes = [n for n in root.walk() if n.tag != "#document"]
    by: dict[str, list[Node]] = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    tag = lambda *names: [n for t in names for n in by.get(t, ())] if len(names) == 1 else sorted((n for t in names for n in by.get(t, ())), key=lambda n: n.order)
    first = lambda found: found[0] if found else None
    text = lambda n: _text(n).strip() if n else ""
    inside = lambda n, *names: any(a.tag in names for a in _ancestors(n))
    meta = lambda key, value: [m for m in tag("meta") if m.get(key) == value]
    content = lambda found: (found[0].get("content") or "") if found else ""
    rel = lambda value: [x for x in tag("link") if x.get("rel") == value]
    body = first(tag("body"))

    headings = [
        {"level": int(h.tag[1]), "text": text(h)[:200]}
        for h in tag("h1", "h2", "h3", "h4", "h5", "h6")
        if not any(a.tag == "dialog" or a.get("role") in ("dialog", "alertdialog") or a.get("aria-hidden") == "true" for a in _ancestors(h, True))
    ]
    og: dict[str, str | None] = {}
    for m in tag("meta"):
        if (m.get("property") or "").startswith("og:") or (m.get("name") or "").startswith("twitter:"):
            og[m.get("property") or m.get("name")] = m.get("content") or None
    icon = first([x for x in tag("link") if x.get("rel") in ("icon", "shortcut icon", "apple-touch-icon")])

    links: dict[str, dict] = {}
    base_host = (host(url) or "").removeprefix("www.")
    for a in tag("a"):
        href = a.get("href")
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        target = resolve(href, url)
        if target:
            alt = next((i.get("alt") for i in _find(a, lambda n: n.tag == "img" and "alt" in n.attrs)), None)
            shown = a.get("aria-label") or a.get("title") or alt or _text(a)
            links[target] = {"href": target, "text": shown.strip()[:100], "is_internal": (host(target) or "").removeprefix("www.") == base_host}

    modern = lambda s: bool(re.search("webp|avif", s.get("type") or "", re.I) or _MODERN.search(s.get("srcset") or ""))
    picture = {id(p): any(modern(s) for s in _find(p, lambda n: n.tag == "source")) for p in tag("picture")}

    def of_picture(n: Node) -> tuple[bool, bool]:
        p = next((a for a in _ancestors(n) if a.tag == "picture"), None)
        return p is not None, p is not None and picture[id(p)]

    labels = {x.get("for") for x in tag("label") if x.get("for")}
    inputs = []
    for i in tag("input"):
        own = bool(i.get("aria-label") or i.get("aria-labelledby") or (i.get("id") and i.get("id") in labels) or inside(i, "label"))
        kind = (i.get("type") if i.get("type") is not None else "text").lower()
        inputs.append({"type": kind, "name": i.get("name") or i.get("id") or kind, "labelled": own})

    depth, stack = 0, [(body, 0)] if body else []
    while stack:
        node, d = stack.pop()
        depth = max(depth, d)
        if d < 50:
            stack += [(c, d + 1) for c in node.children if isinstance(c, Node)]

    interstitials = []
    for n in nodes:
        given_class, given_id = n.get("class") or "", n.get("id") or ""
        found = _INTERSTITIAL.search(given_class) or _INTERSTITIAL.search(given_id)
        style = (n.get("style") or "").lower()
        if not found or "hidden" in n.attrs or n.get("aria-hidden") == "true" or (n.tag == "dialog" and "open" not in n.attrs):
            continue
        if re.search(r"display: ?none|visibility: ?hidden", style) or _HIDDEN_CLASS.search(given_class) or not re.search(r"position: ?fixed", style):
            continue
        interstitials.append(found[1].lower())
    interstitials += ["dialog" for d in tag("dialog") if "open" in d.attrs]

    area = [n for n in nodes if n.tag in ("article", "main") or "content" in _classes(n) or n.get("role") == "main"]
    in_area, outermost = _under(area)
    in_area -= outermost
    own_host = host(url)
    external = [a.get("href") for a in tag("a") if id(a) in in_area and (a.get("href") or "").startswith("http") and host(a.get("href")) not in (None, own_host)]
    paragraphs = [p for p in tag("p") if id(p) in in_area]

    h1 = first(tag("h1"))
    intro = None
    if h1 is not None:
        later = [c for c in h1.parent.children if isinstance(c, Node) and c.order > h1.order and c.tag == "p"]
        intro = len(text(later[0])) if later else 0

    chrome = lambda n: n.tag in _CHROME or n.get("role") in _CHROME_ROLES
    hidden, _ = _under(n for n in nodes if chrome(n))
    heading_text = "".join(_text(n, chrome) for n in tag("title", "h1", "h2", "h3") if id(n) not in hidden)
    similar = lambda n: n.tag in _SIMILAR_DROPPED or n.get("role") in _CHROME_ROLES or bool(_SIMILAR_CLASSES & set(_classes(n)))
    gone, _ = _under(n for n in nodes if similar(n))
    mains = [n for n in nodes if id(n) not in gone and (n.tag in ("main", "article") or n.get("role") == "main" or {"content", "post", "entry"} & set(_classes(n)))]
    main_text = "".join(_text(n, similar) for n in mains) if mains else _text(body, similar) if body and id(body) not in gone else ""

    has_class = lambda *names: any(c in _classes(n) for n in nodes for c in names)
    part = lambda *parts: any((p in (n.get('class') or '')) for n in nodes for p in parts)
    steps = sum(bool(re.match(r"step\s*\d", text(h), re.I)) for h in tag("h2", "h3"))
    ordered = any(len(_find(o, lambda n: n.tag == "li")) >= 3 for o in tag("ol"))
    items = lambda name: sum(inside(li, name) for li in tag("li"))
    questions = [text(h) for h in tag("h2", "h3") if text(h).endswith("?") or re.match(r"\s*faq", text(h), re.I)]
    flags = {
        "meta_author": bool(meta("name", "author")), "rel_author": any(n.get("rel") == "author" for n in nodes),
        "author_class": has_class("author", "byline") or part("author") or any("data-author" in n.attrs for n in nodes),
        "author_name": has_class("author", "byline") or part("author"), "author_item": any(n.get("itemprop") == "author" for n in nodes),
        "author_bio": part("author-bio", "author-info"),
        "date_markup": any(n.get("itemprop") == "datePublished" for n in nodes) or any("datetime" in t.attrs for t in tag("time")) or has_class("published", "post-date"),
        "published_meta": bool(meta("property", "article:published_time")), "modified_meta": bool(meta("property", "article:modified_time")),
        "time_datetime": any("datetime" in t.attrs for t in tag("time")),
        "contact_class": part("contact"), "contact_text": any("contact" in _text(a).lower() for a in tag("a")),
        "testimonials": has_class("testimonial", "testimonials", "review", "reviews") or part("testimonial", "customer-review", "customer-quote") or any("quote" in _classes(b) for b in tag("blockquote")),
        "logos": has_class("logos", "client-logos", "partner-logos", "trusted-by") or part("logo-wall", "client-logo", "as-seen"),
        "stats": has_class("stats", "numbers") or part("stat-", "metric", "counter"),
        "manifest": bool(rel("manifest")) and bool(rel("manifest")[0].get("href")), "theme_color": bool(meta("name", "theme-color")),
        "touch_icon": bool(rel("apple-touch-icon") or rel("apple-touch-icon-precomposed")),
        "faq_class": part("faq"), "faq_headings": len(questions) >= 3 or any(re.match(r"\s*faq", q, re.I) for q in questions),
        "howto": steps >= 3 or any(("step" in (n.get('class') or '')) and ("instruction" in (n.get('class') or '')) for n in nodes) or any("steps" in _classes(o) for o in tag("ol")) or (ordered and bool(re.search(r"how[\s-]?to", "".join(_text(h) for h in tag("h1")), re.I))),
        "reviews": sum(bool({"review", "reviews", "star-rating"} & set(_classes(n))) or n.get("itemprop") in ("review", "reviewRating") or "data-rating" in n.attrs for n in nodes) >= 2,
        "breadcrumbs": part("breadcrumb") or any(n.get("aria-label") == "breadcrumb" for n in nodes),
        "numbered_list": items("ol") >= 3, "bullet_list": items("ul") >= 3, "blockquote": bool(tag("blockquote")),
        "srcset": any("srcset" in n.attrs for n in nodes), "picture": bool(tag("picture")),
        "preload": bool(rel("preload")), "preconnect": bool(rel("preconnect")),
    }
    words = _WORD_RE.sub(" ", _text(body) if body else "").strip()
    return {
        "title": text(first(tag("title"))) or None,
        "meta_description": content(meta("name", "description")).strip() or None,
        "h1": text(h1) or None,
        "canonical": (rel("canonical")[0].get("href") if rel("canonical") else None) or None,
        "robots_meta": content(meta("name", "robots")) or None,
        "word_count": len(words.split(" ")) if words else 0,
        "headings": headings,
        "images": [{k: i.get(k) for k in ("src", "alt", "width", "height")} for i in tag("img") if i.get("src")],
        "og_tags": og,
        "viewport": content(meta("name", "viewport")) or None,
        "script_count": sum("src" in s.attrs for s in tag("script")),
        "stylesheet_count": len(rel("stylesheet")),
        "lang": (tag("html")[0].get("lang") if tag("html") else None) or None,
        "favicon": resolve(icon.get("href"), url) if icon and icon.get("href") else None,
        "links": list(links.values()),
        "dom": {
            "node_count": len(nodes),
            "max_depth": depth,
            "tag_counts": {k: len(v) for k, v in by.items()},
            "anchors": [{"href": a.get("href"), "target": a.get("target"), "rel": a.get("rel")} for a in tag("a")],
            "imgs": [{"src": i.get("src"), "data_src": i.get("data-src"), "width": _int(i.get("width")), "height": _int(i.get("height")), "loading": i.get("loading"), "in_picture": of_picture(i)[0], "modern": of_picture(i)[1]} for i in tag("img")],
            "sources": [{"type": s.get("type"), "srcset": s.get("srcset"), "modern": of_picture(s)[1]} for s in tag("source") if of_picture(s)[0]],
            "scripts": [{"src": s.get("src"), "type": s.get("type"), "id": s.get("id"), "deferred": "async" in s.attrs or "defer" in s.attrs, "integrity": s.get("integrity"), "in_head": inside(s, "head"), "text": _text(s) if "src" not in s.attrs else None} for s in tag("script")],
            "rels": [{"rel": x.get("rel"), "href": x.get("href"), "media": x.get("media"), "as_": x.get("as"), "imagesrcset": x.get("imagesrcset"), "in_head": inside(x, "head")} for x in tag("link")],
            "styles": [_text(s) for s in tag("style")],
            "iframes": [{"src": i.get("src"), "title": i.get("title")} for i in tag("iframe")],
            "inputs": inputs,
            "jsonld": [_text(s) for s in tag("script") if s.get("type") == "application/ld+json"],
            "svg_bytes": sum(_serialised(s) for s in tag("svg")),
            "interstitials": list(dict.fromkeys(interstitials)),
            "content_words": len(re.split(r"\s+", "".join(_text(n) for n in area))),
            "external_links": external,
            "paragraph_text": " ".join(_text(p) for p in paragraphs),
            "intro_length": intro,
            "heading_text": heading_text.lower(),
            "keyword": keyword(url, _text(root, chrome)),
            "main_text": main_text,
            "flags": flags,
        },
    }
