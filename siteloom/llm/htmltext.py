"""Operator 8, main text of a page by two-pass block rules.

The page is cut into blocks at block-level tags. Pass 1 decides blocks by where they stand
(menus, headers, footers, sidebars, notices, adverts, forms, comments: boilerplate) and all others
by link density, length and stop-word density. The page's content element (main, else article)
is a prior: inside it a block is judged one step better, and short ones without many links are
text; a heading of the first level right before it belongs to it. Pass 2 gives ambiguous blocks (short, or middling in stop words) the label of their
nearest decided neighbours; where these differ, the nearer one's, and for equal distances text
only if it is middling. Blocks outside the content element don't follow labels
inside it, and middling blocks inside only follow labels inside. A page with undecided blocks only
keeps them, outside a content element only if the page has none. Elements that are dropped
inside a line of text (an advert's span, a button) don't cut the line.

A class name or id tells of boilerplate as a whole (sidebar, post-ad, ad-box), not by a word in
it (related-work, has-sidebar); on text-level elements only few words count, and no ids. Words
that may also name a part of an article (related, search, widget, form) take the prior away inside a
content element, so that densities decide. A form is boilerplate unless it wraps the page: one that
holds an article, a main or a menu, or long texts without links, at least LONG characters for each
of its controls. Stop words are known for four languages; text in other scripts that ends as a
sentence does counts as dense in them.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one newline in page order.

Defined results: null or empty html, and pages without main text, give an empty text. Each row
is treated for itself; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siteloom.llm.common import table, texts, widen

# Pass 1: densities and lengths in characters.
MAX_LINK_DENSITY, SHORT, LONG = 0.33, 70, 200
STOP_HIGH, STOP_LOW = 0.30, 0.20

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button datalist dialog footer head menu nav noscript object search select svg template title audio video canvas".split())
#: Of these, what stands inside a line of text.
INLINE_DROPPED = frozenset("button datalist object select svg audio video canvas".split())
RAW_TEXT = frozenset("script style textarea iframe noembed noframes xmp".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd li td th figcaption caption span b i em strong u code small mark a q cite abbr time".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class names and ids that tell of boilerplate: anywhere, and on containers only.
STRICT = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies cookiebar cookiebanner consent gdpr newsletter popup".split())
MARKS = STRICT | frozenset("banner notice notices alert alerts announcement notification modal overlay subscribe subscription signup login sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus reply replies respond related recommended recommendations share sharing social search form".split())
#: Words that may also name a part of an article; inside one they only take its prior away.
SOFT = frozenset("related recommended recommendations search form widget widgets".split())
#: Elements that tell of a form around a page, and what a form asks with.
PAGE_PARTS, CONTROLS = frozenset("article main nav".split()), frozenset("input select textarea button".split())
#: What may follow such a word in a name; a name that ends in such a word may begin with anything.
FOLLOWS = frozenset("area article articles bar block box btn button buttons column container content count field form group head holder icon icons inner input item items label left link links list media module news outer panel placeholder post posts right row section slot stories story strip text thread title top unit wrap wrapper".split())
#: Words by which a wrapper tells what it has; and what a header belongs to that is kept.
TELLING = frozenset("has with without no layout".split())
CONTENT_MARKS = TELLING | frozenset("article entry post content story".split())
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas pour qu que qui sa sans se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con cual cuando del el ella entre era esta este fue ha hay la las lo los más mi muy no o para pero por se sin sobre son su sus también un una y ya".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RAW_END = {name: re.compile("</" + name + r"[\s/>]", re.I) for name in RAW_TEXT}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"type\s*=\s*[\"']?hidden\b", re.I)
_SENTENCE_END = frozenset(".!?…。！？।»”")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

GOOD, BAD, SHORTISH, NEAR = 1, -1, 0, 2
PLAIN, GONE, DOUBTFUL = 0, 1, 2


def _marked(value: str, marks: frozenset) -> bool:
    """Whether a class name or id names boilerplate: one of the marks, or something that ends in
    one (post-ad), or one with what belongs to it (ad-box); not related-work or has-sidebar."""
    parts = [x.lower() for x in _PART.findall(value)]
    words = [x for x in parts if not x.isdigit()]
    if not words or TELLING & set(words):
        return False
    return words[-1] in marks or words[0] in marks and all(x in marks or x in FOLLOWS for x in words[1:])


def _role(name: str, source: str, in_article: bool, in_content: bool) -> int:
    """What an element stands for, by its name, role, class and id."""
    if name in DROPPED or (name == "header" and not in_article):
        return GONE
    if name in ("html", "body") or not source.strip():
        return PLAIN
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        given.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return GONE
    classes = given.get("class", "").split()
    if name in ("article", "main"):
        return GONE if name == "article" and any("comment" in {x.lower() for x in _PART.findall(value)} for value in classes) else PLAIN
    if given.get("role", "").lower() in ROLES:
        return GONE
    if name in TEXT_LEVEL:  # a heading's id is the target of a link, not a role
        return GONE if any(_marked(value, STRICT) for value in classes) else PLAIN
    out = PLAIN
    for value in (*classes, given.get("id", "")):
        if _marked(value, MARKS - SOFT) or not in_article and _marked(value, _HEADER) and not CONTENT_MARKS & {x.lower() for x in _PART.findall(value)}:
            return GONE
        if _marked(value, _FORM_MARKS if name == "form" else MARKS):
            out = DOUBTFUL if in_content and name != "form" else GONE
    return out


_FORM_MARKS = MARKS - {"form"}  # each form may be called one
_HEADER = frozenset(("header",))


class _Open:
    """The open elements that matter, with what a step needs in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # name, role, block
        self.at: dict[str, list[int]] = {}  # places in the stack, by name
        self.blocks: list[int] = []
        self.lists: list[int] = []
        self.dropped = self.hidden = self.articles = self.mains = 0  # hidden: dropped inside a line
        self.doubtful = 0
        self.link: int | None = None  # size of the stack when the open link began
        self.forms: list[int] = []  # the open ones, by number

    def push(self, name: str, role: int, block: bool) -> None:
        place = len(self.stack)
        self.at.setdefault(name, []).append(place)
        if block:
            self.blocks.append(place)
        if name in _LISTS:
            self.lists.append(place)
        self.stack.append((name, role, block))
        self.dropped += role == GONE and block
        self.hidden += role == GONE and not block
        self.doubtful += role == DOUBTFUL
        self.articles += name == "article"
        self.mains += name == "main"

    def pop_to(self, place: int) -> None:
        """Closes the element at the place and all inside it."""
        while len(self.stack) > place:
            name, role, block = self.stack.pop()
            self.at[name].pop()
            if block:
                self.blocks.pop()
            if name in _LISTS:
                self.lists.pop()
            self.dropped -= role == GONE and block
            self.hidden -= role == GONE and not block
            self.doubtful -= role == DOUBTFUL
            if name == "form":
                self.forms.pop()
            self.articles -= name == "article"
            self.mains -= name == "main"
        if self.link is not None and self.link > place:
            self.link = None

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def close_paragraph(self) -> None:
        if self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])


class _Form:
    """What tells whether a form wraps a page: its controls, its long texts, the page's parts."""

    def __init__(self, parent: int | None) -> None:
        self.parent, self.controls, self.chars, self.longs, self.parts = parent, 0, 0, 0, False

    def wraps(self) -> bool:
        return self.parts or self.longs >= 2 and self.chars >= LONG * self.controls


def _wrappers(forms: list[_Form]) -> list[bool]:
    """For each form whether it and all around it wrap the page."""
    for form in reversed(forms):  # forms come after those around them
        if form.parent is not None and form.parts:
            forms[form.parent].parts = True
    out: list[bool] = []
    for form in forms:
        out.append(form.wraps() and (form.parent is None or out[form.parent]))
    return out


_LISTS = frozenset(("ul", "ol", "menu"))


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, place) of each block with text, in page order; place: -1
    boilerplate, 2 inside main or, without one, an article, 1 inside an article beside main, 0
    elsewhere. Takes time in proportion to the page, however broken it is."""
    out: list[tuple[str, int, int, int | None, bool]] = []  # and the form around it, and whether a first heading
    forms: list[_Form] = []
    parts: list[tuple[str, bool]] = []
    opened = _Open()

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(entities.unescape(p) for p, _ in parts).split())
        if text:
            linked = sum(len(entities.unescape(p)) for p, in_link in parts if in_link)
            place = -1 if opened.dropped else 0 if opened.doubtful else 2 if opened.mains else 1 if opened.articles else 0
            around = opened.forms[-1] if opened.forms else None
            out.append((text, linked, place, around, bool(opened.blocks) and opened.stack[opened.blocks[-1]][0] == "h1"))
            if around is not None and place >= 0:
                forms[around].chars += len(text) - linked
                forms[around].longs += len(text) >= LONG and not linked
        parts.clear()

    at, start, n, pattern = 0, 0, len(html), _TAG
    while at < n:
        found = html.find("<", at)
        if found < 0:
            break
        kind, tag = html[found + 1 : found + 2], None
        if html.startswith("<!--", found):
            ends = [(x, k) for x, k in ((html.find("-->", found + 4), 3), (html.find("--!>", found + 4), 4)) if x >= 0]
            end = min(ends)[0] + min(ends)[1] if ends else n
        elif kind.isalpha() and kind.isascii() or kind == "/" and html[found + 2 : found + 3].isalpha() and html[found + 2].isascii():
            tag = pattern.match(html, found)
            if not tag and pattern is _TAG:  # a quote is left open up to the end: from here quotes don't count
                pattern = _LOOSE
                tag = pattern.match(html, found)
            if not tag:  # no tag ends any more
                end = n
            else:
                end = tag.end()
        elif kind and kind in "!?/":
            end = html.find(">", found + 2) + 1 or n
        else:  # a plain "<"
            at = found + 1
            continue
        if found > start and not opened.hidden:
            parts.append((html[start:found], opened.link is not None))
        at = start = end
        if not tag:
            continue
        close, name, source = tag[1], tag[2].lower(), tag[3]
        block = name in BLOCK or name in DROPPED and name not in INLINE_DROPPED
        if close:
            if name == "a":
                opened.link = None
            if name == "p":
                flush()
                opened.close_paragraph()
            elif name == "br":
                parts.append((" ", False))
            elif block:
                flush()
                if opened.last(name) >= 0:
                    opened.pop_to(opened.last(name))
            elif opened.last(name) >= 0 and (name in INLINE_DROPPED or opened.last(name) > (opened.blocks[-1] if opened.blocks else -1)):
                opened.pop_to(opened.last(name))
            continue
        if opened.forms and (name in CONTROLS or name in PAGE_PARTS):
            forms[opened.forms[-1]].parts |= name in PAGE_PARTS
            forms[opened.forms[-1]].controls += name in CONTROLS and not _UNSEEN.search(source)
        if name in RAW_TEXT:
            end_tag = _RAW_END[name].search(html, at)
            parts.append((" ", False))
            at = start = n if not end_tag else html.find(">", end_tag.start()) + 1 or n
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        role = _role(name, source, opened.articles > 0, opened.articles + opened.mains > 0)
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if block:
            flush()
            if name in BLOCK:
                opened.close_paragraph()
            if name == "li" and opened.last("li") > (opened.lists[-1] if opened.lists else -1):
                opened.pop_to(opened.last("li"))
            opened.push(name, role, True)
            if name == "form":
                forms.append(_Form(opened.forms[-1] if opened.forms else None))
                opened.forms.append(len(forms) - 1)
        elif role or opened.last(name) >= 0:  # dropped inline elements, and what is needed to find their end
            opened.push(name, role, False)
        if name == "a":
            opened.link = len(opened.stack)
    if start < n and not opened.hidden:
        parts.append((html[start:], opened.link is not None))
    flush()
    return _places(out, _wrappers(forms))


def _places(found: list[tuple[str, int, int, int | None, bool]], wrappers: list[bool]) -> list[tuple[str, int, int]]:
    """The blocks, once the whole page is known: forms, what kind of content element it has, and
    the heading before that."""
    places = [-1 if form is not None and not wrappers[form] else place for _, _, place, form, _ in found]
    if 2 not in places:
        places = [2 if x == 1 else x for x in places]
    for i in range(len(found) - 1):
        if found[i][4] and places[i] == 0 and places[i + 1] == 2 and 2 not in places[max(0, i - 1) : i]:
            places[i] = 2
    return [(block[0], block[1], place) for block, place in zip(found, places)]


def _label(text: str, linked: int, place: int, best: int) -> int:
    if place < 0:
        return BAD
    density, inside = linked / len(text), 0 < place == best
    if density > MAX_LINK_DENSITY:
        return SHORTISH if inside and len(text) < SHORT else BAD
    if "©" in text and not inside:
        return BAD
    if len(text) < SHORT:
        return GOOD if inside else SHORTISH
    words = text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if not stop and text[-1] in _SENTENCE_END and 2 * sum(ch > "\u024f" and ch.isalpha() for ch in text) > sum(map(str.isalpha, text)):
        stop = STOP_HIGH  # a sentence in a script whose stop words aren't known
    if stop >= STOP_HIGH:
        return GOOD if inside or len(text) >= LONG else NEAR
    if stop >= STOP_LOW or len(text) >= LONG and density == 0:
        return GOOD if inside else NEAR
    return NEAR if inside else BAD


def extract(html: str | None) -> str:
    """The main text of a page."""
    found = blocks(html) if html else []
    best = max([0, *(b[2] for b in found)])
    labels = [_label(*b, best) for b in found]
    # Where a page has no sure text and no content element, menus and the like decide about nothing.
    alone = best == 0 and GOOD not in labels
    decided = [i for i, x in enumerate(labels) if x in (GOOD, BAD) and not (alone and found[i][2] < 0)]
    # Labels that middling blocks inside the content element follow, and those of blocks outside.
    within = [i for i in decided if found[i][2] == best]
    without = [i for i in decided if found[i][2] < best] if best else decided
    out = []
    for i, (block, label) in enumerate(zip(found, labels)):
        if label in (SHORTISH, NEAR):
            inside = 0 < block[2] == best
            near = without if not inside else within if label == NEAR else decided
            after = bisect(near, i)
            left = near[after - 1] if after else None
            right = near[after] if after < len(near) else None
            sides = [(abs(i - k), labels[k]) for k in (left, right) if k is not None]
            if best == 0 and all(x == BAD for _, x in sides) and label == NEAR:
                label = GOOD if GOOD not in labels else BAD
            elif not sides:
                label = GOOD if inside or best == 0 else BAD
            elif len(sides) == 1 or sides[0][1] == sides[1][1] or sides[0][0] != sides[1][0]:
                label = min(sides)[1]
            else:
                label = GOOD if label == NEAR else BAD
        if label == GOOD:
            out.append(block[0])
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Replaces html by text and n_chars."""

    def rows(batch: pa.RecordBatch) -> list:
        told = [extract(h) for h in texts(batch.column(batch.schema.get_field_index("html")))]
        return [pa.array(told, pa.string()), pa.array([len(t) for t in told], pa.int64())]

    return widen(pages.drop("text", "n_chars"), [("text", T.StringType()), ("n_chars", T.LongType())], rows, ("html",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
