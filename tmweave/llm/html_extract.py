"""Main text of HTML pages.

The standard library's parser streams its events into lines: a line is the text between two block boundaries, with the
number of tags met in it and the element it stands in. Each line's ratio of text to tags is smoothed by a Gaussian over its
neighbours; a two-means threshold splits the smoothed ratios into content and rest. The content lines choose the content
region: the innermost article or main element with most of their text, else the innermost element of any kind, widened as long as
what it gains is content. Of the region's lines those go that stand in an element against which something speaks: its tag, role or style
(menus, asides, buttons, ...), or, unless it holds most of the page, a word of its class or id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea option datalist iframe object svg math canvas audio video dialog menu map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr input".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that may stand inside a sentence; whatever they hold goes, and the sentence goes on.
QUIET = frozenset("script style noscript template svg math canvas audio video object iframe button select textarea datalist map picture source track param".split())
#: Words in class, id or role that mark what isn't the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar side-bar widget menu nav navbar navigation breadcrumb breadcrumbs toolbar pager pagination footer header masthead comment comments commentlist reply replies respond disqus discussion related recommended share sharing social login search skip post-comments left-sidebar right-sidebar".split())
#: Beginnings of words that mark the same; other parts of words with hyphens say nothing (has-sidebar, no-ads, entry-header).
PREFIXES = ("ad-box", "ad-slot", "ad-unit", "ad-banner", "ad-container", "ads-", "advert-", "advertisement-", "sponsored-", "promo-", "cookie-", "consent-", "gdpr-", "newsletter-", "nav-", "navbar-", "breadcrumb-", "comment-", "comments-", "disqus-", "related-posts", "related-articles", "related-links", "share-button", "share-links", "share-bar", "sharing-", "social-", "sidebar-", "site-header", "site-footer", "page-footer", "main-nav", "site-nav", "main-menu")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Last parts of names with hyphens that mark the same, parts beside which they say nothing, and words for boxes, before which they count as well.
WEAK = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie cookies cookiebar consent gdpr notice notices newsletter subscribe signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination footer comment comments disqus legal imprint copyright related recommended share sharing social login".split())
NOT_WEAK = frozenset("has no not without with is in on entry post article story content text body title headline layout grid row col".split())
BOXES = frozenset("wrapper wrap links section box block container area bar list inner panel region slot unit".split())
#: The part of the page's prose that makes an article element one of several.
ALSO = 0.1
#: The part of the page's text beyond which class, id, role or being a form alone don't drop an element; the part of the text around the region that must be content for the region to grow; characters per tag that are prose on any page.
HELD, NEAR, PROSE = 0.5, 0.5, 20
#: Width of the smoothing in lines; the part of the content's text that an article or main element, or any other element, must hold to be the region.
SIGMA, SHARE, MOST = 1.0, 0.5, 0.8
#: What speaks against an element: nothing, class or the like, or its kind.
NOTHING, SOFT, HARD = 0, 1, 2
_SPACE = re.compile(r"\s+")
#: Elements whose text isn't markup, which the parser reads up to their end tag.
RAW_TEXT = re.compile(r"<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b", re.I)
#: Where such an element without an end tag is taken to end: before a tag that begins a line, or a block.
NEXT_TAG = re.compile(r"\n[ \t]*<|</?(?:p|div|h[1-6]|article|main|section|body|head|footer|header|nav|ul|ol|table)[\s>]", re.I)


def against(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """What speaks against an element; inside: whether it is part of an article or main element."""
    if tag in NEVER or tag == "header" and not inside:
        return HARD
    found = SOFT if tag == "form" else NOTHING
    for k, v in attrs:
        v = (v or "").lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
            return HARD
        if tag in ("html", "body", "article", "main"):
            continue
        if k == "role" and v in ROLES or k in ("class", "id") and any(w in MARKS or w.startswith(PREFIXES) or weak(w) for w in _SPACE.split(v.replace("_", "-"))):
            found = SOFT
    return found


def weak(name: str) -> bool:
    """Whether a name with hyphens is, by its last part, or the one before a word for a box, the name of something beside the article; and no other part says that it belongs to it."""
    parts = name.split("-")
    if parts[-1] in BOXES and len(parts) > 1:
        parts.pop()
    return parts[-1] in WEAK and not any(p in NOT_WEAK for p in parts)


#: What decides where a tag ends: a quote that opens a value, or what may close one, or a bracket.
EDGE = re.compile(r"""=\s*['"]|[<>'"]""")
#: What ends comments and marked sections.
COMMENT_END, SECTION_END, CONDITION_END = re.compile(r"--\s*>"), re.compile(r"\]\s*\]\s*>"), re.compile(r"\]\s*>")


def settled(html: str) -> str:
    """The page with every < as text that starts nothing which ends: the parser would look for the end of each to the page's last character.

    From the last bracket or quote to the first it is known for each whether a tag that goes on there ends: outside of quotes, inside single or inside double ones.
    """
    if "<" not in html:
        return html
    last = html.rfind(">")
    ends: dict[re.Pattern, int] = {}

    def after(form: re.Pattern) -> int:
        """Where the last of these starts."""
        if form not in ends:
            ends[form] = max((m.start() for m in form.finditer(html)), default=-1)
        return ends[form]

    free = single = double = False
    hopeless = []
    for m in reversed([(m.start(), m[0]) for m in EDGE.finditer(html)]):
        at, c = m
        if c == ">":
            free = True
        elif c == "<":
            n = html[at + 1 : at + 2]
            if n.isascii() and n.isalpha():
                lost = not free
            elif html.startswith("<!--", at):
                lost = at + 2 > after(COMMENT_END)
            elif html.startswith("<![", at):
                name = html[at + 3 : at + 12].lower()
                lost = at > after(SECTION_END if name.startswith(("cdata", "temp", "ignore", "include", "rcdata")) else CONDITION_END)
            else:
                lost = n != "" and n in "/!?" and at > last
            if lost:
                hopeless.append(at)
        elif c[0] == "=":
            free, single, double = (single if c[-1] == "'" else double), (free if c[-1] == "'" else single), (double if c[-1] == "'" else free)
        elif c == "'":
            single = free
        else:
            double = free
    if not hopeless:
        return html
    out, at = [], 0
    for x in reversed(hopeless):
        out += [html[at:x], "&lt;"]
        at = x + 1
    return "".join([*out, html[at:]])


def closed(html: str) -> str:
    """The page with ends for raw-text elements that have none, put where the next block may begin, so that they don't take the rest of the page with them."""
    if not RAW_TEXT.search(html):
        return html
    low, out, at = html.lower(), [], 0
    if len(low) != len(html):  # a few letters change their length in lower case
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), html)
    missing: set[str] = set()
    while m := RAW_TEXT.search(html, at):
        name = m[1].lower()
        end = -1 if name in missing else low.find(f"</{name}", m.end())
        if end >= 0:
            stop = end + len(name) + 2
        else:
            missing.add(name)
            line = NEXT_TAG.search(html, m.end())
            if not line:
                break
            stop = line.start()
        out.append(html[at:stop])
        if end < 0:
            out.append(f"</{name}>")
        at = stop
    return "".join([*out, html[at:]])


class Page(HTMLParser):
    """lines: (text, number of tags, element, characters of it in links). up, kind, tag of elements, which are numbered in page order; 0 is the page itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.up, self.kind, self.tag = [0], [NOTHING], [""]
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        self.hard, self.n_tags, self.text, self.linked = 0, 0, [], 0

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.n_tags, self.stack[-1] if self.stack else 0, self.linked))
            self.text, self.linked = [], 0
        self.n_tags = 0

    def pop_to(self, depth: int) -> None:
        for i in self.stack[depth:]:
            self.hard -= self.kind[i] == HARD
            self.open[self.tag[i]] -= 1
        del self.stack[depth:]

    def close_open(self, tags: set[str], barrier: set[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for d in range(len(self.stack) - 1, -1, -1):
            t = self.tag[self.stack[d]]
            if t in tags:
                self.pop_to(d)
                return
            if t in barrier or t not in INLINE and t not in ("p", "li", "dt", "dd", "td", "th", "tr"):
                return

    def handle_starttag(self, tag, attrs):
        if tag in INLINE or tag in QUIET:
            if tag == "br":
                self.text.append(" ")
        elif not (self.hard and self.text):  # what goes doesn't end the sentence that it stands in
            self.flush()
            if tag in ENDS_P:
                self.close_open({"p"}, set())
            if tag in CLOSED_BY:
                self.close_open(CLOSED_BY[tag], BARRIER.get(tag, set()))
        self.n_tags += 1
        if tag in VOID:
            return
        kind = against(tag, attrs, bool(self.open.get("article") or self.open.get("main")))
        if kind == SOFT and tag in INLINE:
            self.flush()
        self.up.append(self.stack[-1] if self.stack else 0)
        self.kind.append(kind)
        self.tag.append(tag)
        self.stack.append(len(self.up) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hard += kind == HARD

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.n_tags += 1
        if tag not in INLINE and tag not in QUIET and not (self.hard and self.text):
            self.flush()
        if not self.open.get(tag):
            return
        for d in range(len(self.stack) - 1, -1, -1):
            i = self.stack[d]
            if self.tag[i] == tag:
                if tag in INLINE and self.kind[i] == SOFT:
                    self.flush()
                self.pop_to(d)
                return
            if tag in INLINE and self.tag[i] not in INLINE:
                return  # a stray end of an inline element doesn't close blocks

    def handle_data(self, data):
        if not self.hard:
            self.text.append(data)
            if self.open.get("a"):
                self.linked += len(data.strip())

    def sums(self, of_line: list[int]) -> list[int]:
        """For each element the sum over the lines in it. Elements have larger numbers than those around them, so one pass from the end does it."""
        total = [0] * len(self.up)
        for line, x in zip(self.lines, of_line, strict=True):
            total[line[2]] += x
        for i in range(len(total) - 1, 0, -1):
            total[self.up[i]] += total[i]
        return total

    def inside(self, marked: set[int]) -> list[bool]:
        """For each element whether it, or one around it, is marked."""
        out = [0 in marked]
        for i in range(1, len(self.up)):
            out.append(i in marked or out[self.up[i]])
        return out

    def spoken_against(self) -> list[bool]:
        """For each element whether its lines go for what class, id, role or a form around it say. One that holds most of the page's text stays, unless an article or main element has text elsewhere."""
        held = self.sums([len(x[0]) for x in self.lines])
        soft = {i for i, k in enumerate(self.kind) if k == SOFT}
        large = [i for i in sorted(soft) if held[i] > HELD * held[0]]  # each stands in the one before
        if large:
            in_article, in_small = self.inside({i for i, t in enumerate(self.tag) if t in ("article", "main")}), self.inside(soft.difference(large))
            free = self.sums([len(x[0]) * (in_article[x[2]] and not in_small[x[2]]) for x in self.lines])
            # what the article has outside a large element speaks for that, and so against this one and all in it
            soft -= {i for i in large if free[i] == free[0]}
        return self.inside(soft)


def smoothed(x: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean over the neighbours within 3 sigma, at the ends over those that exist; to nine places, so that equal ratios stay equal."""
    r = max(1, round(3 * sigma))
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - r), min(len(x), i + r + 1)
        ws = w[lo - i + r : hi - i + r]
        out.append(round(sum(a * b for a, b in zip(ws, x[lo:hi], strict=True)) / sum(ws), 9))
    return out


def threshold(x: list[float]) -> float:
    """Halfway between the two means of the ratios; all alike: that value."""
    lo, hi = min(x), max(x)
    for _ in range(20):
        t = (lo + hi) / 2
        a, b = [v for v in x if v < t], [v for v in x if v >= t]
        new = (sum(a) / len(a) if a else lo, sum(b) / len(b) if b else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def region_of(p: Page, ratio: list[float]) -> int:
    """The element whose lines are the article; 0 is the whole page."""
    size = [len(x[0]) for x in p.lines]
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    content = p.sums([n if r >= cut else 0 for n, r in zip(size, smooth, strict=True)])
    # content by itself: above the cut of the ratios' logarithms, which one very long paragraph hardly moves, or prose
    least = min(PROSE, math.exp(threshold([math.log(max(r, 1e-9)) for r in ratio])))
    held, prose = p.sums(size), p.sums([n if r >= least else 0 for n, r in zip(size, ratio, strict=True)])
    # elements are numbered in page order, so the last one with enough of the content is the innermost
    named = [i for i, t in enumerate(p.tag) if t in ("article", "main") and content[i] > SHARE * content[0]]
    if named:
        region = named[-1]
        several = [i for i, t in enumerate(p.tag) if t == "article" and prose[i] >= ALSO * prose[0]]
        # one of several articles: the innermost element around them all
        while not all(map(p.inside({region}).__getitem__, several)):
            region = p.up[region]
        return region
    lines = p.sums([1] * len(size))
    region = max(i for i, m in enumerate(content) if i == 0 or m >= MOST * content[0] and lines[i] > 1)
    while region and prose[p.up[region]] - prose[region] >= NEAR * (held[p.up[region]] - held[region]):
        region = p.up[region]
    return region


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by two line feeds. Null, empty or nothing but boilerplate: an empty string.

    Time grows in proportion to the page's length, however deep its elements lie, and whatever is left open.
    """
    p = Page()
    p.feed(closed(settled(html or "")))
    p.close()
    p.flush()
    gone = p.spoken_against()
    p.lines = [x for x in p.lines if not gone[x[2]]]
    if not p.lines:
        return ""
    region = region_of(p, [len(t) / (n + 1) for t, n, _, _ in p.lines])
    within = p.inside({region})
    kept = [(t, linked > len(t) / 2) for t, _, i, linked in p.lines if within[i]]
    rest = [i for i, (_, link) in enumerate(kept) if not link]
    if p.tag[region] in ("", "html", "body") and rest:
        # nothing narrower was found: links before and after all other lines are menus
        kept = kept[rest[0] : rest[-1] + 1]
    return "\n\n".join(t for t, _ in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; map-only.

    A null or empty page has an empty text. Repeated rows are extracted each; long and deep pages are read whole, in time that grows with their
    length. Other columns don't come through; an empty table gives no rows.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
