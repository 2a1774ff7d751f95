"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element.  Over the lines' text lengths a
sliding window of three lines is summed; where the sum surges a content region begins, where
it dives to nothing the region ends, and the text between the first surge and the last dive is
kept.  Lines of page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), told by their elements and by names, and lines that are mostly links have no length,
so a region neither begins in them nor keeps them.

What the markup says of articles is a hint: text inside a marked one weighs more in the sums,
and where a region surges in one, regions outside all of them are not the article's.  The smallest
element around all surges, if it is less than the page, is taken to be the article's own, so
that its short lines are kept too.  A furniture mark around the only articles, or around all text,
is taken to be wrong and ignored.

Reading a page takes time in proportion to its length, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_map

# Elements of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video select textarea title xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog fieldset label".split())
# Words of class, id and role values that mark furniture.
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer discussion disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets complementary contentinfo "
    "alert dialog alertdialog feedback reactions teaser rail foot".split()
)
# Words that mark furniture beside any other word, and words that may stand beside the others above.
STRONG_NAMES = frozenset(
    "advert advertisement advertising breadcrumb breadcrumbs commentlist comments cookie cookies disqus gdpr masthead menubar navbar newsletter "
    "pagination sidebar sponsored toolbar topbar".split()
)
STRUCTURE_NAMES = frozenset(
    "area article articles bar block body bottom box button buttons col container content entry extra global group holder icon icons info inner item items law layer "
    "left link links list local main mobile module msg message outer overlay page panel policy post posts primary right row secondary section site slot "
    "stories story sub text title top unit wrap wrapper".split()
)
# Marks that hold also for an article inside: what readers and other pages say.
FOREIGN = frozenset("nav footer aside menu dialog".split())
FOREIGN_NAMES = frozenset("ad ads comment comments commentlist discussion disqus hidden promo promoted recommended related replies reply respond sidebar sponsored teaser".split())
#: How much more text weighs inside a marked article.
HINT = 4
_P_CLOSERS = BLOCKS - {"br", "body", "html", "td", "th", "tr", "caption", "head", "title", "option", "legend", "summary", "figcaption"}
_INLINE = frozenset("a b i u em strong span small big font code kbd samp var cite q s del ins mark sub sup tt abbr acronym bdi bdo data time label dfn".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
# Elements that end an open one of these.
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ()}
_NAME_WORDS = re.compile(r"[a-z]+")


@dataclass
class Line:
    """One line of stripped text: its block, its text, how much of it is links, and its marks."""

    text: str
    linked: int
    furniture: bool
    article: int  # number of the article element around it, 0 for none
    box: int  # number of the innermost block element around it, -1 for none


@dataclass
class Box:
    """A block element: the one around it, its depth, and its lines."""

    tag: str
    around: int
    depth: int
    first: int
    end: int


def _furniture_name(name: str) -> int:
    """0 for text, 1 for furniture, 2 for furniture that no article inside overrides."""
    words = set(_NAME_WORDS.findall(name))
    if words & {"has", "no", "with", "without", "not"}:
        return 0  # says what a container holds
    if words & {"article", "post", "entry", "story"}:
        words -= {"header"}
    if not words & STRONG_NAMES and words - FURNITURE_NAMES - STRUCTURE_NAMES:
        return 0  # a name of something else, such as related work or a feedback loop
    return 2 if words & FOREIGN_NAMES else int(bool(words & (FURNITURE_NAMES | STRONG_NAMES)))


class _Tags:
    """The tags of a page, found in one pass: no character is looked at again for each tag that is not closed."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.matched = {'"': True, "'": True}  # whether such a quote may still have its other one
        self.quotes = True

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at *at*; -1 for none."""
        i = at
        while self.quotes:
            m = _STOP.search(self.page, i)
            if m is None:
                self.quotes = False  # a quote took in all tags that follow, so quotes are plain from here on
                break
            i, quote = m.end(), m[0]
            if quote == ">":
                return m.start()
            if self.matched[quote] and self.page[max(at, m.start() - 16) : m.start()].rstrip().endswith("="):
                close = self.page.find(quote, i)
                self.matched[quote] = close >= 0
                i = close + 1 if close >= 0 else i
        return self.page.find(">", at)

    def skipped(self, start: int, mark: str) -> int:
        """The place after the next *mark*, or the page's end."""
        at = self.page.find(mark, start)
        return at + len(mark) if at >= 0 else len(self.page)


def _names(attributes: str) -> tuple[int, str]:
    """How the attributes mark furniture; the role."""
    role, marked = "", 0
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            marked = 2
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            marked = 2
        elif name in ("class", "id", "role"):
            role = value if name == "role" else role
            marked = max([marked, *map(_furniture_name, value.split())])
    return marked, role


def read(page: str, trust: bool = True) -> tuple[list[Line], list[Box]]:
    """The page without markup, one line for each run of text between block elements, and those elements.

    Without *trust* an article is text also inside an element that is marked as furniture.
    """
    out: list[Line] = []
    boxes: list[Box] = []
    buffer: list[str] = []
    linked = articles = links = 0
    stack: list[tuple[str, int, int]] = []  # element, furniture, article
    open_at: dict[str, list[int]] = {}  # places of an element in the stack
    blocks: list[int] = []  # places of block elements, of those but paragraphs, and the blocks' boxes
    walls: list[int] = []
    inside_of: list[int] = []

    def end_line() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            furniture, article = stack[-1][1:] if stack else (0, 0)
            out.append(Line(text, min(linked, len(text)), bool(furniture), article, inside_of[-1] if inside_of else -1))
        buffer.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        while len(stack) > at:
            name = stack.pop()[0]
            open_at[name].pop()
            links -= name == "a"
            if name in BLOCKS:
                blocks.pop()
                boxes[inside_of.pop()].end = len(out)
                if name != "p":
                    walls.pop()

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(text.strip())

    tags = _Tags(page)
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start != at:
            add(page[at : start if start >= 0 else n])
        if start < 0:
            break
        if page.startswith("<!--", start):
            at = tags.skipped(start + 4, "-->")
            continue
        if page.startswith("<![CDATA[", start):
            at = tags.skipped(start + 9, "]]>")
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = tags.skipped(start + 2, ">")
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            add("<")
            at = start + 1
            continue
        end = tags.end(m.end())
        if end < 0:  # no tag ends from here on
            add(page[start:])
            break
        at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
        if tag in BLOCKS:
            end_line()
        if m[1]:
            places = open_at.get(tag)
            # an inline end never closes a block, and nothing leaves a cell or an article by a stray end
            if places and not (tag in _INLINE and blocks and blocks[-1] > places[-1]):
                close(places[-1])
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = tags.skipped(found.end(), ">") if found else n
            if tag not in ("title", "script", "style", "template"):
                add(" ")
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in _P_CLOSERS or tag in _SAME:
            places = [open_at[x][-1] for x in (*(("p",) if tag in _P_CLOSERS else ()), *_SAME.get(tag, ())) if open_at.get(x)]
            # the innermost of those that begin anew, if no other block lies inside it
            if places and (not walls or max(places) >= walls[-1]):
                close(max(places))
        marked, role = _names(attributes) if attributes.strip() else (0, "")
        inside, article = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        container = tag in ("html", "body", "main", "article") or role in ("main", "article")
        if container and inside == 1 and not trust:
            inside = 0
        furniture = inside if container else max(inside, marked, 2 if tag in FOREIGN else int(tag in FURNITURE))
        # a heading group inside the article is its text, a page header is not
        if tag == "header" and article and not marked and not inside:
            furniture = 0
        if (tag in ("article", "main") or role in ("main", "article")) and not furniture and (not article or tag == "article" and articles and stack and stack[-1][0] == "main"):
            articles += 1
            article = articles
        if tag in BLOCKS:
            around = inside_of[-1] if inside_of else -1
            blocks.append(len(stack))
            if tag != "p":
                walls.append(len(stack))
            inside_of.append(len(boxes))
            boxes.append(Box(tag, around, boxes[around].depth + 1 if around >= 0 else 0, len(out), -1))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, furniture, article))
        links += tag == "a"
    end_line()
    close(0)
    return out, boxes


def surges(lengths: list[int], window: int = 3, surge: int = 60) -> list[tuple[int, int]]:
    """Regions [first, end) of lines: begun where the windowed sum surges, ended where it dives to zero.

    A page whose sums never reach *surge* surges at its highest sum.  Lines before the surge
    point belong to the region only if a window that surges holds them.
    """
    n = len(lengths)
    sums, total = [], sum(lengths[:window])
    for i in range(n):
        sums.append(total)
        total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    height = min(surge, max(sums, default=0))
    if not height:
        return []
    runs, i = [], 0
    while i < n:
        if not lengths[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        runs.append((i, j))
        i = j
    points = ((next((k for k in range(a, b) if sums[k] >= height), b), b) for a, b in runs)
    return [(a, b) for a, b in points if a < b]


def main_text(page: str, window: int = 3, surge: int = 60) -> str:
    """The text between surge and dive points, one line for each block; empty if there is none."""
    found, boxes = read(page)
    marked = _articles(found)
    if not marked and any(x.furniture for x in found):
        inside, other = read(page, trust=False)
        articles = _articles(inside)
        # text outside any mark that is longer than such an article is the page's own
        if _size(x for x in inside if x.article in articles) > _size(found):
            found, boxes, marked = inside, other, articles

    def lengths(furniture: bool) -> list[int]:
        """Links that are an article's own text count there."""
        return [0 if x.furniture and furniture or 2 * x.linked > len(x.text) and x.article not in marked else len(x.text) * (HINT if x.article in marked else 1) for x in found]

    sizes = lengths(True)
    if not any(sizes):
        sizes = lengths(False)
    regions = surges(sizes, window, surge)
    own = {found[i].article for a, b in regions for i in range(a, b) if found[i].article in marked}
    if own:
        kept = {i for i, x in enumerate(found) if x.article in own}
    elif regions:
        first, last = regions[0][0], regions[-1][1]
        while first and sizes[first - 1]:  # a headline or byline stands right before the surge
            first -= 1
        box = _around(boxes, found[regions[0][0]].box, found[last - 1].box)
        if box is not None:
            first, last = min(first, box.first), max(last, box.end)
        kept = set(range(first, last))
    else:
        kept = set()
    return "\n".join(found[i].text for i in sorted(kept) if sizes[i])


def _around(boxes: list[Box], a: int, b: int) -> Box | None:
    """The smallest element around two, which is around all between them; none if that is the page."""
    while a != b:
        if a < 0 or b < 0:
            return None
        if boxes[a].depth >= boxes[b].depth:
            a = boxes[a].around
        else:
            b = boxes[b].around
    return None if a < 0 or boxes[a].tag in ("html", "body") else boxes[a]


def _size(found: Iterable[Line]) -> int:
    return sum(len(x.text) for x in found if not x.furniture and 2 * x.linked <= len(x.text))


def _articles(found: list[Line]) -> set[int]:
    """Numbers of the articles that are not mostly links."""
    weight: dict[int, int] = {}
    for x in found:
        if x.article and not x.furniture:
            weight[x.article] = weight.get(x.article, 0) + len(x.text) - 2 * x.linked
    text = {k for k, n in weight.items() if n >= 0}
    return text or set(weight)


def extract_pages(pages: DataFrame, window: int = 3, surge: int = 60) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of *pages*; null html is empty.

    Rows are independent: ties, repeated rows and nulls in page_id or url pass through.
    """

    def rows(c: dict[str, list]) -> dict[str, list]:
        text = [main_text(h, window, surge) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": [len(t) for t in text]}

    few = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return arrow_map(few, rows, "page_id long, url string, text string, n_chars long")
