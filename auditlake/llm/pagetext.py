"""Operator 10, HTML extraction: parser events give lines, smoothed text-to-tag ratios tell content from the rest."""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auditlake.llm.common import with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Widths of the Gaussians over lines, and their reach in widths: the wide one finds the region of the content, the narrow one its lines.
SIGMA, SHARP, REACH = 1.5, 0.5, 3
#: Share of the content lines' text that an element has to hold so that long lines of links in it are no menus.
COVERED = 0.85
#: Outside an article, lines that are links in more than this share of their text are menus.
LINKS = 0.6
#: Characters fed to the parser at once.
FEED = 1 << 16

# Elements of HTML and words of class names, ids and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = set("head script style noscript template title nav footer aside form button select textarea iframe svg canvas object dialog menu search input".split())
REGION = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Left out only where their end tag is found; a form also only if it isn't around the page.
CLOSED = {"form", "nav", "aside"}
IN_HEAD = set("html head base basefont bgsound link meta title style script noscript template".split())
#: Elements inside a line, left out without a look at what they hold.
PHRASING = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
CONTAINERS = set("article main section div td body html center blockquote table".split())
#: An element that a start tag of the key closes if it is open inside the same container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = set("table ul ol dl div article section main body td th blockquote select".split())
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidenav rail widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended pagination pager skip copyright".split()
)
#: What may follow a word of the above in a class name or id: ad-slot and related-posts are boilerplate, ad-hoc and related-work are not.
PLACES = set(
    "area bar block body bottom box button buttons card center column container content desktop dialog fixed form foot frame global group header heading holder icons inner item "
    "items large left link links list main message mobile outer panel post posts primary region right row rows secondary section site slot small sticky stories text "
    "title toggle top unit wrap wrapper".split()
)
#: Words that paragraphs, headings, cells and the like of an article also use for what they say.
SAID = set("alert banner copyright notice notices overlay related respond reply replies share skip social widget".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr figure figcaption pre blockquote label caption details summary hgroup".split())
#: Whole words of class names and ids beside those whose first part is a word of the above and whose other parts are places or numbers.
COMPOUNDS = set(
    "site-footer page-footer main-footer entry-footer post-footer site-nav main-nav primary-nav top-nav site-navigation main-navigation post-navigation primary-menu main-menu "
    "left-sidebar right-sidebar main-sidebar primary-sidebar post-comments".split()
)
HEADERS = {"header", "site-header", "page-header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_PARTS = re.compile(r"[_-]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PLACE = re.compile(r"[0-9]+(?:x[0-9]+)?")


def boilerplate(words: list[str], said: bool) -> bool:
    """Whether a class name or id in ``words`` tells that its element is not of the article. ``said``: paragraphs inside one."""
    for word in words:
        first, *rest = _PARTS.split(word.strip("_-"))
        if word in COMPOUNDS or (first in BOILERPLATE and not (said and first in SAID) and all(x in PLACES or x in BOILERPLATE or _PLACE.fullmatch(x) for x in rest)):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page in order: text between block tags, with its tags, the text inside links, and its elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, id, whether it is left out for good, number of its doubtful exclusion or 0, the local region before it.
        self.stack: list[tuple[str, int, bool, int, int]] = []
        #: Depths of the open elements by tag, of the open containers, and of those that keep what is around them open.
        self.open: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.fences: list[int] = []
        #: Exclusions that what the page holds may lift: the one around it, kind, whether in an article, whether its end tag was found.
        self.doubts: list[list] = [[0, "", False, True]]
        #: By element id: tag and the id of the container around it.
        self.elements: list[tuple[str, int]] = [("#page", -1)]
        self.text: list[str] = []
        self.tags = self.linked = self.out = self.links = self.titles = self.inside = self.regions = 0
        self.container = [0]
        #: Innermost doubtful exclusion, the outermost region inside it or -1, regions so counted, open articles.
        self.doubt, self.local, self.locals, self.articles = 0, -1, 0, 0
        #: text, tags, characters in links (of titles none), container id, number of the outermost article or main element
        #: around it or -1, doubtful exclusion, local region.
        self.found: list[tuple[str, int, int, int, int, int, int]] = []

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.found.append((line, self.tags, 0 if self.titles else self.linked, self.container[-1], self.regions if self.inside else -1, self.doubt, self.local))
        self.text, self.tags, self.linked = [], 0, 0

    def left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """Empty, "good" for an element that is left out whatever it holds, or the kind of a doubtful exclusion."""
        if tag in NEVER and tag not in CLOSED:
            return "good"
        if tag == "header":
            return "" if self.inside else "good"
        if tag in ("html", "body") or tag in REGION:
            return ""
        if tag == "label":
            return "good" if self.open.get("form") else ""
        kind = tag if tag in CLOSED else ""
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "good"
            if not value:
                continue
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return "good"
            if tag in CLOSED:
                continue
            if name in ("class", "id"):
                if name == "id" and tag in HEADINGS:
                    # Made from what the heading says.
                    continue
                words = _HUMP.sub("-", value).lower().split()
                if boilerplate(words, self.inside > 0 and tag in PARAGRAPHS) or (not self.inside and not HEADERS.isdisjoint(words)):
                    kind = "good" if tag in PHRASING else "class"
            elif name == "role" and value.lower() in ROLES:
                return "good"
        return kind

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, element, left_out, doubt, local = self.stack.pop()
            self.open[tag].pop()
            if tag in CONTAINERS:
                self.holders.pop()
            if tag in KEEPS_OPEN:
                self.fences.pop()
            self.out -= left_out
            self.links -= tag == "a"
            self.titles -= tag == "h1"
            if tag in REGION:
                self.inside -= 1
            self.articles -= tag == "article"
            if doubt:
                self.doubt = self.doubts[doubt][0]
            self.local = local
            if self.container[-1] == element:
                self.container.pop()

    def close_head(self, tag: str) -> None:
        """Both tags of head and the start tag of body may be left away: the first thing that can't be in a head ends it."""
        if tag == "body":
            if heads := self.open.get("head"):
                self.pop_to(heads[0])
        elif self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop_to(len(self.stack) - 1)

    def live(self) -> list[tuple[str, int, int, int, int]]:
        """Lines that no exclusion holds. A class name or a form is no exclusion if it is around the larger article or main
        element, unless itself in an article; a form neither if it is around most of the text; form, nav and aside without
        an end tag never are, since nobody knows where they end."""
        own, by_region = [0] * len(self.doubts), {}
        for text, *_, doubt, local in self.found:
            own[doubt] += len(text)
            if local >= 0:
                by_region[doubt, local] = by_region.get((doubt, local), 0) + len(text)
        mine = [0] * len(self.doubts)
        for (doubt, _), n in by_region.items():
            mine[doubt] = max(mine[doubt], n)
        inner = mine[:]
        # Numbers grow inwards.
        for i in range(len(self.doubts) - 1, 0, -1):
            around = self.doubts[i][0]
            inner[around] = max(inner[around], inner[i])
        lifted, largest, outside = [True], [0], [0]
        for i, (around, kind, in_article, closed) in enumerate(self.doubts[1:], 1):
            largest.append(max(largest[around], mine[around]))
            outside.append(outside[around] + own[around])
            lift = kind != "class" and not closed
            if kind in ("class", "form"):
                lift |= not in_article and inner[i] > largest[i]
            if kind == "form":
                lift |= own[i] > outside[i]
            lifted.append(lift and lifted[around])
        return [x[:5] for x in self.found if lifted[x[5]]]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.close_head(tag)
        if tag in BLOCK:
            self.end_line()
            self.tags = 1
            if closed := CLOSES.get(tag):
                depth = max((self.open[x][-1] for x in closed if self.open.get(x)), default=-1)
                if depth >= (self.fences[-1] if self.fences else 0):
                    self.pop_to(depth)
        if tag in VOID:
            return
        kind, local, doubt = self.left_out(tag, attrs), self.local, 0
        left_out = kind == "good"
        if kind and not left_out:
            if tag not in BLOCK:
                self.end_line()
                self.tags = 1
            doubt = len(self.doubts)
            self.doubts.append([self.doubt, kind, self.articles > 0, False])
            self.doubt, self.local = doubt, -1
        element = -1
        if tag in CONTAINERS:
            element = len(self.elements)
            self.elements.append((tag, self.container[-1]))
            self.container.append(element)
        depth = len(self.stack)
        self.open.setdefault(tag, []).append(depth)
        if tag in CONTAINERS:
            self.holders.append(depth)
        if tag in KEEPS_OPEN:
            self.fences.append(depth)
        self.stack.append((tag, element, left_out, doubt, local))
        self.out += left_out
        self.links += tag == "a"
        self.titles += tag == "h1"
        if tag in REGION:
            self.regions += not self.inside
            self.inside += 1
            self.articles += tag == "article"
            if self.local < 0:
                self.locals += 1
                self.local = self.locals

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in self.CDATA_CONTENT_ELEMENTS and tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if not (depths := self.open.get(tag)):
            return
        depth = depths[-1]
        if tag not in CONTAINERS and tag not in BLOCK and self.holders and depth < self.holders[-1]:
            return
        if tag not in BLOCK and any(x[3] or x[0] in REGION for x in self.stack[depth:]):
            self.end_line()
        if doubt := self.stack[depth][3]:
            self.doubts[doubt][3] = True
        self.pop_to(depth)

    def handle_data(self, data: str) -> None:
        if self.out and not data.isspace():
            self.close_head("#text")
        if not self.out:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, width: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends over those that exist."""
    reach = int(width * REACH)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def split_point(values: np.ndarray) -> float:
    """Threshold between two clusters of values: the middle of two means, moved until it rests."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        mid = (low + high) / 2
        above = values >= mid
        new = (float(values[~above].mean()) if (~above).any() else low, float(values[above].mean()))
        if new == (low, high):
            break
        low, high = new
    # One cluster only: everything is content.
    return (low + high) / 2 if high > 2 * low + 10 else -1.0


def content(lines: list[tuple[str, int, int, int, int]], elements: list[tuple[str, int]]) -> list[str]:
    """The texts of the lines that are the article.

    Lines above the threshold tell whether article and main elements hold the content; if so, they are it with all their
    lines, short paragraphs, headings, lists and quotes alike. Only one that has no line above the threshold and is mostly
    links isn't.

    Elsewhere the narrowly smoothed ratios choose the smallest container that holds most of the text of the lines above
    their threshold. What is in it, or directly in the containers around it, is the article. Another branch of the page is
    left out if no line of it is above the threshold; if the container is the page itself, so are such branches before the
    first or after the last of these lines. Lines that are mostly links go, but for those above the threshold in the container."""
    if not lines:
        return []
    size = np.array([len(t) for t, *_ in lines], float)
    ratios = size / np.array([1 + tags for _, tags, *_ in lines])
    smooth = smoothed(ratios)
    high = smooth >= split_point(smooth)
    marked = np.array([x[4] >= 0 for x in lines])
    if (high & marked).any() and size[high & marked].sum() >= 0.5 * size[high].sum():
        told, text_of, linked_of = set(), {}, {}
        for (text, _, linked, _, region), is_high in zip(lines, high.tolist(), strict=True):
            text_of[region] = text_of.get(region, 0) + len(text)
            linked_of[region] = linked_of.get(region, 0) + linked
            if is_high:
                told.add(region)
        return [x[0] for x in lines if x[4] >= 0 and (x[4] in told or linked_of[x[4]] <= LINKS * text_of[x[4]])]
    sharp = smoothed(ratios, SHARP)
    high = sharp >= split_point(sharp)
    held = [0.0] * len(elements)
    for i in np.flatnonzero(high).tolist():
        held[lines[i][3]] += size[i]
    # Element ids grow inwards: sums go from children to parents, and the last one that holds enough is the smallest.
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][1]] += held[e]
    enough = COVERED * float(size[high].sum())
    best = max(e for e, n in enumerate(held) if n >= enough)
    around, e = set(), best
    while e >= 0:
        around.add(e)
        e = elements[e][1]
    root = elements[best][0] in ("#page", "html", "body")
    within, told = [False] * len(elements), [False] * len(elements)
    for e, (_, parent) in enumerate(elements):
        within[e] = e == best or (parent >= 0 and within[parent])
        # Whether the branch of the element has a line above the threshold.
        told[e] = e in around or (held[e] > 0 if parent in around else told[parent])
    first, last = np.flatnonzero(high)[[0, -1]].tolist()
    out = []
    for i, (text, _, linked, e, region) in enumerate(lines):
        stays = told[e] or (within[e] and (not root or first < i < last))
        if region >= 0 or (stays and linked <= LINKS * len(text)) or (within[e] and high[i]):
            out.append(text)
    return out


def main_text(html: str) -> str:
    """The article of a page; empty if it has none. The parser is fed piece by piece."""
    parser = Lines()
    for i in range(0, len(html), FEED):
        parser.feed(html[i : i + FEED])
    parser.close()
    parser.end_line()
    return " ".join(content(parser.live(), parser.elements))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages of menus alone, give an empty text. Other columns aren't read; repeated rows give
    equal rows. Broken markup ends no page: unclosed elements end with the element around them."""

    def work(column: pa.Array) -> list:
        texts = [main_text(x or "") for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    base = pages.select("page_id", "url", pages["html"].alias("page_html"))
    return with_batch_columns(base, ["page_html"], StructType([StructField("text", StringType()), StructField("n_chars", LongType())]), work).drop("page_html")
