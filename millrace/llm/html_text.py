"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page as events. Events become lines,
one for each block of running text, with the number of tags met since the line
before, the length of its link texts, and the innermost region (article, main,
section, div, table cell, body, list or table) that holds it. A line's
text-to-tag ratio is its text outside links over its tags; ratios are smoothed
with a Gaussian window, runs of lines above a threshold are clusters, and the
clusters decide by their mass which region of the page is the content: the
innermost one that holds most of it, or the outermost article or main around
that. The region's lines are the text, short ones beside long ones too, but for
blocks that are mostly links where no article or main marks the content.

Navigation, headers and footers of the page, sidebars, notices, adverts, forms,
reader comments and unseen elements stand apart, articles among them too; a class
or id names such a part only as a whole, not as "no-sidebar" does. An element
that stands apart is taken back if what is left of the page is next to nothing,
as around a page with a form or an advert that is never closed.

Defined cases: a null or empty page, and one without content, give an empty
text of 0 code points; unclosed and stray tags are read as browsers do in the
simple cases; a tag, comment or script that the page breaks off ends the page,
as in browsers; cells of a table row are one line unless one of them holds
blocks or nothing but links; a page without markup is one line; pages of any
length and depth are read whole, in linear time, as the parser is given whole
tags only and never waits for the rest of one; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

from millrace.llm.arrow import map_batches, slices, texts_of
from pyspark.sql import DataFrame

#: Width of the Gaussian window in lines, share of the mean smoothed ratio that a content line reaches, characters fed at once.
SIGMA, THRESHOLD, FEED = 1.5, 0.5, 1 << 16
#: Share of link text of a menu; share of the page's text that is next to nothing; least length of a line of running text.
LINKED, NOTHING, RUNNING = 0.7, 0.1, 80

# Kinds of HTML elements, and names that pages give their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
REGIONS = frozenset("article main section div td body".split())
LISTS = frozenset("ul ol dl table".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
APART = frozenset("nav footer aside form menu button select textarea dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
LAYOUT = frozenset("banner footer header menu nav navbar navigation related sidebar toolbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
PARTS = LAYOUT | COMMENTS | frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement alert breadcrumb breadcrumbs consent cookie cookies disclaimer gdpr login modal newsletter notice notices notification "
    "pager pagination popup promo promoted promotion sharing share signup social sponsor sponsored subscribe subscription".split()
)
#: What the name of a part may be joined with, as in "site-footer", and that of reader comments besides.
JOINED = frozenset("area articles bar bottom box buttons container global icons inner left links list media page posts primary right secondary section site slot stories top wrapper".split())
JOINED_COMMENTS = frozenset("article author body content entry form item post reader readers text thread user users".split())
#: A start tag of the key closes an open element of its values, up to the nearest table or list.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = frozenset("ul ol dl table select menu".split())
#: Elements whose content is no markup.
RAW = frozenset(["script", "style"])
_TAG = re.compile(r"""<[A-Za-z](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_PLAIN = re.compile(r"""<[A-Za-z][A-Za-z0-9:-]*+(?:\s++[A-Za-z_:@][\w:.@-]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`/]++))?+)*+\s*+/?+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>="'<]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']*+))?+""")
_TITLE = re.compile(r"<([A-Za-z][^\s/>]*+)")
_NAME = re.compile(r"[A-Za-z]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def whole_tags(html: str) -> Iterator[str]:
    """The page in parts that end behind a tag, without comments, declarations and the content of scripts and styles.

    What is no tag is text, its "<" as a reference; a tag whose attributes are
    not plain is written anew. The first construct that never ends is where the
    page ends, so every search that fails is the last one.
    """
    at, size, held = 0, 0, []
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            held.append(html[at:])
            break
        held.append(html[at:start])
        after = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2) + 3
            if end < 3:
                break
        elif after.isalpha() and after.isascii():
            found = _TAG.match(html, start)
            if not found:
                break
            tag, end = found[0], found.end()
            if not _PLAIN.fullmatch(tag):
                name = _TITLE.match(tag)[1]
                pairs = [(k, v.strip("\"'") if v else "") for k, v in _ATTRIBUTE.findall(tag[len(name) + 1 : -1])]
                safe = re.sub(r"[^A-Za-z0-9:-]", "-", name)
                tag = f"<{safe}" + "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in pairs if k[0].isalpha() and k.isascii()) + ">"
            held.append(tag)
            name = _TITLE.match(tag)[1].lower()
            if name in RAW:
                ended = re.compile(f"</{name}(?![A-Za-z0-9-])[^>]*+>?", re.IGNORECASE).search(html, end)
                if not ended:
                    break
                held.append(f"</{name}>")
                end = ended.end()
        elif after in ("!", "?") or after == "/":
            end = html.find(">", start) + 1
            if not end:
                break
            closing = _TITLE.match("<" + html[start + 2 : start + 66]) if after == "/" else None
            if closing:
                held.append(f"</{closing[1]}>")
        else:
            held.append("&lt;")
            end = start + 1
        size += end - at
        at = end
        if size > FEED:
            yield "".join(held)
            size, held = 0, []
    yield "".join(held)


class Line:
    __slots__ = ("text", "tags", "linked", "links", "region", "apart", "head")

    def __init__(self, text: str, tags: int, linked: int, links: int, region: int, apart: int, head: bool):
        self.text, self.tags, self.linked, self.links, self.region, self.apart, self.head = text, tags, linked, links, region, apart, head


class Element:
    __slots__ = ("name", "region", "apart", "unseen", "link", "aside")

    def __init__(self, name: str = "", region: int = 0, apart: int = 0, unseen: bool = False, link: bool = False, aside: tuple | None = None):
        self.name, self.region, self.apart, self.unseen, self.link = name, region, apart, unseen, link
        self.aside = aside  # the text before an inline element that stands apart, which goes on after it


class Lines(HTMLParser):
    """Lines of the visible text of a page, and the trees of its regions and of the elements that stand apart.

    Regions and elements apart have numbers from 1 on, in the order in which they
    open, and 0 is none. Each open element knows the innermost of both around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.region_of, self.kind_of, self.apart_in = [0], [""], [0]  # of a region: the one around it, its element, the element apart around it
        self.apart_of, self.layout = [0], [False]  # of an element apart: the one around it, whether it may be taken back for its text alone
        self._stack: list[Element] = []
        self._places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
        self._blocks: list[int] = []  # where in the stack blocks are
        self._unseen = 0
        self._text: list[str] = []
        self._home: Element | None = None  # where the line's text begins
        self._tags = self._links = self._linked = self._begun = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            top = self._home or Element()
            head = any(self._places[f"h{k}"] for k in range(1, 7))
            self.lines.append(Line(text, self._tags, min(self._linked, len(text)), self._begun, top.region, top.apart, head))
            self._tags = 0
        self._linked = self._begun = 0
        self._home = None

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            top = self._stack[-1]
            if (top.name in BLOCKS or top.aside) and not self._unseen:
                self._flush()
            self._stack.pop()
            if top.name:
                self._places[top.name].pop()
            self._links -= top.link
            if top.aside:
                self._text, self._linked, self._home = top.aside
            if self._blocks and self._blocks[-1] == len(self._stack):
                self._blocks.pop()
            self._unseen -= top.unseen

    def _judged(self, tag: str, attrs) -> tuple[bool, bool, bool]:
        """Whether an element is unseen, whether it stands apart, and whether by its place in the layout only."""
        if tag in UNSEEN:
            return True, False, False
        within = bool(self._places["article"] or self._places["main"])
        apart, layout = tag in APART or tag == "header" and not within, tag in ("form", "header")
        for key, value in attrs:
            value = (value or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _GONE.search(value):
                return True, False, False
            if tag in ("html", "body", "main"):
                continue
            if key == "role" and value in ROLES:
                apart = True
            if key in ("class", "id"):
                named = [t for t in value.split() if names_part(t) and not (within and t == "header")]
                if named:
                    layout = not apart and all(LAYOUT.issuperset(PARTS.intersection(_NAME.findall(t))) for t in named)
                    apart = True
        return False, apart, layout

    def handle_starttag(self, tag: str, attrs) -> None:
        self._tags += not self._unseen
        if tag in BLOCKS:
            if not self._unseen:
                self._flush()
            if self._blocks and self._stack[self._blocks[-1]].name == "p":  # a block ends an open paragraph and what is inline in it
                self._pop(self._blocks[-1])
        if tag in CLOSES:
            last = lambda names: max((self._places[n][-1] for n in names if self._places[n]), default=-1)
            if (at := last(CLOSES[tag])) > last(KEEPS):
                self._pop(at)
        if tag == "a" and self._places["a"]:
            self.handle_endtag("a")  # links don't nest
        if tag in ("td", "th") and self._linked and self._linked >= sum(len(t.strip()) for t in self._text):
            self._flush()  # a cell of links only is a line
        if tag in VOID or tag in ("td", "th"):
            self._text.append(" ")
        if tag in VOID:
            return
        top = self._stack[-1] if self._stack else Element()
        unseen, apart, layout = self._judged(tag, attrs) if attrs or tag in UNSEEN or tag in APART or tag == "header" else (False, False, False)
        number, region = top.apart, top.region
        aside = None
        if apart and tag not in BLOCKS:
            aside, self._text, self._linked, self._home = (self._text, self._linked, self._home), [], 0, None
        if apart:
            number = len(self.apart_of)
            self.apart_of.append(top.apart)
            self.layout.append(layout)
        if tag in REGIONS or tag in LISTS:
            region = len(self.region_of)
            self.region_of.append(top.region)
            self.kind_of.append(tag)
            self.apart_in.append(number)
        self._unseen += unseen
        link = tag == "a" and any(key == "href" for key, _ in attrs)
        self._links += link
        self._begun += link
        self._places[tag].append(len(self._stack))
        if tag in BLOCKS:
            self._blocks.append(len(self._stack))
        self._stack.append(Element(tag, region, number, unseen, link, aside))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += not self._unseen
        if tag == "p" and not self._unseen:
            self._flush()
        if not self._places[tag]:
            return
        at = self._places[tag][-1]
        if tag not in BLOCKS and self._blocks and self._blocks[-1] > at and not self._stack[at].unseen:
            self._places[tag].pop()  # an inline element that ends within a block which it holds: the block goes on
            self._links -= self._stack[at].link
            self._stack[at].name, self._stack[at].link = "", False
        else:
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self._unseen:
            self._text.append(data)
            if self._home is None and not data.isspace():
                self._home = self._stack[-1] if self._stack else None
            if self._links:
                self._linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._pop(0)
        self._flush()


def names_part(token: str) -> bool:
    """Whether a class or id names a part of a page that stands apart."""
    names = frozenset(_NAME.findall(token))
    parts = names & PARTS
    if not parts or parts == {"header"} and "page" in names:
        return False
    rest = names - parts - JOINED
    return not rest or bool(parts & COMMENTS) and rest <= JOINED_COMMENTS


def visible(page: Lines) -> list[Line]:
    """The lines that do not stand apart, or that are taken back as next to nothing would be left."""
    apart_of, total = page.apart_of, sum(len(x.text) for x in page.lines)
    own, running, holds = [0] * len(apart_of), [False] * len(apart_of), [False] * len(apart_of)
    for x in page.lines:
        own[x.apart] += len(x.text)
        running[x.apart] |= x.head or len(x.text) - x.linked > RUNNING
    for k, kind in enumerate(page.kind_of):
        holds[page.apart_in[k]] |= kind in ("article", "main")
    left, back = own[0], {0}
    if left < NOTHING * total and not any(page.kind_of[r] in ("article", "main") for r in _around(page, [x.region for x in page.lines if not x.apart])):
        mass, inner = own[:], defaultdict(list)
        for k in range(len(apart_of) - 1, 0, -1):
            mass[apart_of[k]] += mass[k]
            inner[apart_of[k]].append(k)
        queue = [(-mass[k], k) for k in inner[0]]
        heapq.heapify(queue)
        while queue and left < NOTHING * total:
            _, k = heapq.heappop(queue)
            if holds[k] or page.layout[k] and running[k]:
                back.add(k)
                left += own[k]
                for j in inner[k]:
                    heapq.heappush(queue, (-mass[j], j))
    return [x for x in page.lines if x.apart in back]


def _around(page: Lines, regions: list[int]) -> set[int]:
    """The regions and all around them."""
    seen: set[int] = set()
    for r in regions:
        while r and r not in seen:
            seen.add(r)
            r = page.region_of[r]
    return seen


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the window is cut off at the ends and weighs 1 there too."""
    reach = math.ceil(2 * sigma)
    window = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(values)):
        lo, hi = max(0, k - reach), min(len(values), k + reach + 1)
        part = window[lo - k + reach : hi - k + reach]
        out.append(sum(v * w for v, w in zip(values[lo:hi], part, strict=True)) / sum(part))
    return out


def clusters(ratios: list[float]) -> list[range]:
    """Runs of lines whose smoothed ratio reaches the threshold."""
    level = THRESHOLD * sum(ratios) / len(ratios)
    out: list[range] = []
    for k, r in enumerate(ratios):
        if r >= level and r > 0:
            if out and out[-1].stop == k:
                out[-1] = range(out[-1].start, k + 1)
            else:
                out.append(range(k, k + 1))
    return out


def content(page: Lines) -> list[Line]:
    """The lines of the region that the clusters choose."""
    lines = visible(page)
    if not lines:
        return []
    parent, n = page.region_of, len(page.region_of)
    article = [kind in ("article", "main") for kind in page.kind_of]
    for r in range(1, n):
        article[r] |= article[parent[r]]  # or within one
    size, linked, links, running = [0] * n, [0] * n, [0] * n, [False] * n
    for x in lines:
        running[x.region] |= len(x.text) - x.linked > RUNNING
        size[x.region] += len(x.text)
        linked[x.region] += x.linked
        links[x.region] += x.links
    for r in range(n - 1, 0, -1):
        size[parent[r]] += size[r]
        linked[parent[r]] += linked[r]
        links[parent[r]] += links[r]
        running[parent[r]] |= running[r]
    menu = [not article[r] and not running[r] and links[r] > 2 and linked[r] >= LINKED * size[r] for r in range(n)]
    for r in range(1, n):
        menu[r] |= menu[parent[r]] and not article[r]
    lines = [x for x in lines if not menu[x.region]]
    if not lines:
        return []
    found = clusters(smooth([(len(x.text) - x.linked) / max(1, x.tags) for x in lines]))
    weight = [sum(len(lines[k].text) - lines[k].linked for k in c) for c in found]
    mass = [0.0] * n
    for c, w in zip(found, weight, strict=True):
        if 10 * w >= max(weight):  # a stray cluster has no say
            for k in c:
                mass[lines[k].region] += len(lines[k].text) - lines[k].linked
    for r in range(n - 1, 0, -1):
        mass[parent[r]] += mass[r]
    # the innermost region, which opened last, that holds most of what the clusters hold
    region = max((r for r in range(1, n) if mass[r] > 0.5 * mass[0] and page.kind_of[r] in REGIONS), default=0)
    while region and mass[parent[region]] - mass[region] > 0.2 * mass[region]:  # one of several siblings
        region = parent[region]
    up = region
    while up:
        if page.kind_of[up] in ("article", "main"):
            region = up
        up = parent[up]
    inside = [r == region for r in range(n)]
    for r in range(1, n):
        inside[r] |= inside[parent[r]]
    if not region:
        return lines
    start = first = next(k for k, x in enumerate(lines) if inside[x.region])
    while first and page.kind_of[region] not in ("article", "main") and lines[first - 1].head:  # a title in a box of its own
        first -= 1
    return lines[first:start] + [x for x in lines if inside[x.region]]


def extract(html: str) -> str:
    """Main text of one page, a line a block."""
    parser = Lines()
    for part in whole_tags(html):
        parser.feed(part)
    parser.close()
    return "\n".join(x.text for x in content(parser))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    url = "url" if "url" in pages.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [extract(h) for h in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "url", "text", "n_chars"])

    from pyspark.sql import functions as F

    rows = pages.select(pages[id_col].alias("_id"), (pages[url] if url else F.lit(None)).cast("string").alias("url"), pages[html_col].alias("_html"))
    return map_batches(rows, run, f"_id {kind}, url string, text string, n_chars long").withColumnRenamed("_id", id_col)


def op4_html_text(spark, sf_dir):
    from millrace.runtime import table

    return extract_pages(table(spark, sf_dir, "pages"))
