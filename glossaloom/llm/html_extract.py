"""Main text of web pages by tree scoring.

The markup is read once, from its start to its end, into a tree that tolerates
missing end tags; a tag that is not closed ends where the next begins. Parts
that are something other than the article by their tag or role (menus, page
headers and footers, forms, scripts, styles) go first. A container that names
itself as such (sidebars, notices, adverts, comments) goes if what it holds
agrees: never if that is most of the page, and if the name may mean something
else (``side-effects``, ``discussion``) only where it is full of links, or
outside of the article not prose. A heading goes by its tag alone, a paragraph
if its class is such names only or an advert's. A form that holds most of the
page is looked into. If nothing is left, names don't count, and then all text
does. Each paragraph then passes points to its ancestors: one,
one for every comma and one for every hundred characters up to three, the whole
to its parent, half to the next and less beyond. A container's score is
discounted by its link density. The best container is kept, widened to the
``article`` or ``main`` element it stands in, with siblings that score like
content.

Text of a kept container is kept whole except for lists and containers of
several short links; headings and paragraphs that are links stay. Character
references are decoded, white space inside a block becomes one space, and
blocks are joined by one space in page order.

Null or empty html gives an empty text. Pages of any length are read whole, in
time that follows their length: what a step needs to know of a subtree or of
the open elements is counted along. Pages are independent rows, so ties and
repeated rows need no rule, and an empty table gives an empty one. Extra columns
pass through whatever their names; a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# every alternative that begins with "<!", "</x" or "<x" matches to some end, so nothing is read twice
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^<>=]++|=)*+)(?:>|(?=<)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"br", "option", "body", "html", "head"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl menu html body td th div section article main aside nav header footer form blockquote".split())

DROPPED_TAGS = frozenset("nav footer aside form script style noscript template svg math canvas iframe object embed applet button select textarea input label fieldset dialog head title menu audio video map xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
#: Parts of class and id names of what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners nav navi navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars side rail footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion responses cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay lightbox share sharing social related recommended recommendations pagination pager paging widget widgets login signin register search skip outbrain taboola copyright disclaimer legal tags toc paywall".split()
)
KEPT_ANYWAY = frozenset("html body main".split())
#: Names that an article element must have to be dropped.
DROPPED_ARTICLES = frozenset("ad ads advert advertisement comment comments promo promoted related reply replies response sponsored teaser widget".split())
WRAPPER_PREFIX = frozenset("has with no without is".split())
#: Names that also head parts of articles, and words beside a name that leave its meaning as it is.
AMBIGUOUS = frozenset("discussion discussions register side legal head foot rail response responses tags toc".split())
MODIFIERS = frozenset(
    "section area box list wrapper wrap container block content inner outer bar left right top bottom main site page post posts article articles story stories news product products entry global primary secondary mobile desktop sticky fixed form links link item items group row col column module panel region zone title body text button buttons icon icons media meta count tools actions respond unit slot space".split()
)
#: A paragraph with one of these among its classes is none of the article.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored promo newsletter cookie cookies breadcrumb breadcrumbs".split())
#: A named container stays if it holds this share of the page and its title, or the other share of a page without one; a doubtful one stays up to this share of linked text.
MOST, ALMOST_ALL, LINKED, PROSE = 0.5, 0.85, 0.33, 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote".split())
#: What may be a menu if it is mostly links, and how many characters its links have at most on average.
LISTS = frozenset("ul ol dl dir div section table tbody tr center".split())
SHORT_LINK = 25
SENTENCE_ENDS = frozenset(".!?。！？")
CONTENT_NAMES = frozenset("article content main post entry story text body".split())


#: Elements that names may drop; and those of which an id is no name, as it is often made from a heading.
CONTAINERS = frozenset("div section article ul ol dl menu table tbody tr td center figure details dir".split())
NO_ID = frozenset("section article".split())
#: Elements that end tags and implied ends look for within their scope.
TRACKED = frozenset("p li dt dd tr td th option tbody thead".split())
TABLE_SCOPE = SCOPE - {"td", "th"}
PAGE_WIDE = 0.5


class Node:
    __slots__ = ("tag", "parent", "parts", "score", "size", "linked", "name_bonus", "label", "named", "titled", "inside", "held", "table_held", "chars", "commas", "links", "link_size", "solid")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.score, self.size, self.linked, self.name_bonus, self.label = 0.0, 0, 0, 0, ""
        self.named = ""  # "named" or "doubt" if its names say that it is not the article
        #: of the text: characters, commas; of outermost links: number and size; a heading or sentence is in it
        self.chars = self.commas = self.links = self.link_size = 0
        self.solid = self.titled = False
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        #: open elements by tag, within the nearest scope that begins here or above
        self.held: dict[str, int] = {} if parent is None or tag in SCOPE else parent.held
        self.table_held: dict[str, int] = {} if parent is None or tag in TABLE_SCOPE else parent.table_held


def _dropped(tag: str, attributes: str, inside: bool) -> str:
    """"all" if the element is not part of the article, "rest" if only its headings are, "named" or "doubt" if its names say so, else empty; inside: of article or main."""
    if tag in DROPPED_TAGS:
        return "all"
    if tag == "header":
        return "rest" if inside else "all"
    if not attributes or tag in KEPT_ANYWAY:
        return ""
    told = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "all"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "all"
        if name == "role" and value.strip() in DROPPED_ROLES:
            return "all"
        if tag not in CONTAINERS:
            words = value.split()
            if name == "class" and tag not in HEADINGS and words and (DROPPED_NAMES.issuperset(words) or tag == "p" and ADVERTS.intersection(words)):
                return "all"
        elif name in ("class", "id"):
            for word in value.split():
                parts = {x for x in re.split(r"[^a-z0-9]+", word) if x}
                hit = (DROPPED_ARTICLES if tag == "article" else DROPPED_NAMES) & parts
                if not hit or parts & WRAPPER_PREFIX:
                    continue
                if hit == {"header"} and inside:
                    return "rest"
                sure = hit - AMBIGUOUS and all(x in hit or x in MODIFIERS or x.isdigit() for x in parts)
                if sure:
                    told = "named"
                elif not (name == "id" and tag in NO_ID):  # such an id is made from a heading
                    told = told or "doubt"
    return told


def _named_content(attributes: str) -> bool:
    return any(name.lower() in ("class", "id", "role", "itemprop") and CONTENT_NAMES.intersection(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())) for name, *values in _ATTRIBUTE.findall(attributes))


class Reader:
    """Reads markup into a tree of what may be the article; parts are nodes and decoded strings."""

    def __init__(self, html: str, forms: bool = False):
        self.html, self.forms = html, forms
        self.root = self.here = Node("#", None)
        self.skip: list[str] = []  # open elements inside one that is dropped
        self.skipped: dict[str, int] = {}
        self.open: dict[str, int] = {}
        self.headings: Node | None = None  # the element of which only headings stay
        self.in_forms = self.form_at = 0
        at = 0
        for m in iter(lambda: _TOKEN.search(html, at), None):
            self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                at = self._end_tag(m[2].lower(), at) if m[1] else self._start_tag(m[2].lower(), m[3], m.start(), at)
        self._text(html[at:])
        if "form" in self.skip:
            self.in_forms += len(html) - self.form_at

    def _text(self, text: str) -> None:
        if text and not self.skip and self.here is not self.headings:
            self.here.parts.append(unescape(text) if "&" in text else text)

    def _enter(self, node: Node) -> None:
        parent, tag = self.here, node.tag
        parent.parts.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in TRACKED:
            parent.held[tag] = parent.held.get(tag, 0) + 1
            parent.table_held[tag] = parent.table_held.get(tag, 0) + 1
        self.here = node

    def _leave(self, last: Node) -> None:
        """Close all up to and with a node."""
        while True:
            node = self.here
            self.here = parent = node.parent
            self.open[node.tag] -= 1
            if node.tag in TRACKED:
                parent.held[node.tag] -= 1
                parent.table_held[node.tag] -= 1
            if node is self.headings:
                self.headings = None
            if node is last:
                return

    def _nearest(self, tags) -> Node:
        """The innermost open element of these tags, which is there."""
        node = self.here
        while node.tag not in tags:
            node = node.parent
        return node

    def _skip(self, tag: str) -> None:
        self.skip.append(tag)
        self.skipped[tag] = self.skipped.get(tag, 0) + 1

    def _unskip(self, tag: str) -> None:
        while True:
            last = self.skip.pop()
            self.skipped[last] -= 1
            if last == tag:
                return

    def _end_tag(self, tag: str, at: int) -> int:
        if self.skip:
            if self.skipped.get(tag):
                self._unskip(tag)
                if tag == "form" and not self.skipped[tag]:
                    self.in_forms += at - self.form_at
            elif tag in KEPT_ANYWAY and self.open.get(tag):
                self.skip, self.skipped = [], {}  # an end tag of something further out ends what was left open
            else:
                return at
            if self.skip or tag not in KEPT_ANYWAY:
                return at
        if (self.here.held if tag in ("p", "li", "dt", "dd", "tr") else self.open).get(tag):
            self._leave(self._nearest((tag,)))
        elif tag in ("p", "br"):
            self.here.parts.append(Node("br", self.here))
        return at

    def _imply_ends(self, tag: str) -> None:
        if tag in ENDS_PARAGRAPH and self.here.held.get("p"):
            self._leave(self._nearest(("p",)))
        if tag in CLOSES and any(self.here.table_held.get(x) for x in CLOSES[tag]):
            self._leave(self._nearest(CLOSES[tag]))
            if tag in ("tr", "tbody", "tfoot"):
                while self.here.parent and self.here.tag in CLOSES[tag]:
                    self._leave(self.here)

    def _start_tag(self, tag: str, attributes: str, begin: int, at: int) -> int:
        closed = tag in VOID or attributes.endswith("/") and tag in ("svg", "math", "path", "g", "use")
        if self.skip:
            if not closed:
                if tag in RAW:
                    return _raw_end(self.html, at, tag)
                if not (tag in CLOSES and self.skip[-1] in CLOSES[tag] or tag == "p" and self.skip[-1] == "p"):
                    self._skip(tag)
            return at
        self._imply_ends(tag)
        here = self.here
        what = "" if tag == "form" and self.forms else _dropped(tag, attributes, here.inside)
        if self.headings is not None and tag not in HEADINGS and here is self.headings and not what and not closed:
            what = "" if tag in ("div", "hgroup", "section") else "all"
        if what == "all":
            if tag in BLOCK:
                here.parts.append(Node("br", here))
            if tag in RAW:
                return _raw_end(self.html, at, tag)
            if not closed:
                self._skip(tag)
                if tag == "form":
                    self.form_at = begin
            return at
        node = Node(tag, here)
        if closed:
            here.parts.append(node)
            return at
        node.label = attributes.strip() if tag in ("div", "section", "td") else ""
        if attributes and tag in ("div", "section", "article", "main", "td") and _named_content(attributes) or tag in ("article", "main"):
            node.name_bonus = 25
        self._enter(node)
        if what == "rest":
            self.headings = node
        elif what:
            node.named = what
        return at


def parse(html: str) -> Node:
    """The tree of what may be the article."""
    read = Reader(html)
    return Reader(html, forms=True).root if read.in_forms > PAGE_WIDE * len(html) else read.root


def _open(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


_ENDS: dict[str, re.Pattern] = {}


def _raw_end(html: str, at: int, tag: str) -> int:
    m = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)).search(html, at)
    return m.end() if m else len(html)


COMMAS = ",、，،"


def _measure(root: Node) -> list[Node]:
    """What each node's text is made of; every node, deepest last; without recursion."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        node.size = node.linked = node.chars = node.commas = node.links = node.link_size = 0
        node.solid = False
        node.titled = node.tag in ("h1", "main") or node.tag == "article" and not node.named
        link = link or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                size = len(part) - part.count(" ") if part.strip() else 0
                node.size += size
                node.linked += size if link else 0
                node.chars += len(part)
                node.commas += sum(part.count(c) for c in COMMAS)
            else:
                stack.append((part, link))
    for node in reversed(order):
        if node.tag == "a" and node.size:
            node.links, node.link_size, node.solid = 1, node.size, False
        elif node.tag in HEADINGS and node.size or node.tag == "p" and node.linked and _last(node) in SENTENCE_ENDS:
            node.solid = True
        if (up := node.parent) is not None:
            up.size += node.size
            up.linked += node.linked
            up.chars += node.chars
            up.commas += node.commas
            up.links += node.links
            up.link_size += node.link_size
            up.solid |= node.solid
            up.titled |= node.titled
    return order


def _without_named(root: Node, order: list[Node]) -> bool:
    """Take out the containers whose names and content agree that they are not the article; says whether there were any."""
    found = False
    for node in order:
        if not node.named or node.size >= (MOST if node.titled else 1 if root.titled else ALMOST_ALL) * root.size:
            continue
        if node.named == "doubt" and _density(node) <= LINKED and (node.inside or node.commas or node.chars >= PROSE):
            continue
        node.tag, node.parts, node.named, found = "br", [], "", True
    return found


def _last(node: Node) -> str:
    """The last character of a node's text."""
    return "".join(_texts(node)).strip()[-1:]


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _is_menu(node: Node) -> bool:
    """A list or container of several short links and little else, without a heading or a paragraph that is a sentence."""
    return _density(node) > 0.5 and not node.solid and node.links > 1 and node.link_size <= SHORT_LINK * node.links


def _texts(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            yield part
        else:
            stack.extend(reversed(part.parts))


def _pieces(node: Node) -> Iterator[str]:
    """Texts and the marks between blocks, in page order."""
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            yield part
            continue
        block = part.tag in BLOCK
        if part is not node and part.tag in LISTS and _is_menu(part):
            yield " "
            continue
        if block:
            yield " "
            stack.append(" ")
        stack.extend(reversed(part.parts))


def _is_paragraph(node: Node) -> bool:
    """A paragraph element, or a block with text of its own and no blocks in it."""
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "li", "dd", "article", "main", "body", "#") and any(isinstance(x, str) and x.strip() for x in node.parts)


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    if _without_named(root, order):
        order = _measure(root)
    if not root.size:  # names took all
        root = parse(html)
        order = _measure(root)
    return _main_text(root, order) or " ".join("".join(_texts_of_blocks(root)).split())


def _texts_of_blocks(root: Node) -> Iterator[str]:
    """All text, with marks between blocks."""
    stack: list = [root]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            yield part
            continue
        if part.tag in BLOCK:
            yield " "
            stack.append(" ")
        stack.extend(reversed(part.parts))


def _main_text(root: Node, order: list[Node]) -> str:
    scored: dict[int, Node] = {}
    for node in order:
        if not node.size or not _is_paragraph(node):
            continue
        strings = [x for x in node.parts if isinstance(x, str)]
        commas, chars = (node.commas, node.chars) if node.tag in PARAGRAPHS else (sum(x.count(c) for x in strings for c in COMMAS), sum(map(len, strings)))
        points = (1 + commas + min(3, chars / 100)) * (1 - _density(node))
        first = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        for level, ancestor in enumerate(_open(first)):
            if level > 5:
                break
            ancestor.score += points / (1, 2, 6, 9, 12, 15)[level]
            scored[id(ancestor)] = ancestor
    total = lambda x: (x.score + x.name_bonus) * (1 - _density(x))
    best = max((x for x in scored.values() if x.tag not in ("p", "li")), key=total, default=None)
    if best is None:
        return ""
    # the whole of an article counts, not only the section that holds most of it
    named = best.name_bonus > 0
    for x in _open(best.parent):
        if x.tag in ("article", "main") or x.name_bonus and not named and _density(x) < 0.33:
            best = x
            break
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        least = max(3.0, total(best) * 0.2)
        kept = [x for x in best.parent.parts if isinstance(x, Node) and (x is best or x.size and (_density(x) < 0.5 or x.tag in HEADINGS) and (total(x) >= least or _continues(x, best)))]
    elif best.tag == "article" and best.parent is not None:
        # an article may be told in several elements; short or linked ones are teasers
        kept = [x for x in best.parent.parts if isinstance(x, Node) and (x is best or x.tag == "article" and total(x) >= max(30.0, total(best) * 0.5) and _density(x) < 0.25)]
    return " ".join(" ".join("".join(_pieces(x)) for x in kept).split())


def _continues(node: Node, best: Node) -> bool:
    """A heading, a sentence, or a part like the best beside it."""
    if node.tag in HEADINGS:
        return True
    if node.tag == "p":
        text = "".join(_pieces(node)).strip()
        return node.size >= 80 and _density(node) < 0.25 or not node.linked and text[-1:] in ".!?"
    return not node.linked and node.tag == best.tag and (node.tag == "section" or bool(node.label) and node.label == best.label)


def _run(html: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with text (empty if there is none) and n_chars (its code points)."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep]).add("text", "string").add("n_chars", "long")
    return pages.select(*keep, html).mapInArrow(_run(html, keep), schema)
