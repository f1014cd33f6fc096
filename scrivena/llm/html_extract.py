"""Main text of HTML pages by tree scoring.

A page is read into a tree.  Each paragraph gives points, one for itself, one
for each comma and up to three for its length, to its container and half as
many to the next one out and so on; a container's points are discounted by the
share of its text that stands in links.  The best container is kept, with
those of its siblings that score nearly as well, head it or read as prose.  An
article or main around the best container stands for it and its siblings, if
less than half of its text stands in links; lists and sections within it of
which most text stands in links are left out.

What page furniture says (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is never read.  Furniture goes by
element, role, and class and id names of which all words say so; names that
say so in part only lessen an element's points.  Names never count on headings,
nor on what holds an article or, on pages without one, most of the text, nor,
as ids, on the sections of an article; a page that is empty by them is read
without them.

A page takes time in proportion to its length: open elements are indexed by
name, and what elements get from those around or within them is passed on in
one sweep over the tree.

Cases: a null or empty page has an empty text; broken markup is read as far as
it goes (unclosed and stray tags, a page cut anywhere, quotes within unquoted
values; a quote that never ends is an ordinary character); nesting of any depth
costs no recursion; very long pages are read whole; of containers with equal
points that of the least text, then the first, is kept; repeated rows are read each for
itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import html as references
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed xmp textarea title svg math".split())
FOREIGN = frozenset({"svg", "math"})
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "nav footer aside form fieldset button select option label input menu dialog canvas object embed audio video map head".split()
) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
# Words of class and id names that mark furniture; those of reader comments, which may outweigh the article; words that may stand beside them.
REMARKS = frozenset("comment comments commentlist disqus respond replies reviews".split())
MARKS = REMARKS | frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promotion promos promotions "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer foot sidebar side aside widget rail "
    "cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay subscribe subscription newsletter signup login "
    "share sharing social related recommended recommendations toolbar tags hidden".split()
)
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary post posts entry article articles story stories area box bar list block wrapper wrap "
    "container inner outer link links item items panel section title button buttons icon icons media module unit slot group row column col form sticky mobile desktop".split()
)
# Words that decide as the first or the last of a name, whatever stands beside them: those of reader comments and of adverts.
HEADS = REMARKS | frozenset("ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos newsletter".split())
# Last words of names that tell what a page allows, not what an element holds.
ALLOWED = frozenset("open opened closed on off enabled disabled allowed".split())
# Headings of reader comments.
REMARK_HEADING = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user|leave a|\d+)\W+)?(?:comments?|kommentare?|commentaires?|comentarios?)(?:\W+\d+)?\W*", re.I)
# First words of names that tell of a layout, and words by which a header is the article's own.
STATES = frozenset("no has have with without not show hide enable disable toggle".split())
OWN = frozenset("post entry article story".split())
WEAK, STRONG, REMARK = 1, 2, 3
# An element of the left kind ends where one of the right kinds begins.
ENDED_BY = {
    "p": BLOCK,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
} | dict.fromkeys(HEADINGS, HEADINGS)
# What may stand in a head; anything else ends it.
HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
SCOPES = frozenset("table ul ol dl select html body article section div".split())
# Where a block begins, the open elements of these names end.
ENDS = {name: [left for left, rights in ENDED_BY.items() if name in rights] for name in BLOCK}
# Inline end tags close nothing around these.
WALLS = ("article", "table", "body", "html")
PARAGRAPHS = frozenset("p pre li td dd dt blockquote".split())
# Left out of what is kept if most of their text stands in links.
LISTED = frozenset("ul ol dl div section table".split())

# An attribute by the HTML rules: a quote opens a value only where the value begins; one that never ends is part of an unquoted value.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+"
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_ATTRIBUTES = re.sub(r"\((?![?])", "(?:", ATTRIBUTE.pattern)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTES})*+)(>|\Z)", re.S)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=\d)")


class Node:
    """An element: its name, parent, children in order (elements and strings), whether it is furniture, how its names mark it, and what is around it."""

    __slots__ = ("article", "block", "children", "furniture", "header", "heading", "kept", "links", "mark", "name", "own", "parent", "points", "prose", "size")

    def __init__(self, name: str, parent: Node | None, furniture: bool, mark: int = 0):
        self.name, self.parent, self.furniture, self.mark = name, parent, furniture, mark
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = self.own = self.prose = 0
        self.kept = False
        self.block: Node = self if name in BLOCK or parent is None else parent.block
        self.article: Node | None = self if name in ("article", "main") else parent and parent.article
        self.header = name == "header" or parent is not None and parent.header
        self.heading = name in HEADINGS or parent is not None and parent.heading


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag, the first of each name."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def _is_furniture(name: str, attributes: dict[str, str], parent: Node) -> bool:
    if parent.furniture or name in FURNITURE:
        return True
    if name == "header" and parent.article is None:  # an article's own header has its headings
        return True
    if attributes and name not in ("html", "body", "article", "main"):
        return attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    return False


@lru_cache(maxsize=10_000)
def _name_mark(token: str) -> int:
    """How one class or id name marks its element."""
    words = [w for w in PARTS.split(token) if w]
    while len(words) > 1 and words[-1].removesuffix("x").isdigit():  # numbers and sizes
        words.pop()
    if not words or words[0] in STATES or MARKS.isdisjoint(words):
        return 0
    if words[-1] in ALLOWED:
        return WEAK
    if words[0] in HEADS or words[-1] in HEADS:
        return STRONG if REMARKS.isdisjoint(words) else REMARK
    if "header" in words and not OWN.isdisjoint(words):
        return 0
    if all(w in MARKS or w in BESIDE or w.removesuffix("x").isdigit() for w in words):
        return STRONG if REMARKS.isdisjoint(words) else REMARK
    return WEAK


def _mark(name: str, attributes: dict[str, str], parent: Node) -> int:
    """How an element's class and id names mark it."""
    if not attributes or parent.furniture or name in HEADINGS or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for key in ("class", "id"):
        mark = max(map(_name_mark, attributes.get(key, "").lower().split()), default=0)
        # Ids of sections are often made from their headings.
        if mark and mark != REMARK and name == "section" and (mark == WEAK or key == "id" and parent.article is not None):
            mark = 0
        found = max(found, mark)
    return found


def _settle(nodes: list[Node]) -> None:
    """Makes furniture of what is marked, but for what holds an article or, if there is none, most of the text.  Parents stand before their children."""
    if not any(node.mark > WEAK for node in nodes):
        return
    holds, named = set(), False
    for node in reversed(nodes):
        node.own = 0 if node.furniture else node.own + sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            node.parent.own += node.own
            if node.own and (node.name in ("article", "main") or id(node) in holds):
                holds.add(id(node.parent))
                named = True
    whole = nodes[0].own
    for node in nodes:
        if node.parent is not None and node.parent.furniture:
            node.furniture = True
        elif node.mark > WEAK and id(node) not in holds and (named or node.mark == REMARK or 2 * node.own <= whole):
            node.furniture = True


class _Open:
    """The open elements, outermost first, with the places of each name's, so that no lookup walks the tree."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of one of the names; 0 if there is none."""
        return max((places[-1] for name in names if (places := self.places.get(name))), default=0)

    def first_after(self, names: Iterable[str], place: int) -> int:
        """Place of the outermost open element of one of the names within the one at ``place``; 0 if there is none."""
        found = [places[k] for name in names if (places := self.places.get(name)) and (k := bisect.bisect_right(places, place)) < len(places)]
        return min(found, default=0)


def parse(page: str, marks: bool = True) -> tuple[Node, list[Node]]:
    """The page as a tree, and its elements in order.  End tags close the nearest open element of their name; stray ones are skipped."""
    root = Node("#root", None, False)
    at, opened, nodes = 0, _Open(root), [root]
    unended: set[str] = set()  # names of drawings that no end tag follows
    while True:
        match = TOKEN.search(page, at)
        text = page[at : match.start() if match else len(page)]
        here = opened.stack[-1]
        if text:
            if here.name == "head" and not text.isspace():
                opened.cut(len(opened.stack) - 1)
                here = opened.stack[-1]
            here.children.append(text)
        if match is None:
            if marks:
                _settle(nodes)
            return root, nodes
        at = match.end()
        end, name, tag, _ = match.groups()
        if name is None:
            continue
        name = name.lower()
        if end:
            place = opened.last((name,))
            if place and name not in BLOCK and place < opened.last(WALLS):
                place = 0  # an inline end tag doesn't close blocks around it
            if place:
                opened.cut(place)
            elif name == "p":
                here.children.append(Node("p", here, here.furniture))
                nodes.append(here.children[-1])
            continue
        if here.name == "head" and name not in HEAD:
            opened.cut(len(opened.stack) - 1)
        if name in ENDS and (place := opened.first_after(ENDS[name], opened.last(SCOPES))):
            opened.cut(place)  # a block ends the open elements that it can't stand in, and what is open in those
        here = opened.stack[-1]
        attributes = attributes_of(tag) if tag else {}
        furniture = _is_furniture(name, attributes, here)
        node = Node(name, here, furniture, _mark(name, attributes, here) if marks and not furniture else 0)
        here.children.append(node)
        nodes.append(node)
        closed = tag.endswith("/") and not (attributes and ATTRIBUTE.findall(tag)[-1][3].endswith("/"))  # a slash that ends an unquoted value is part of it
        if name in VOID or closed and (name in FOREIGN or name not in BLOCK and name not in RAW):
            continue
        if name in RAW:
            close = None if name in unended else _end_of(name).search(page, at)
            if close is None and name in FOREIGN:
                unended.add(name)
            if close or name not in FOREIGN:  # what is after a drawing that never ends is the page
                at = close.end() if close else len(page)
            continue
        opened.push(node)


@lru_cache(maxsize=100)
def _end_of(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)


def _blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(container, text, characters of it in links) of each block of text under ``top``, in page order."""
    pieces: list[str] = []
    owner, linked = top, 0

    def flush() -> tuple[Node, str, int] | None:
        text = SPACE.sub(" ", references.unescape("".join(pieces))).strip()
        pieces.clear()
        return (owner, text, linked) if text else None

    stack: list[tuple[Node, int, bool]] = [(top, 0, top.name == "a")]
    while stack:
        node, k, in_link = stack.pop()
        while k < len(node.children):
            child = node.children[k]
            k += 1
            if isinstance(child, str):
                pieces.append(child)
                linked += len(child) * in_link
                continue
            if child.name == "br":
                pieces.append(" ")
            if child.furniture or child.name in VOID and child.name != "hr":
                if child.name in BLOCK and (found := flush()):
                    yield found
                    linked = 0
                continue
            if child.name in BLOCK:
                if found := flush():
                    yield found
                owner, linked = child, 0
            stack.append((node, k, in_link))
            stack.append((child, 0, in_link or child.name == "a"))
            break
        else:
            if node.name in BLOCK or node is top:
                if found := flush():
                    yield found
                linked = 0
                owner = (node.parent or top).block


def main_text(page: str | None) -> str:
    """The blocks of the page's main text, joined by blank lines."""
    if not page:
        return ""
    return _text_of(*parse(page)) or _text_of(*parse(page, marks=False))


def block_points(owner: Node, text: str) -> float:
    """What a block of text gives to its container."""
    if owner.name in HEADINGS or len(text) < 25:
        return 0.25
    return 1 + text.count(",") + min(len(text) // 100, 3)


def _score(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    """Passes points, sizes and linked characters of blocks on to all that is around them."""
    for owner, text, linked in blocks:
        paragraph = owner.name in PARAGRAPHS or owner.name in HEADINGS
        container = owner.parent if paragraph and owner.parent is not None else owner
        container.points += block_points(owner, text)
        container.size += len(text)
        container.links += min(linked, len(text))
        container.prose += linked < 0.25 * len(text) and (len(text) > 80 or text[-1] in ".!?:")
    for node in reversed(nodes):  # children stand after their parents
        if node.parent is not None:
            node.parent.points += node.points / 2 if node.block is node else node.points
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.prose += node.prose


def value(node: Node) -> float:
    """A container's points, discounted by the share of its text in links and by what its names say."""
    return node.points * (1 - node.links / max(1, node.size)) / (2 if node.mark == WEAK else 1)


def _text_of(root: Node, nodes: list[Node]) -> str:
    blocks = [b for b in _blocks(root) if not b[0].header or b[0].heading]
    blocks = [b for b in blocks if not (b[0].heading and REMARK_HEADING.fullmatch(b[1]))]
    if not blocks:
        return ""
    _score(blocks, nodes)
    best = max((n for n in nodes if n.size and n.block is n), key=lambda n: (value(n), -n.size))
    whole = best.article
    if whole is not None and 2 * whole.links < whole.size:
        whole.kept = True
    else:
        best.kept = True
        if best.parent is not None:
            _keep_siblings(best, blocks)
    for node in nodes:
        if node.parent is not None and node.parent.kept:
            node.kept = not (node.name in LISTED and node is not best and 2 * node.links > node.size and not node.prose)
    return "\n\n".join(text for owner, text, _ in blocks if owner.kept)


def _keep_siblings(best: Node, blocks: list[tuple[Node, str, int]]) -> None:
    """Siblings that score a fifth as well, headings before the best container, paragraphs beside it, and what stands between these."""
    siblings = [c for c in best.parent.children if isinstance(c, Node) and not c.furniture]
    least = max(2.0, 0.2 * value(best))
    for c in siblings[: siblings.index(best)]:
        c.kept = c.kept or c.name in HEADINGS
    for c in siblings:
        c.kept = c.kept or value(c) >= least
    for owner, text, linked in blocks:
        if owner.name == "p" and owner.parent is best.parent and linked < 0.25 * len(text) and (len(text) > 80 or text[-1:] in ".!?"):
            owner.kept = True
    kept = [k for k, c in enumerate(siblings) if c.kept]
    for c in siblings[kept[0] : kept[-1]]:  # what stands between parts of the article, unless names or links speak against it
        c.kept = c.kept or not c.mark and 2 * c.links <= c.size


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    found = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
