"""Main text of web pages by tree scoring.

A page is parsed into a tree (unclosed tags as browsers read them).  Each
paragraph passes points for its length and commas to its ancestors, less with
every level; a container's points are discounted by its link density.  The
best container (the enclosing article, if it has one) is kept, with those of
its siblings that score well beside it or are written text, and other articles
that are more than teasers; elements that by tag, role or class are menus,
headers, footers, sidebars, notices, adverts, forms or comments are left out
everywhere.  Lists and boxes of links are menus only outside articles and with
no heading, paragraph or text before them.  A class or id is only a hint: points from such elements
count less, and those that hold the best container or another article, that
are headings, or that are written parts of the best container under a name
that can be a subject (``related-work``) stay; if nothing else is left, all do.

Text blocks follow block elements; inline tags and line breaks do not end a
block.  White space in a block becomes one space; blocks are joined by an
empty line in page order.

Comments under any name are known by place and repetition (``threads``): like
elements below the text, each with a byline and a date or the same last label.
A form that holds most of a page's text is a wrapper, not a form; if all text
is hidden by attributes, they do not count.  Whatever starts like a declaration
without being one (``<![foo[``) is a comment, as browsers read it.

Each page is judged alone: one scan, one Arrow pass, no shuffle.  Defined
results: null or empty html, or a page without text, gives the empty string;
repeated rows give repeated results; an empty table gives no rows; other
columns are not read.  Parsing, scoring and collecting walk flat lists, so
neither length nor depth of a page is limited.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody "
            "td tfoot th thead tr ul".split())
DROP = set("script style noscript template head title nav footer aside form button select option textarea input "
           "iframe object embed svg canvas audio video map dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
            "side widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent "
            "gdpr notice notices alert newsletter subscribe subscription signup share sharing social related "
            "recommended recommendations comment comments disqus reply replies respond popup modal overlay "
            "pagination pager toolbar login search skip".split())
HEADER = {"header", "topbar"}
# never main text, and words that name subjects as well as boxes
ASIDE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments disqus reply "
            "replies respond newsletter signup popup modal overlay gdpr".split())
SUBJECTS = set("side banner promotion navigation menu notice notices alert subscription sharing social related "
               "recommended recommendations login search".split())
CONSENT = {"cookie", "cookies", "consent"}
ENTRY = set("post entry hentry article story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# a start tag of the key ends an open element of these, up to the nearest of the stops
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = set("table td th caption button object html body".split())
DOCTYPE = re.compile(r"<!doctype[^>\[]*\[[^\]<]*(?:<[^\]<]*)*\]\s*>", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
PARAGRAPH = 25                 # characters from which a block earns points
WRITTEN = 80                   # characters of a part that is more than a label
LEVELS = 5
BYLINE = 60                    # characters of a comment's byline at most
LABEL = 30                     # of a label that comments end with


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "inside", "chars", "links", "score", "link", "named", "slug", "weight", "kind")

    def __init__(self, tag, parent, drop, inside, link, named=frozenset(), slug=False, kind=""):
        self.tag, self.parent, self.items, self.drop = tag, parent, [], drop
        self.inside, self.link = inside, link          # within an article; within a link
        self.named, self.slug = named, slug            # words of class and id that speak against it; of the id only
        self.chars = self.links = 0
        self.score = 0.0
        self.kind = kind                               # its class
        self.weigh()

    def weigh(self):
        own = 0.05 if self.named & ASIDE else 0.25 if self.named else 1.0
        self.weight = min(own, self.parent.weight) if self.parent else own


# how a page is read; the next way is tried when one leaves the article out
STRICT, OPEN_FORMS, BARE = range(3)
BY_FORM, DROPPED = 1, 2        # why a node is left out: only for a form around it, or for more


def _unwanted(tag: str, attrs: dict, inside: bool, way: int) -> int:
    """0, BY_FORM or DROPPED.  A form is only a wrapper under OPEN_FORMS, and
    attributes that hide an element say nothing under BARE."""
    form = tag == "form" or attrs.get("role") == "form"
    if tag in DROP and not form or tag == "header" and not inside:
        return DROPPED
    if way < BARE and tag not in ("html", "body") and (
            "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES and not form
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "")):
        return DROPPED
    return BY_FORM if form and way == STRICT else 0


def _words(names: str, entry: bool) -> set:
    """Words of a class or id, but for those after with or without and, in
    entries, those of categories and tags."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in TOKEN.findall(name)]
        end = next((i for i, w in enumerate(words) if w in ("has", "with", "no", "without")), len(words))
        if not (entry and words and words[0] in ("category", "tag")):
            out.update(words[:end])
    return out


def _named(tag: str, attrs: dict, inside: bool) -> tuple[frozenset, bool]:
    """The words of class and id that speak against an element, and whether
    they are of its id alone."""
    names, ident = attrs.get("class") or "", attrs.get("id") or ""
    if tag in ("html", "body", "main") or tag in HEADINGS or not (names or ident):
        return frozenset(), False
    against = WORDS if inside else WORDS | HEADER
    entry = tag == "article" or not ENTRY.isdisjoint(names.lower().split())
    kind, slug = _words(names, entry) & against, _words(ident, entry) & against
    if tag == "article":                               # a subject does not make it another thing
        kind, slug = kind & ASIDE, slug & ASIDE
    return frozenset(kind | slug), bool(slug) and not kind


class Tree(HTMLParser):
    """The page's nodes in the order of their start tags."""

    def __init__(self, way: int = STRICT):
        super().__init__(convert_charrefs=True)
        self.way, self.free, self.formed = way, 0, 0   # characters of text, and of text only in forms
        self.root = self.top = Node("html", None, 0, False, False)
        self.nodes, self.open = [self.root], {"html": 1}

    def _pop(self):
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def _close(self, tags, stops):
        if not any(self.open.get(t) for t in tags):
            return
        n = self.top
        while n.tag not in tags:
            if n.parent is None or n.tag in stops:
                return
            n = n.parent
        while self.top is not n:
            self._pop()
        self._pop()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body") and (tag == "html" or self.open.get("body")):
            return
        if tag in BLOCK:
            self._close({"p"}, SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])
        top = self.top
        drop = max(top.drop, _unwanted(tag, attrs, top.inside, self.way))
        n = Node(tag, top, drop, top.inside or tag in ("article", "main"), top.link or tag == "a",
                 *_named(tag, attrs, top.inside), attrs.get("class", ""))
        top.items.append(n)
        self.nodes.append(n)
        if tag not in VOID:
            self.top = n
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or not self.open.get(tag):
            return
        # the end of an inline element does not reach out of its block
        self._close({tag}, set() if tag in BLOCK else BLOCK)

    def handle_data(self, data):
        if not self.top.drop:
            self.top.items.append(data)
            self.free += len(data.strip())
        elif self.top.drop == BY_FORM:
            self.formed += len(data.strip())

    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end   # open comments reach to the end of the page

    def parse_html_declaration(self, i):
        """Document types, with what they declare in brackets; everything else
        that starts like a declaration is a comment up to the next bracket."""
        kind = DOCTYPE.match(self.rawdata, i)
        end = kind.end() if kind else self.rawdata.find(">", i + 2) + 1
        return end or len(self.rawdata)


def blocks(top: Node, skip=frozenset()) -> list[tuple[str, Node, int]]:
    """(text, innermost block element, characters in links) of the blocks under
    a node, in page order."""
    out, text, linked = [], [], 0
    home = top
    stack = [iter(top.items)]
    nodes = [top]

    def flush():
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, home, linked))
        text, linked = [], 0
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            n = nodes.pop()
            if n.tag in BLOCK:
                flush()
                home = next((x for x in reversed(nodes) if x.tag in BLOCK), top) if nodes else top
        elif isinstance(item, str):
            text.append(item)
            if nodes[-1].link:
                linked += len(item.strip())
        elif item.tag == "br":
            text.append(" ")
        elif not item.drop and item not in skip:
            if item.tag in BLOCK:
                flush()
                home = item
            stack.append(iter(item.items))
            nodes.append(item)
    flush()
    return out


def density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def up(n: Node):
    """A node and its ancestors, inside out."""
    while n is not None:
        yield n
        n = n.parent


def measure(tree: Tree, every: list) -> None:
    """Characters, characters in links and points of all nodes from blocks."""
    for n in tree.nodes:
        n.chars = n.links = 0
        n.score = 0.0
    for text, home, linked in every:
        home.chars += len(text)
        home.links += linked
        if len(text) >= PARAGRAPH:
            points = home.weight * (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3))
            n = home.parent if home.tag in ("p", "pre", "blockquote", "li", "td") and home.parent else home
            for level in range(LEVELS):
                if n is None:
                    break
                n.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                n = n.parent
    for n in reversed(tree.nodes[1:]):                 # children before parents
        n.parent.chars += n.chars
        n.parent.links += n.links


def points(n: Node) -> float:
    """A node's score, discounted by its link density."""
    return n.score * (1 - min(1.0, density(n)))


def choose(tree: Tree) -> tuple[Node, dict]:
    """The best container and the ranks of all."""
    rank = {n: points(n) + (25 * n.weight if n.tag in ("article", "main") else 0)
            for n in tree.nodes if not n.drop and n.chars and n.tag in BLOCK}
    best = max(rank, key=rank.get, default=tree.root)  # the first of equals
    for n in up(best):
        if n.tag in ("article", "main"):
            best = n
    return best, rank


def lift(tree: Tree, every: list) -> None:
    """The names of elements around most of the page's text do not count."""
    free = dict.fromkeys(tree.nodes, 0)
    for text, home, linked in every:
        if home.weight > 0.05:
            free[home] += len(text) - linked
    for n in reversed(tree.nodes[1:]):
        free[n.parent] += free[n]
    for n in tree.nodes:
        if n.named and not n.named & (ASIDE | CONSENT) and 3 * free[n] > 2 * free[tree.root]:
            n.named = frozenset()
        n.weigh()


def entries(tree: Tree, best: Node, rank: dict) -> list[Node]:
    """The articles of a page that are more than teasers beside the best."""
    barred, out = set(), []
    for n in tree.nodes:
        if n.parent in barred or n.named & ASIDE:
            barred.add(n)
        elif n.tag == "article":
            barred.add(n)                              # those inside it are no further articles
            if n in rank and density(n) < 0.5 and points(n) / n.weight >= 0.2 * points(best) / best.weight:
                out.append(n)
    return out


def named_out(tree: Tree) -> set:
    """The elements that their class or id leaves out."""
    best, rank = choose(tree)
    under, titled = {best}, set()
    for n in tree.nodes:
        if n.parent in under:
            under.add(n)
    for n in reversed(tree.nodes[1:]):
        if n in titled or n.tag in HEADINGS and n.chars:
            titled.add(n.parent)
    core = max((n for n in under if n in rank), key=points, default=best)
    hold = {*up(best), *up(core)}
    for n in entries(tree, best, rank):
        for x in up(n):
            if x in hold:
                break
            hold.add(x)
    out = set()
    for n in tree.nodes:
        if not n.named or n in hold:
            continue
        part = n in under and density(n) <= 0.5 and not n.named & ASIDE and (
            (n.named <= SUBJECTS or n.slug and n.tag == "section")
            and (n.chars > WRITTEN or n.slug and n in titled))
        if not part:
            out.add(n)
    return out


def loose(parent: Node, items: list, out: set) -> Node:
    """A run of text and inline elements between blocks, as a paragraph."""
    p = Node("p", parent, 0, parent.inside, parent.link)
    p.items = items
    for text, _, linked in blocks(p, out):
        p.chars += len(text)
        p.links += linked
    return p


def beside(tree: Tree, best: Node, rank: dict, out: set) -> list[Node]:
    """The best container, its siblings that belong to the text and the other
    articles, in page order."""
    if best.parent is None:
        return [best]
    owner, titled, at = {}, set(), None                # by sibling of best; with paragraphs
    for n in tree.nodes:
        owner[n] = n if n.parent is best.parent else owner.get(n.parent)
        if n.tag == "p" and n.chars and owner[n]:
            titled.add(owner[n])
        if n is best.parent:
            at = len(owner)
    others = [n for n in entries(tree, best, rank) if owner[n] is not best]
    place = {n: i for i, n in enumerate(tree.nodes, 1)} if others else {}
    within = {}
    for n in others:
        within.setdefault(owner[n], []).append(n)

    def belongs(x, free=False):
        d = density(x)
        if x.tag in HEADINGS:
            return d < 0.3
        if free:
            return d < 0.25 and (x.chars > WRITTEN or d == 0 and blocks(x, out)[-1][0].endswith((".", "!", "?", ":", "。")))
        if x.tag == "p":
            return d < 0.25 and (x.chars > WRITTEN or d == 0)
        return (x.tag in ("article", "main") and d < 0.5 or x.chars > WRITTEN and d < 0.25
                or points(x) > 0 and points(x) >= 0.2 * points(best) and (x.chars > WRITTEN or x in titled))
    keep, run = [n for n in within.get(None, ()) if place[n] < at], []
    for x in [*best.parent.items, None]:
        if isinstance(x, str) or x is not None and x.tag not in BLOCK:
            run.append(x)
            continue
        if run:
            text = loose(best.parent, run, out)
            run = []
            if text.chars and belongs(text, True):
                keep.append(text)
        if x is best or x is not None and x.chars and not x.drop and x not in out and belongs(x):
            keep.append(x)
        elif x is not None:
            keep += within.get(x, ())
    return keep + [n for n in within.get(None, ()) if place[n] > at]


def link_menus(tree: Tree, keep: list) -> set:
    """Lists and boxes of links outside articles that nothing introduces: no
    heading, paragraph or text stands before or in them."""
    flow = HEADINGS | {"p", "pre", "blockquote", "dl", "figure"}
    kept = set(keep)
    found = [n for n in tree.nodes if n.tag in ("ul", "ol", "div", "section", "table") and n.chars and not n.inside
             and density(n) > 0.7 and n not in kept]
    if not found:
        return set()
    around = set()                                     # with a heading or paragraph
    for n in reversed(tree.nodes[1:]):
        if n in around or n.tag in flow and n.chars:
            around.add(n.parent)
    told = {}                                          # by parent, what stands after text
    for p in {n.parent for n in found}:
        before = False
        for x in p.items:
            if isinstance(x, str):
                before = before or bool(x.strip())
            elif before:
                told[x] = True
            else:
                before = x.tag in flow and x.chars > 0
    return {n for n in found if n not in told and n not in around}


def threads(tree: Tree, keep: list, every: list, out: set) -> set:
    """Comments below the text, known by place and repetition: boxes that stand
    after written paragraphs and before none, hold less than half of the kept
    text, and consist of elements of one tag and class that each begin with a
    byline and are dated (a number in the byline, a time element) or end with
    the same short label.  ``every``: the page's blocks in order."""
    total, nodes = sum(n.chars for n in keep), tree.nodes
    inside, place = set(keep), {n: i for i, n in enumerate(nodes)}
    first, last, end, timed = {}, {}, {}, set()        # blocks and the last node under each node
    for i, (_, home, _) in enumerate(every):
        first.setdefault(home, i)
        last[home] = i
    for n in nodes:
        if n.parent in inside:
            inside.add(n)
    for n in reversed(nodes):
        end[n] = max(place[n], end.get(n, 0))
        if n.tag == "time":
            timed.add(n)
        if n.parent is not None:
            p = n.parent
            end[p] = max(end.get(p, 0), end[n])
            if n in first:
                first[p], last[p] = min(first.get(p, first[n]), first[n]), max(last.get(p, last[n]), last[n])
            if n in timed:
                timed.add(p)

    def mark(n: Node) -> str:
        """What a comment is known by ("": it is none)."""
        if n not in first or first[n] == last[n]:
            return ""
        (line, home, _), label = every[first[n]], every[last[n]][0]
        if len(line) > BYLINE or line[-1] in ".!?:;…。" or home.tag in HEADINGS:
            return ""
        return "\x00" if n in timed or any(c.isdigit() for c in line) else label if len(label) <= LABEL else ""
    written = [place[n] for n in nodes if n in inside and n.tag in ("p", "pre", "blockquote") and n.chars > WRITTEN and not n.drop]
    found = set()
    for box in nodes:
        if box.parent in found:
            found.add(box)
            continue
        if box not in inside or box in keep or box.tag not in ("ul", "ol", "div", "section") or not box.chars or 2 * box.chars > total:
            continue
        items: dict = {}
        for x in box.items:
            if not isinstance(x, str) and x.chars and x not in out and not x.drop:
                items.setdefault((x.tag, x.kind), []).append(x)
        same = max(items.values(), key=lambda v: sum(x.chars for x in v), default=[])
        if len(same) < 2 or sum(x.chars for x in same) < 0.8 * box.chars:
            continue
        marks = {mark(x) for x in same}
        if len(marks) != 1 or marks == {""}:
            continue
        top = box
        while top.parent in inside and top.parent not in keep and top.parent.chars - top.chars <= BYLINE:
            top = top.parent                           # with its heading
        if any(w < place[top] for w in written[:1]) and not any(w > end[top] for w in written[-1:]):
            found.add(top)
    return found


def main_text(html) -> str:
    if not html:
        return ""
    for way in (STRICT, OPEN_FORMS, BARE):
        tree = Tree(way)
        tree.feed(html)
        tree.close()
        every = blocks(tree.root)
        if every and tree.free > tree.formed:
            break
    if not every:
        return ""
    measure(tree, every)
    out = set()
    if any(n.named for n in tree.nodes):
        lift(tree, every)
        measure(tree, every)
        out = named_out(tree)
    if out:
        left = blocks(tree.root, out)
        out, every = (out, left) if left else (set(), every)
    measure(tree, every)
    best, rank = choose(tree)
    keep = beside(tree, best, rank, out)
    skip = out | link_menus(tree, keep)
    skip |= threads(tree, keep, every, skip)
    found = [text for n in keep for text, _, _ in blocks(n, skip)]
    return "\n\n".join(found or [text for text, _, _ in every])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def row(r):
        text = main_text(r[2])
        return r[0], r[1], text, len(text)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return src.mapInArrow(C.per_row(row, ["page_id", "url", "html"], schema),
                          "page_id long, url string, text string, n_chars long")
