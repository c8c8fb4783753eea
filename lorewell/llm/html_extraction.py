"""Main text of web pages by wrapper induction: same-host pages aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import small_batches

#: Pages of a host that are aligned together (up to twice as many, so that no small rest is left); constant text must stand in so many different pages, and in this share of them.
GROUP, LEAST_PAGES, CONSTANT_SHARE = 32, 4, 0.9
#: Pages of a task, and the most tasks (a task streams its pages, so more of them need no more memory).
TASK, MOST_TASKS = 2048, 100_000
#: Largest table (product of the lengths of two child lists) of the dynamic programme; beyond it the lists are halved first (Hirschberg), with the same sum.
MOST_CELLS = 1 << 20
#: Share of a slot's varying text that one child must hold to be the content; share of link text that makes a recurring slot a menu.
HOLDS, LINKS = 0.7, 0.6
#: Open elements below which further ones become siblings, as in browsers (their text stays in place).
DEPTH = 512
#: Texts of a block that are kept as they are; a longer one is kept by its digest.
SHORT_TEXT = 64
#: Longest line that may name the writer of a reader comment; share of a page's running text that names must leave, else they count for nothing.
SHORT_LINE, LEFT = 60, 0.1
#: Characters of html of pages that are aligned together (their trees take some fifty times as much memory).
GROUP_CHARS = 12 << 20

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style textarea title noscript iframe xmp nav footer aside form button select option menu svg math canvas template dialog audio video object map input label".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an open element to close stops.
SCOPE = frozenset("html body article section div main ul ol dl table td th blockquote aside nav header footer form".split())
# Words of class, id and role that usually mark page furniture, and words that may stand beside them in such a name.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer cookie cookies consent gdpr notice notices popup modal overlay alert comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar masthead copyright contentinfo complementary dialog form skip tracking widget".split())
BESIDE = frozenset("area bar block bottom box button buttons container group inner items item left link links list outer panel pane post posts right row section the top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td ul ol dl blockquote".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_END_OR_QUOTE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element (with its tag and marks) or, with tag '', a piece of text."""

    __slots__ = ("tag", "marks", "kids", "text", "slot", "shape")

    def __init__(self, tag: str, marks: frozenset = frozenset(), text: str = ""):
        self.tag, self.marks, self.text = tag, marks, text
        self.kids: list[Node] = []
        self.slot: Slot | None = None
        self.shape = -1

    def content(self) -> str:
        return self.text if not self.tag else "".join(k.content() for k in self.kids)


def _marks(tag: str, attributes: str) -> frozenset:
    if not attributes or attributes == "/":
        return frozenset()
    words: set[str] = set()
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                own = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                words.update(own)
                if own and FURNITURE.issuperset(w for w in own if w not in BESIDE) and not FURNITURE.isdisjoint(own):
                    words.add("*furniture")  # the name says nothing else: not related-work, with-sidebar, search-methods
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            words.add("*hidden")
    return frozenset(words)


def parse(page: str) -> Node:
    """A forgiving DOM: comments and declarations go, raw elements keep their text, unclosed elements end where HTML says or at their parent's end."""
    root = Node("#root")
    stack, opened = [root], Counter()
    at, last_end = 0, page.rfind(">")

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def add(node: Node) -> None:
        if len(stack) <= DEPTH:
            stack[-1].kids.append(node)
        elif node.tag:
            stack[DEPTH - 1].kids.append(node)
        else:  # a sibling like the element that it stands in
            holder = Node(stack[-1].tag, stack[-1].marks)
            holder.kids.append(node)
            stack[DEPTH - 1].kids.append(holder)

    while True:
        m = _OPEN.search(page, at)
        end = -1
        if m:
            if m[1]:
                end = page.find("-->", m.end())
                end = len(page) if end < 0 else end + 3
            elif m[2]:
                end = page.find(">", m.end()) + 1 or len(page)
            else:
                end = _tag_end(page, m.end(), last_end)
        text = page[at : m.start() if end >= 0 else len(page)]
        if text:
            add(Node("", text=html.unescape(text) if "&" in text else text))
        if end < 0:
            return root
        at = end
        if m[1] or m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        for closed in ({"p"} if tag in CLOSES_P else None, CLOSED_BY.get(tag)):
            if closed and any(opened[x] > 0 for x in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closed:
                        close(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
        node = Node(tag, _marks(tag, page[m.end() : end - 1]))
        add(node)
        if tag in RAW:
            closing = _RAW_END[tag].search(page, at)
            stop = closing.start() if closing else len(page)
            node.kids.append(Node("", text=page[at:stop]))
            at = page.find(">", stop) + 1 or len(page)
        elif tag not in VOID:  # in HTML a trailing slash does not close
            stack.append(node)
            opened[tag] += 1


def _tag_end(page: str, at: int, last_end: int) -> int:
    """Behind the > that ends a tag: the first outside quotes, or just the first where a quote is never closed; -1 where there is none."""
    while at <= last_end:
        m = _END_OR_QUOTE.search(page, at)
        if m[0] == ">":
            return m.end()
        closing = page.find(m[0], m.end())
        if closing < 0:
            return page.find(">", m.end()) + 1 or -1
        at = closing + 1
    return -1


class Slot:
    """A node of the wrapper: how many pages have it, the texts seen there, and the varying running text and all link text and text below it."""

    __slots__ = ("tag", "marks", "kids", "seen", "texts", "running", "linked", "total", "shape", "replies")

    def __init__(self, tag: str, marks: frozenset):
        self.tag, self.marks = tag, marks
        self.kids: list[Slot] = []
        self.seen, self.texts, self.shape, self.replies = 0, {}, -1, 0
        self.running = self.linked = self.total = 0

    def constant(self, pages: int) -> bool:
        """Whether nearly all different pages have the same text here: template, not content."""
        return pages >= LEAST_PAGES and bool(self.texts) and max(self.texts.values()) >= CONSTANT_SHARE * pages

    def menu(self, pages: int) -> bool:
        """Whether the text here is links on page after page."""
        return pages >= LEAST_PAGES and self.tag in CONTAINERS and self.seen >= 0.5 * pages and self.linked > LINKS * self.total


class Matcher:
    """Simple tree matching over the shapes of subtrees: equal subtrees have one number, and each pair of numbers is matched once.

    Nodes of one tag match: two points where their class, id and role words are
    equal, else one; children match in order, so as to gain most points."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.bodies: dict[tuple, int] = {}
        self.names: dict[frozenset, int] = {}
        self.inner: list[tuple] = []  # of each body: tag and children's numbers
        self.body: list[int] = []  # of each shape
        self.name: list[int] = []
        self.gains: dict[tuple[int, int], int] = {}

    def number(self, node) -> int:
        """The number of a subtree's shape (kept until a slot grows)."""
        if node.shape < 0:
            inner = (node.tag, *(self.number(k) for k in node.kids if k.tag))
            body = self.bodies.setdefault(inner, len(self.inner))
            if body == len(self.inner):
                self.inner.append(inner)
            name = self.names.setdefault(node.marks, len(self.names))
            node.shape = self.numbers.setdefault((body, name), len(self.body))
            if node.shape == len(self.body):
                self.body.append(body)
                self.name.append(name)
        return node.shape

    def inner_gain(self, a: int, b: int) -> int:
        """The points of two bodies without their names; 0 for different tags."""
        found = self.gains.get((a, b))
        if found is None:
            x, y = self.inner[a], self.inner[b]
            found = 0 if x[0] != y[0] else 1 + sum(self.gain(x[1 + i], y[1 + j]) for i, j in self.align(x[1:], y[1:]))
            self.gains[a, b] = found
        return found

    def gain(self, a: int, b: int) -> int:
        """The points of two subtrees matched at their roots; 0 for different tags."""
        found = self.inner_gain(self.body[a], self.body[b])
        return found + (self.name[a] == self.name[b]) if found else 0

    def align(self, left, right) -> list[tuple[int, int]]:
        """Pairs of children (numbers of shapes) in order with the most points; equal ends cannot do better than with each other."""
        if not left or not right:
            return []
        n, m, a = len(left), len(right), 0
        while a < n and a < m and left[a] == right[a]:
            a += 1
        tail = 0
        while n - tail > a and m - tail > a and left[n - 1 - tail] == right[m - 1 - tail]:
            tail += 1
        pairs = [(k, k) for k in range(a)]
        if n - tail > a and m - tail > a:
            points = Points(self, left[a : n - tail], right[a : m - tail])
            if points.inner.any():
                pairs += [(a + i, a + j) for i, j in _best_pairs(points)]
        return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]


class Points:
    """The points of all pairs of two lists of shapes, kept by their distinct bodies; a row is made when it is asked for."""

    def __init__(self, matcher: Matcher | None, left=(), right=()):
        if matcher is not None:
            (kinds, self.x), (others, self.y) = (_kinds([matcher.body[k] for k in some]) for some in (left, right))
            self.inner = np.array([[matcher.inner_gain(p, q) for q in others] for p in kinds], np.int64)
            self.names = np.array([matcher.name[k] for k in left]), np.array([matcher.name[k] for k in right])

    def part(self, x: slice, y: slice) -> Points:
        """The points of parts of both lists."""
        out = Points(None)
        out.x, out.y, out.inner, out.names = self.x[x], self.y[y], self.inner, (self.names[0][x], self.names[1][y])
        return out

    def row(self, i: int) -> np.ndarray:
        own = self.inner[self.x[i]][self.y]
        return own + ((self.names[1] == self.names[0][i]) & (own > 0))

    def at(self, i: int, j: int) -> int:
        own = self.inner[self.x[i], self.y[j]]
        return own + (self.names[0][i] == self.names[1][j]) if own else 0


def _kinds(numbers) -> tuple[list[int], np.ndarray]:
    """The distinct numbers of a list, and the place of each of its numbers among them."""
    places: dict[int, int] = {}
    at = [places.setdefault(k, len(places)) for k in numbers]
    return list(places), np.array(at)


def _rows(points: Points) -> Iterator[np.ndarray]:
    """For each end of the left list, from none on, the most points with every end of the right one."""
    row = np.zeros(len(points.y) + 1, np.int64)
    yield row
    for i in range(len(points.x)):
        new = np.zeros_like(row)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + points.row(i)))
        row = new
        yield row


def _best_pairs(points: Points) -> list[tuple[int, int]]:
    """Pairs in order of two lists with the most points; a long left list is halved where both halves gain most."""
    n, m = len(points.x), len(points.y)
    if n > 1 and n * m > MOST_CELLS:
        i = n // 2
        *_, ahead = _rows(points.part(slice(0, i), slice(None)))
        *_, back = _rows(points.part(slice(n, i - 1 if i else None, -1), slice(None, None, -1)))
        j = int(np.argmax(ahead + back[::-1]))
        return _best_pairs(points.part(slice(0, i), slice(0, j))) + [(i + p, j + q) for p, q in _best_pairs(points.part(slice(i, n), slice(j, m)))]
    rows = list(_rows(points))
    pairs, i, j = [], n, m
    while i and j:
        gain = points.at(i - 1, j - 1)
        if gain and rows[i][j] == rows[i - 1][j - 1] + gain:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


class Wrapper:
    """The template that a group of pages shares, grown page by page by partial tree alignment."""

    def __init__(self):
        self.root, self.pages, self.matcher = Slot("#root", frozenset()), 0, Matcher()
        self.content: list[Slot] = []

    def learn(self, page: Node) -> None:
        self.pages += 1
        self._into(self.root, page)

    def _into(self, slot: Slot, node: Node) -> bool:
        """Aligns a node with its slot; whether the slot grew."""
        slot.seen += 1
        node.slot = slot
        number = self.matcher.number
        elements, kids = [k for k in node.kids if k.tag], slot.kids
        taken = {j: i for i, j in self.matcher.align(tuple(map(number, kids)), tuple(map(number, elements)))}
        grown = len(taken) < len(elements)
        # unmatched children become new slots where they stand
        merged, placed = [], 0
        for j, e in enumerate(elements):
            if j in taken:
                merged += kids[placed : taken[j] + 1]
                placed = taken[j] + 1
            else:
                merged.append(Slot(e.tag, e.marks))
            e.slot = merged[-1]
        slot.kids = merged + kids[placed:]
        for e in elements:
            grown |= self._into(e.slot, e)
        if grown:
            slot.shape = -1
        if node.tag in BLOCK and not any(k.tag in BLOCK for k in elements):
            text = _SPACE.sub(" ", node.content()).strip()
            if len(text) > SHORT_TEXT:
                text = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if text:
                slot.texts[text] = slot.texts.get(text, 0) + 1
        return grown

    def measure(self, node: Node, linked: bool = False, constant: bool = False) -> tuple[int, int, int]:
        """Adds a learned page's varying running text, link text and text to its slots."""
        if not node.tag:
            n = len(node.text.strip())
            return 0 if constant else n * (-1 if linked else 1), n if linked else 0, n
        if node.tag in NEVER or "*hidden" in node.marks:
            return 0, 0, 0
        slot = node.slot
        own = [self.measure(k, linked or k.tag == "a", constant or slot.constant(self.pages)) for k in node.kids]
        running, links, total = (sum(x) for x in zip(*own, strict=True)) if own else (0, 0, 0)
        slot.running, slot.linked, slot.total = slot.running + running, slot.linked + links, slot.total + total
        slot.replies += running > 0 and replies(node)
        return running, links, total

    def induce(self) -> None:
        """The path of slots to the content: down the slot that holds nearly all varying running text, as long as there is one.

        Names decide only between slots that vary: one that is named an advert, a
        comment or the like is not the content while another one varies."""
        at, self.content = self.root, []
        while self.pages >= LEAST_PAGES:
            kids = [k for k in at.kids if k.tag not in NEVER and "*hidden" not in k.marks]
            plain = [k for k in kids if not _named_furniture(k) and k.running > 0]
            # reader comments stand after what they comment on
            heard = [k for n, k in enumerate(plain) if n and 2 * k.replies > k.seen]
            plain = [k for k in plain if k not in heard] or plain
            rest = sum(k.running for k in kids if k not in plain and (_named_furniture(k) or k in heard)) if plain else 0
            best = max(plain or kids, key=lambda k: k.running, default=None)
            if best is None or best.tag not in CONTAINERS or best.running <= 0 or best.running < HOLDS * (at.running - rest):
                return
            self.content.append(best)
            at = best

    def content_of(self, page: Node) -> tuple[Node, bool]:
        """The node of a learned page that stands in the content slot (or the last one on the way), and whether it is the content."""
        at = page
        for slot in self.content:
            below = next((k for k in at.kids if k.tag and k.slot is slot), None)
            if below is None:
                return at, False
            at = below
        return at, bool(self.content) and at.tag not in ("html", "body")


def _named_furniture(node) -> bool:
    return "*furniture" in node.marks and node.tag not in ("html", "body", "article", "main") and not {"article", "main"} & node.marks


def _furniture(node: Node, names: bool = True) -> bool:
    return node.tag in NEVER or "*hidden" in node.marks or (names and _named_furniture(node))


def _weight(node: Node, linked: bool = False, names: bool = True) -> tuple[int, int]:
    """Characters of running text outside furniture, and of these in links."""
    if not node.tag:
        n = len(node.text.strip())
        return n, n if linked else 0
    if _furniture(node, names):
        return 0, 0
    total = in_links = 0
    for k in node.kids:
        a, b = _weight(k, linked or node.tag == "a", names)
        total, in_links = total + a, in_links + b
    return total, in_links


def _unnamed(node: Node) -> None:
    """Takes back what names say below a node: they would leave next to nothing of its running text."""
    todo = [node]
    while todo:
        x = todo.pop()
        if "*furniture" in x.marks:
            x.marks -= {"*furniture"}
        todo += x.kids


def replies(node: Node) -> bool:
    """Whether an element is a list of reader comments by its form: at least two groups of one shape and nothing else with text.

    A group has a short line that ends no sentence (who, when) before its text, in blocks of its own, and no heading."""
    groups = [k for k in node.kids if k.tag and k.tag not in NEVER and _weight(k)[0]]
    if len(groups) < 2 or any(not k.tag and k.text.strip() for k in node.kids):
        return False
    first = (groups[0].tag, groups[0].marks)
    if groups[0].tag not in ("div", "section", "article", "li", "dd") or any((k.tag, k.marks) != first for k in groups):
        return False
    for g in groups:
        parts = [k for k in g.kids if k.tag and _weight(k)[0]]
        while len(parts) == 1 and parts[0].tag in ("div", "section", "article"):
            parts = [k for k in parts[0].kids if k.tag and _weight(k)[0]]
        if len(parts) < 2 or any(k.tag in HEADINGS or any(x.tag in HEADINGS for x in _below(k)) for k in parts):
            return False
        head = _SPACE.sub(" ", parts[0].content()).strip()
        if len(head) > SHORT_LINE or head[-1:] in ".!?:;…" or any(k.tag in ("table", "tr", "td") for k in parts):
            return False
    return True


def _main(node: Node) -> Node:
    """Where no wrapper tells: article or main if there is one with text, else down the elements that hold nearly all running text."""
    best, most = None, 0
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag and not _furniture(x):
            if x.tag in ("article", "main") or x.marks & {"article", "main"}:
                total, linked = _weight(x)
                if total - linked > most:
                    best, most = x, total - linked
            else:
                todo += x.kids
    if best is not None:
        if best.tag == "main" or "main" in best.marks:
            inner = [x for x in _below(best) if x.tag == "article"]
            if len(inner) == 1 and _weight(inner[0])[0] >= 0.5 * most:
                return inner[0]
        return best
    at = node
    while True:
        kids = [(k, *_weight(k)) for n, k in enumerate(at.kids) if k.tag and not _furniture(k) and not (any(_weight(x)[0] for x in at.kids[:n]) and replies(k))]
        total = sum(t - 2 * link for _, t, link in kids) + sum(len(k.text.strip()) for k in at.kids if not k.tag)
        inside = [(k, t - 2 * link) for k, t, link in kids if k.tag in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center")]
        best = max(inside, key=lambda x: x[1], default=(None, 0))
        if best[0] is None or best[1] < 0.7 * max(total, 1):
            return at
        at = best[0]


def _below(node: Node):
    for k in node.kids:
        if k.tag and not _furniture(k):
            yield k
            yield from _below(k)


def _blocks(node: Node, pages: int, out: list[str], held: list[str], top: bool = True) -> None:
    """Adds the text of each block to `out`; `held` is the block that is open."""

    def close() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    if not node.tag:
        held.append(node.text)
        return
    if node.tag in ("br", "wbr"):
        held.append(" " if node.tag == "br" else "")
        return
    if not top and _furniture(node):
        if node.tag in BLOCK:
            close()
        return
    if not top and node.tag == "header":
        close()
        for k in _below(node):
            if k.tag in HEADINGS:
                _blocks(k, pages, out, held, False)
        close()
        return
    if not top and node.slot is not None and (node.slot.constant(pages) or node.slot.menu(pages)):
        close()
        return
    block = node.tag in BLOCK
    if block:
        close()
    for k in node.kids:
        if k.tag in CONTAINERS and out and replies(k):
            close()
        else:
            _blocks(k, pages, out, held, False)
    if block:
        close()


def main_text(page: Node, wrapper: Wrapper | None = None) -> str:
    """The main text of a parsed page, by the wrapper that was learned from it and others."""
    out: list[str] = []
    held: list[str] = []
    (named, links), (all_text, all_links) = _weight(page), _weight(page, names=False)
    if named - links < LEFT * (all_text - all_links):
        _unnamed(page)
    top, decided = (page, False) if wrapper is None else wrapper.content_of(page)
    _blocks(top if decided else _main(top), 0 if wrapper is None else wrapper.pages, out, held)
    if held:
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: list[str | None], induce: bool = True) -> list[str]:
    """The main texts of pages of one host; without `induce` of each page alone."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
    trees: dict[str, Node] = {p: parse(p) for p in pages if p}
    wrapper = Wrapper() if induce else None
    if wrapper:
        for tree in trees.values():
            wrapper.learn(tree)
        for tree in trees.values():
            wrapper.measure(tree)
        wrapper.induce()
    texts = {p: main_text(tree, wrapper) for p, tree in trees.items()}
    return [texts[p] if p else "" for p in pages]


def html_extraction(pages: DataFrame) -> DataFrame:
    """Main text of whole pages.

    The pages of a host are one group, those of a host with 2 GROUP pages or more are
    dealt into groups of GROUP to 2 GROUP in the mean by a hash of the page, and groups
    are dealt by a hash of (host, group), so a hot host spreads over many tasks and a
    group stays whole whatever the number of tasks; a group of more than GROUP_CHARS of
    html is aligned in several runs of pages (of at least LEAST_PAGES, however long these are).
    In a group the DOM trees of the
    different pages are aligned by simple tree matching into a wrapper.  Slots whose
    text is the same in nearly all of at least LEAST_PAGES different pages are template
    and go; so do recurring slots of links; the content is the slot on whose way down
    nearly all varying running text lies.  Elements that HTML itself sets apart (nav,
    header, footer, aside, form, script, ...) and hidden ones go, and so do reader
    comments: groups of one shape after the content, each a short line and then text.
    An element whose class, id or role is nothing but words of furniture goes too,
    unless the page would then keep less than a tenth of its running text; a name that says more
    (related-work, with-sidebar) says nothing here.  Where too few pages of a host are
    at hand, article and main elements and the share of link text take the wrapper's place.

    Null and empty html gives an empty text; a null url is a host of its own; repeated
    rows are repeated pages; an empty table gives no rows.  Returns page_id, url, text,
    n_chars.  One shuffle of the pages, one pass over the urls before it,
    whose large hosts are broadcast; a task holds a batch and a group of pages.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    large = pages.groupBy(host.alias("host")).count().where(F.col("count") >= 2 * GROUP).select("host", F.floor(F.col("count") / GROUP).alias("parts"))
    rows = small_batches(pages).select("page_id", "url", "html").withColumn("host", host).withColumn("tie", F.xxhash64("page_id", "url"))
    rows = rows.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod("tie", F.coalesce("parts", F.lit(1))))
    tasks = max(1, min(MOST_TASKS, -(-pages.count() // TASK)))
    dealt = rows.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "tie").select("page_id", "url", "html", "host", "part")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finished(n: int) -> pa.RecordBatch:
            some = held[:n]
            del held[:n]
            texts = extract([r[2] for r in some])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], id_type), pa.array([r[1] for r in some], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            id_type = batch.schema.field("page_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "part")), strict=True):
                if held and held[0][3:] != row[3:]:
                    yield finished(len(held))
                elif len(held) == 2 * GROUP:
                    yield finished(GROUP)
                elif len(held) >= LEAST_PAGES and sum(len(r[2] or "") for r in held) + len(row[2] or "") > GROUP_CHARS:
                    yield finished(len(held))
                held.append(row)
        if held:
            yield finished(len(held))

    return dealt.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
