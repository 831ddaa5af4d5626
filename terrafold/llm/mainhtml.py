"""Main text of web pages by tree scoring.

A tolerant parser makes a tree of block elements and, in page order, blocks of text that lie directly in one
of them. Every block passes points to its container and on to a few ancestors, halved at the second step and a third
and less further up: one point, one for each comma and up to three for length. A container's points are
discounted by its share of text in links; a factor takes off most points of text in parts that are named like page
furniture (sidebar, comments, advert, menu and so on). The container with the best score is widened to its parents while what these add
is not mostly links. Inside it, parts with furniture's names stay only if their discounted score is near the best, and
lists and boxes of mostly linked lines go. Of its siblings those that score near it stay, and those with a paragraph's
worth of unlinked text. Elements that HTML itself sets apart (nav, aside, footer, a page's header, form and the like) are
never text of an article; an article inside one of the softer ones is.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by a
newline. A br is white space inside its block.

Cases: a null or empty page, and one without text outside furniture, gives an empty text; a tag that the end
of the page cuts off is dropped; a tag whose quotes don't close ends at its first >; repeated rows are judged each by
itself; very long pages and deep trees take time in proportion to their length; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import ship

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCKS - {"body", "head", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag that ends an open element of these, up to the fences.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"ul", "ol", "dl", "table", "body", "div", "article", "section", "main", "blockquote"}
#: Never text of an article; an article inside one of the soft ones escapes.
_HARD_TAGS = {"head", "aside", "form", "dialog", "button", "select", "svg", "object", "canvas", "template", "math", "menu"}
_SOFT_TAGS = {"nav", "footer", "header"}
_HARD_NAMES = set("sidebar aside comment comments commentlist respond reply replies disqus discussion related recommended recommendations hidden".split())
_SOFT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social widget pagination pager toolbar search skip".split()
)
_ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 2, "search": 2, "dialog": 2, "alertdialog": 2, "alert": 1, "menu": 1, "menubar": 1}
#: What names take off the points of what is in them, levels that points go up, the share of links that makes a list or box one of
#: links, with how many linked lines, and the share of the best score that parts with such names need.
_NAMED, LEVELS, LINKED, LINES, NEAR = {1: 0.35, 2: 0.2}, 6, 0.5, 3, 0.5
_LISTS = {"ul", "ol", "dl", "div", "section", "table", "tbody", "tr", "td", "menu", "details"}
_ALONE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt"}
_START = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}
_WORD = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "parent", "out", "factor", "named", "points", "chars", "linked", "lines", "inner")

    def __init__(self, tag: str, parent: _Node | None, out: int, named: int) -> None:
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.factor = (parent.factor if parent else 1.0) * _NAMED.get(named, 1.0)
        self.points, self.chars, self.linked, self.lines = 0.0, 0, 0, 0
        self.inner = parent is not None and (parent.inner or parent.tag == "article")

    def share(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def score(self) -> float:
        return self.points * (1 - self.share())


def _furniture(tag: str, attrs: str, parent: _Node) -> tuple[int, int]:
    """What an element is by its kind (0: content, 1: soft furniture, 2: hard furniture) and by its names (the same)."""
    kind = 2 if tag in _HARD_TAGS else 1 if tag in _SOFT_TAGS and not (tag == "header" and (parent.inner or parent.tag == "article")) else 0
    named = 0
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name = (m[1] or m[5]).lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                words = set(_WORD.findall(value))
                named = max(named, 2 if words & _HARD_NAMES else 1 if words & _SOFT_NAMES else 0)
            elif name == "role":
                kind = max(kind, _ROLES.get(value.strip(), 0))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                kind = 2
    return kind, named


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name, whether it ends an element, attributes), in order; the last has no name. Feed back a place to go on from."""
    pos, end = 0, len(page)
    spare = 16 * end  # characters that may be looked through for quotes in vain
    last = {q: page.rfind(q) for q in "\"'"}

    def close(at: int) -> int:
        """Where the tag ends whose name ends at at; -1 if it doesn't."""
        nonlocal spare
        k = at
        while spare > 0:
            m = _QUOTE.search(page, k)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            if last[m[0]] <= m.start():  # no such quote follows
                break
            k = page.index(m[0], m.end()) + 1
        spare -= k - at
        return page.find(">", at)

    begin = 0
    while (at := page.find("<", pos)) >= 0:
        mark = page[at + 1 : at + 2]
        ends = mark == "/"
        m = _NAME.match(page, at + 1 + ends)
        if m:
            stop = close(m.end())
            if stop < 0:
                break
            go = yield page[begin:at], m[0].lower(), ends, page[m.end() : stop]
            pos = begin = stop + 1 if go is None else go(stop + 1)
        elif mark in ("!", "?", "/") and mark:
            comment = page.startswith("<!--", at)
            stop = page.find("-->" if comment else ">", at + 4 if comment else at)
            if begin < at:
                yield page[begin:at], "", False, ""
            begin = pos = end if stop < 0 else stop + (3 if comment else 1)
        else:
            pos = at + 1
    yield page[begin : at if at >= 0 else end], "", False, ""


def _blocks(page: str) -> tuple[list[_Node], list[tuple[str, _Node, int]]]:
    """All nodes, parents first, and (text, container, characters in links) of each block outside furniture, in page order."""
    root = _Node("#root", None, 0, 0)
    nodes = [root]
    stack: list[tuple[str, _Node]] = [("#root", root)]  # inline elements have their container's node
    tall = [0]  # where the blocks are in the stack
    open_: Counter[str] = Counter()
    found: list[tuple[str, _Node, int]] = []
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            node = stack[-1][1]
            if not node.out:
                text = " ".join(_html.unescape("".join(parts)).split())
                if text:
                    found.append((text, node, len(" ".join(_html.unescape("".join(linked)).split())) if linked else 0))
            parts.clear()
            linked.clear()

    def pop(k: int) -> None:
        flush()
        for tag, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]
        while tall[-1] >= k:
            tall.pop()

    def push(tag: str, attrs: str, block: bool) -> None:
        node = stack[-1][1]
        if block or attrs or tag in _HARD_TAGS:
            kind, named = _furniture(tag, attrs, node)
            if block or kind > node.out or named:
                flush()  # an inline element that is furniture has its text for itself
                out = 0 if tag in ("article", "main") and node.out == 1 and not kind else max(node.out, kind)
                node = _Node(tag, node, out, named)
                nodes.append(node)
        if block:
            tall.append(len(stack))
        stack.append((tag, node))
        open_[tag] += 1

    tags = _tags(page)
    go = None
    while True:
        try:
            text, tag, ends, attrs = tags.send(go)
        except StopIteration:
            break
        go = None
        if text:
            parts.append(text)
            if open_["a"] > 0:
                linked.append(text)
        if not tag:
            continue
        if ends:
            if open_[tag] > 0:
                floor = 0 if tag in _BLOCKS else tall[-1]
                for k in range(len(stack) - 1, floor, -1):
                    if stack[k][0] == tag:
                        if tag in _BLOCKS:
                            pop(k)
                        else:
                            if stack[k][1] is not stack[k - 1][1]:
                                flush()
                            open_[tag] -= 1
                            del stack[k]
                        break
        elif tag in _RAW:
            go = lambda at, tag=tag: m.start() if (m := _RAW_END[tag].search(page, at)) else len(page)
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            if tag in _ENDS_P and stack[tall[-1]][0] == "p":
                pop(tall[-1])
            for k in reversed(tall) if tag in _CLOSES else ():
                if stack[k][0] in _CLOSES[tag]:
                    pop(k)
                    break
                if stack[k][0] in _FENCE:
                    break
            flush()
            if tag not in _VOID:
                push(tag, attrs, True)
        elif tag not in _VOID and not attrs.endswith("/"):
            push(tag, attrs, False)
    flush()
    return nodes, found


def extract(page: str | None) -> str:
    """The main text."""
    nodes, found = _blocks(page) if page else ([], [])
    if not found:
        return ""
    for text, node, linked in found:
        node.chars += len(text)
        node.linked += linked
        node.lines += 2 * linked > len(text)
        own = node.parent if node.tag in _ALONE and node.parent else node
        points = (1 + text.count(",") + min(len(text) / 100, 3.0) if len(text) >= 25 else 0.25) * node.factor
        for step in range(LEVELS):
            if own is None:
                break
            if not own.points:
                own.points = _START.get(own.tag, 0.0) * own.factor
            own.points += points / (1 if step == 0 else 2 if step == 1 else 3 * step)
            own = own.parent
    plain: dict[_Node, list[int]] = {}  # characters, and those in links, outside parts with furniture's names
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.lines += node.lines
    for node in nodes:
        if node.parent is not None and not node.named:
            own = plain.setdefault(node.parent, [0, 0])
            own[0] += node.chars
            own[1] += node.linked
    best = max((n for n in nodes if n.points and not n.out), key=_Node.score)
    goal = best.score()
    top = best
    while (up := top.parent) is not None and up.tag not in ("body", "html", "#root"):
        chars, linked = plain.get(up, [0, 0])
        if not top.named:
            chars, linked = chars - top.chars, linked - top.linked
        if chars and linked > LINKED * chars:
            break
        top = up
    stays = {}
    for node in nodes:
        if node is top:
            stays[node] = True
        elif node.parent is None:
            stays[node] = False
        elif stays[node.parent]:
            links = node.tag in _LISTS and node.lines >= LINES and node.share() > LINKED
            stays[node] = not links and (not node.named or node.score() >= NEAR * goal or _above(best, node))
        elif node.parent is top.parent:
            alone = node.tag == "p" and not node.named and node.chars > 80 and node.share() < 0.25
            stays[node] = alone or node.score() >= max(10.0, 0.2 * goal)
        else:
            stays[node] = False
    return "\n".join(text for text, node, _ in found if stays[node])


def _above(node: _Node | None, other: _Node) -> bool:
    """Whether other is node or an ancestor of it."""
    while node is not None and node is not other:
        node = node.parent
    return node is not None


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            texts = [extract(h.as_py()) for h in rb.column(2)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
