"""Visible text of web pages, laid out: a tree builder with implied tags, visibility rules, then blocks, lists and tables as lines.

The tree is that of a lenient HTML parser: html, head, body, tbody and tr are put in where they are left out, paragraphs,
list items, cells and options end where the next begins, and unknown end tags are ignored. Both passes use stacks of their own;
elements nested more than ``MOST_DEPTH`` deep become siblings, as in browsers, which bounds the work at every tag.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.shared import arrow_batches, table

#: A comment; a tag whose quotes hold no angle bracket; the beginning of any other tag; what begins like markup and is none.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*+>?""", re.S)
_SPECIAL = re.compile(r"""[>"']""")
_DROPPED = re.compile(r"<[!?/]")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UGLY = re.compile(r"[\t\n\r\f]|  ")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

MOST_DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta title style script".split())
HIDDEN = frozenset("head script style template title datalist noembed noframes iframe object audio video canvas svg math source track param area base link meta col colgroup".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption button template".split())
#: Elements that begin and end a line, and the blank lines around them.
BLOCKS = dict.fromkeys(CLOSES_P | frozenset("body html li dt dd tr td th caption legend option optgroup select textarea tbody thead tfoot".split()), 0) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre xmp figure fieldset hr article section".split(), 1)
LISTS = frozenset("ul ol menu dir".split())


class Node:
    __slots__ = ("tag", "raw", "children", "_attrs")

    def __init__(self, tag: str, raw: str = "") -> None:
        self.tag, self.raw, self.children, self._attrs = tag, raw, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for name, a, b, c in _ATTR.findall(self.raw) if self.raw else ():
                self._attrs.setdefault(name.lower(), _html.unescape(a or b or c))
        return self._attrs


def _close(stack: list[Node], tags: frozenset, stop: frozenset) -> None:
    """Ends the nearest open element of ``tags``, and all in it, unless one of ``stop`` comes first."""
    for k in range(len(stack) - 1, 0, -1):
        tag = stack[k].tag
        if tag in tags:
            del stack[k:]
            return
        if tag in stop:
            return


_P, _LI, _DD, _A, _OPTION = (frozenset(x.split()) for x in ("p", "li", "dt dd", "a", "option"))
_LI_STOP, _DD_STOP, _TABLE = LISTS | SCOPE, frozenset({"dl"}) | SCOPE, frozenset({"table", "template"})
_CELL, _ROW, _BODY = frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"})


def tag_ends(source: str):
    """A function that gives, for a place in a tag, that of its ">": the first outside quotes, or the first at all if a quote is not closed; -1 without any.

    What follows a quote is the same for all tags that come to it, and is remembered: a page takes linear time, whatever its quotes.
    """
    known: dict[int, int] = {}

    def end_of(at: int) -> int:
        begin, passed = at, []
        while True:
            m = _SPECIAL.search(source, at)
            if m is None or m[0] == ">":
                end = m.start() if m else -1
                break
            if m.start() in known:
                end = known[m.start()]
                break
            passed.append(m.start())
            close = source.find(m[0], m.end())
            if close < 0:
                end = -1
                break
            at = close + 1
        for p in passed:
            known[p] = end
        return end if end >= 0 else source.find(">", begin)

    return end_of


def parse(source: str) -> Node:
    """The tree of an HTML text; its root is the html element. Text nodes are strings."""
    root = Node("html")
    stack = [root]
    head_done = False
    at = 0
    end = len(source)

    def body() -> None:
        nonlocal head_done
        if not head_done:
            head_done = True
            del stack[1:]
            node = Node("body")
            root.children.append(node)
            stack.append(node)

    def push(node: Node, keep: bool = True) -> None:
        if len(stack) >= MOST_DEPTH:
            stack.pop()
        stack[-1].children.append(node)
        if keep:
            stack.append(node)

    def text(s: str) -> None:
        if not head_done:
            if not s.strip(" \t\n\r\f"):
                return
            body()
        if "&" in s:
            s = _html.unescape(s)
        stack[-1].children.append(s)

    last, end_of = source.rfind(">"), tag_ends(source)
    while at < end:
        if at > last:  # no tag ends any more
            m = _DROPPED.search(source, at)
            if (stop := m.start() if m else end) > at:
                text(source[at:stop])
            break
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        raw = m[3]
        if m[5]:
            stop = end_of(at)
            if stop < 0:  # no tag: its first character is text, and so is the rest
                text(source[m.start()])
                at = m.start() + 1
                continue
            raw, at = source[at:stop], stop + 1
        tag = tag.lower()
        closing = m[1] or m[4]
        if closing:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                del stack[1:]
                continue
            if tag in ("p", "br"):
                if tag == "br" or not any(n.tag == "p" for n in stack):
                    body()
                    push(Node(tag), False)
                    continue
                _close(stack, _P, SCOPE)
                continue
            _close(stack, HEADINGS if tag in HEADINGS else frozenset({tag}), frozenset() if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "template", "button") else SCOPE)
            continue
        node = Node(tag, raw)
        if tag == "html":
            root.raw = root.raw or raw
            continue
        if tag == "head":
            if not head_done and len(stack) == 1:
                push(node)
            continue
        if tag == "body":
            if head_done:
                continue
            body()
            stack[-1].raw = raw
            continue
        if not head_done:
            if tag in HEAD or tag in ("noscript", "template"):
                if len(stack) == 1:
                    push(Node("head"))
            else:
                body()
        if tag in CLOSES_P:
            _close(stack, _P, SCOPE)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
        elif tag == "li":
            _close(stack, _LI, _LI_STOP)
            _close(stack, _P, SCOPE | LISTS)
        elif tag in _DD:
            _close(stack, _DD, _DD_STOP)
        elif tag in ("option", "optgroup"):
            _close(stack, _OPTION if tag == "option" else frozenset({"optgroup"}), frozenset({"select"}) | SCOPE)
        elif tag == "a":
            _close(stack, _A, SCOPE)
        elif tag in _CELL or tag == "tr" or tag in _BODY:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), 0)
            if not depth:
                continue  # outside a table these tags say nothing
            _close(stack, _CELL, _TABLE)
            if tag in _CELL:
                if stack[-1].tag != "tr":
                    if stack[-1].tag not in ("tbody", "thead", "tfoot"):
                        del stack[depth + 1 :]
                        push(Node("tbody"))
                    push(Node("tr"))
            else:
                _close(stack, _ROW, _TABLE)
                if tag == "tr":
                    if stack[-1].tag not in ("tbody", "thead", "tfoot"):
                        del stack[depth + 1 :]
                        push(Node("tbody"))
                else:
                    del stack[depth + 1 :]
        if tag in RAW:
            push(node, False)
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            inner = source[at : m.start() if m else end]
            node.children.append(_html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = m.end() if m else end
        else:
            push(node, tag not in VOID)
    if not head_done:
        body()
    return root


def hidden_selectors(root: Node) -> frozenset[str]:
    """The simple selectors (tag, .class, #id) that the page's style elements make invisible."""
    out = set()
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "style" and n.children and _GONE.search(n.children[0]):
            for selectors, rule in _RULE.findall(n.children[0]):
                if _GONE.search(rule):
                    out |= {s.strip().lower() for s in selectors.split(",") if re.fullmatch(r"\s*[.#]?[\w-]+\s*", s)}
        todo.extend(c for c in n.children if c.__class__ is Node)
    return frozenset(out)


def visible(node: Node, rules: frozenset[str]) -> bool:
    tag = node.tag
    if tag in HIDDEN or tag in rules:
        return False
    if not node.raw:
        return tag != "dialog"
    a = node.attrs
    if "hidden" in a or tag == "dialog" and "open" not in a or "style" in a and _GONE.search(a["style"]):
        return False
    if tag == "input":
        return a.get("type", "").lower() != "hidden"
    if rules and ("class" in a or "id" in a):
        return not any("." + c in rules for c in a.get("class", "").lower().split()) and "#" + a.get("id", "").lower() not in rules
    return True


class Lines:
    """Lines under way: white space collapses, blank lines come between blocks, markers begin items."""

    __slots__ = ("out", "line", "space", "blank", "indent", "marker")

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0
        self.indent: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if self.out and self.blank:
            self.out.append("")
        self.blank = 0
        pad = "".join(self.indent)
        if self.marker:
            pad = pad[: len(pad) - len(self.marker)] + self.marker
            self.marker = ""
        self.line.append(pad)

    def add(self, s: str) -> None:
        if _UGLY.search(s):
            s = _SPACE.sub(" ", s)
        if s[0] == " ":
            s = s[1:]
            self.space = bool(self.line)
        if not s:
            return
        if not self.line:
            self._begin()
        elif self.space:
            self.line.append(" ")
        self.space = s[-1] == " "
        self.line.append(s[:-1] if self.space else s)

    def raw(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.end() if self.line else self.out.append("")
            if part:
                if not self.line:
                    self._begin()
                self.line.append(part)

    def end(self, blank: int = 0) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        if blank and self.out:
            self.blank = 1

    def whole(self, line: str) -> None:
        self._begin()
        self.line.append(line)
        self.end()

    def lines(self) -> list[str]:
        self.end()
        return self.out


def _number(s: str | None, least: int, most: int) -> int:
    return min(most, max(least, int(s))) if s and re.fullmatch(r"\d{1,9}", s.strip()) else least


def grid(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Aligned lines of a table of (colspan, rowspan, lines) cells; columns are two blanks apart."""
    at: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        placed, c = [], 0
        for span, down, lines in row:
            while taken.get(c, 0):
                c += 1
            placed.append((c, span, lines))
            if down > 1:
                for k in range(c, c + span):
                    taken[k] = down
            c += span
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        at.append(placed)
    width: dict[int, int] = {}
    for placed in at:
        for c, span, lines in placed:
            if span == 1:
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
    for placed in at:
        for c, span, lines in placed:
            if span > 1:
                own = sum(width.get(k, 0) for k in range(c, c + span)) + 2 * (span - 1)
                if (need := max(map(len, lines), default=0)) > own:
                    width[c + span - 1] = width.get(c + span - 1, 0) + need - own
    n = max(width, default=-1) + 1
    start = [0] * (n + 1)
    for c in range(n):
        start[c + 1] = start[c] + width.get(c, 0) + (2 if width.get(c, 0) else 0)
    out = []
    for placed in at:
        for k in range(max((len(lines) for *_, lines in placed), default=0)):
            line = ""
            for c, _, lines in placed:
                if k < len(lines) and lines[k]:
                    line = line.ljust(start[min(c, n)]) + lines[k]
            out.append(line)
    return out


def render(root: Node) -> str:
    """The visible text, laid out."""
    rules = hidden_selectors(root)
    out = Lines()
    outer: list[Lines] = []
    tables: list[list] = []
    lists: list[list] = []
    pre = 0
    todo: list = [(root, 0)]
    while todo:
        node, k = todo.pop()
        if k == 0:
            tag = node.tag
            if not visible(node, rules):
                continue
            if tag == "br":
                if out.line:
                    out.end()
                elif out.out:
                    out.blank = 1
                continue
            if tag in BLOCKS:
                if tag in ("td", "th", "caption") and tables:
                    outer.append(out)
                    out = Lines()
                else:
                    out.end(BLOCKS[tag] if not (tag in LISTS and lists) else 0)
                if tag in LISTS:
                    lists.append([tag, _number(node.attrs.get("start"), 1, 10**9) if tag == "ol" and node.raw else 1])
                elif tag == "li":
                    marker = "- "
                    if lists and lists[-1][0] == "ol":
                        if node.raw and "value" in node.attrs:
                            lists[-1][1] = _number(node.attrs["value"], 1, 10**9)
                        marker = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    out.indent.append(" " * len(marker))
                    out.marker = marker
                elif tag in ("blockquote", "dd"):
                    out.indent.append("  ")
                elif tag in ("pre", "xmp", "textarea"):
                    pre += 1
                elif tag == "table":
                    tables.append([])
                elif tag == "tr" and tables:
                    tables[-1].append([])
            elif tag == "input" or tag == "img":
                if tag == "input" and node.attrs.get("value") and node.attrs.get("type", "").lower() in ("submit", "button", "reset", "text", ""):
                    out.add(node.attrs["value"])
                continue
            if tag == "details" and "open" not in node.attrs:
                node.children = [c for c in node.children if c.__class__ is Node and c.tag == "summary"][:1]
        children = node.children
        if k < len(children):
            stop = len(children)
            while k < stop:
                child = children[k]
                k += 1
                if child.__class__ is str:
                    if child:
                        if pre:
                            out.raw(child)
                        else:
                            out.add(child)
                else:
                    todo.append((node, k) if k < stop else (node, stop + 1))
                    todo.append((child, 0))
                    break
            else:
                todo.append((node, stop + 1))
            continue
        tag = node.tag
        if tag not in BLOCKS:
            continue
        if tag in ("td", "th", "caption") and outer:
            lines = out.lines()
            out = outer.pop()
            if tag == "caption":
                for line in lines:
                    out.whole(line)
            elif tables:
                if not tables[-1]:
                    tables[-1].append([])
                a = node.attrs if node.raw else {}
                tables[-1][-1].append((_number(a.get("colspan"), 1, 1000), _number(a.get("rowspan"), 1, 65534), lines))
            continue
        if tag == "table" and tables:
            for line in grid(tables.pop()):
                out.whole(line)
        elif tag == "li":
            out.end()
            if out.indent:
                out.indent.pop()
            out.marker = ""
        elif tag in LISTS and lists:
            lists.pop()
        elif tag in ("blockquote", "dd"):
            out.end()
            out.indent.pop()
        elif tag in ("pre", "xmp", "textarea"):
            pre -= 1
        out.end(BLOCKS[tag] if not (tag in LISTS and lists) else 0)
    return "\n".join(out.lines()).strip("\n")


def visible_text(source: str) -> str:
    return render(parse(source))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row: the page's visible text with its block spacing, lists and aligned tables.

    * A null page has null text; an empty one, or one with nothing visible, empty text. A null page_id stays null.
    * Repeated rows each give their row; an empty table gives none. Pages of any length and nesting are read whole.
    * Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in arrow_batches(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([None if s is None else visible_text(s) for s in sources], pa.string())], ["page_id", "text"])

    return pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[html_col].cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
