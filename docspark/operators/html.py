"""Text blocks of a web page in one linear scan (the part of X1 that works on one page)."""

from __future__ import annotations

import html
import re
from html.entities import html5

# Fixed values, after the HTML standard: elements that begin and end a block, that have no end tag, whose content is text
# only, and that are not shown; what may stand in a head.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HIDDEN = frozenset("head iframe noembed noframes script style template title".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What a start tag ends: open elements of these names, as far as the nearest of the others.
CELL = frozenset(("td", "th"))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table"))), "dd": (frozenset(("dd", "dt")), frozenset(("dl", "table"))), "dt": (frozenset(("dd", "dt")), frozenset(("dl", "table"))),
    "td": (CELL, frozenset(("table", "tr"))), "th": (CELL, frozenset(("table", "tr"))), "tr": (frozenset(("tr",)), frozenset(("table",))), "option": (frozenset(("option",)), frozenset(("select", "table"))),
    **{x: (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))) for x in ("thead", "tbody", "tfoot")},
}
PARAGRAPH = (frozenset(("p",)), frozenset(("table", "td", "th", "caption", "template")))
KINDS = {**{f"h{i}": "section_head" for i in range(1, 7)}, "li": "list_item", "table": "table", "figcaption": "figure_caption", "pre": "code"}
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_NAME = re.compile(r"[^\s/>=]+|=[^\s/>=]*")
_SPACE = re.compile(r"[\s/]*")
_EQUALS = re.compile(r"\s*=\s*")
_WORD = re.compile(r"[^\s>]*")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def closed_references(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Page:
    """Blocks (kind, text, link targets) of a page, found while it is read once from the left.

    A block is the text between two tags of block elements; a table is one block.
    Its kind is that of the innermost element that has one. Tags may be in either
    case, and end tags may be missing where the standard lets them be. Character
    references are decoded, those in attributes as well. Comments, the head,
    scripts, styles and templates are not shown and give no text; all else does.
    ``closed``: in text only references with their semicolon are decoded, else
    also the old ones without it, as the standard says.
    """

    def __init__(self, source: str, closed: bool = False):
        self.source, self.blocks = source, []
        self.decode = closed_references if closed else html.unescape
        self.stack: list[tuple[str, str]] = []  # open elements with the kind of the text in them
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.links: list[str] = []
        self.unclosed: set[str] = set()
        self.read()

    def flush(self) -> None:
        kind = self.stack[-1][1] if self.stack else "paragraph"
        text = "".join(self.text)
        text = "\n".join(x.rstrip() for x in text.strip("\r\n").splitlines()).strip() if kind == "code" else " ".join(text.split())
        self.text = []
        if text:
            self.blocks.append((kind, text, self.links))
            self.links = []

    def edge(self, outer: bool = False) -> None:
        """Text on both sides of a block element's tag is apart; inside a table it stays one block, up to the ``outer`` end."""
        if self.open.get("table") and not outer:
            self.text.append(" ")
        elif not self.hidden():
            self.flush()

    def push(self, name: str) -> None:
        above = self.stack[-1][1] if self.stack else "paragraph"
        self.stack.append((name, above if above == "table" else KINDS.get(name, above)))
        self.open[name] = self.open.get(name, 0) + 1

    def cut(self, names: frozenset, until: frozenset = frozenset()) -> None:
        """Close the nearest open element of ``names`` and all inside it, if none of ``until`` is nearer."""
        if not any(self.open.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                if self.open.get("table") and sum(n == "table" for n, _ in self.stack[i:]) == self.open["table"]:
                    self.flush()
                for n, _ in self.stack[i:]:
                    self.open[n] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in until:
                return

    def hidden(self) -> bool:
        return bool(self.open.get("head") or self.open.get("template"))

    def attributes(self, i: int) -> tuple[int, str | None]:
        """Where a tag ends, and its ``href``."""
        s, href = self.source, None
        while True:
            i = _SPACE.match(s, i).end()
            if i >= len(s):
                return i, href
            if s[i] == ">":
                return i + 1, href
            name = _NAME.match(s, i)
            i = name.end()
            equals = _EQUALS.match(s, i)
            if not equals:
                continue
            i = equals.end()
            quote = s[i : i + 1]
            end = s.find(quote, i + 1) if quote in ("'", '"') and quote not in self.unclosed else -1
            if end < 0:
                if quote in ("'", '"'):
                    self.unclosed.add(quote)  # there is none further on either
                end = _WORD.match(s, i).end()
                value, i = s[i:end], end
            else:
                value, i = s[i + 1 : end], end + 1
            if name[0].lower() == "href" and href is None:
                href = html.unescape(value)

    def start(self, name: str, href: str | None) -> None:
        if self.open.get("head") and name not in IN_HEAD:
            self.cut(frozenset(("head",)))
        if href is not None and name in ("a", "area") and not self.hidden():
            self.links.append(href)
        if name == "br":
            self.text.append("\n")
        elif name == "hr":
            self.edge()
        elif name in BLOCKS:
            self.edge()
            if name in ENDS:
                self.cut(*ENDS[name])
            if name not in ("option", "optgroup", "select", "html", "body"):
                self.cut(*PARAGRAPH)
            if KINDS.get(name) == "section_head" and self.stack and KINDS.get(self.stack[-1][0]) == "section_head":
                self.cut(frozenset((self.stack[-1][0],)))
            self.push(name)
        elif name in ("head", "template"):
            self.push(name)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.edge(name == "table" and self.open.get("table") == 1)
            self.cut(frozenset((name,)), frozenset(("template",)) if name in ("table", "body", "html") else frozenset(("table", "template")))
        elif name in ("head", "template"):
            self.cut(frozenset((name,)))
        elif name == "br":
            self.text.append("\n")

    def said(self, text: str) -> None:
        if self.open.get("head") and text.strip():
            self.cut(frozenset(("head",)))
        if not self.hidden():
            self.text.append(self.decode(text) if "&" in text else text)

    def read(self) -> None:
        s, i = self.source, 0
        while i < len(s):
            at = s.find("<", i)
            if at < 0:
                self.said(s[i:])
                break
            if at > i:
                self.said(s[i:at])
            i = at
            if s.startswith("<!--", i):
                end = s.find("-->", i + 2)
                i = len(s) if end < 0 else end + 3
            elif s.startswith(("<!", "<?"), i) or (s.startswith("</", i) and not s[i + 2 : i + 3].isalpha()):
                end = s.find(">", i)
                i = len(s) if end < 0 else end + 1
            elif tag := _TAG.match(s, i):
                name = tag[1].lower()
                i, href = self.attributes(tag.end())
                if s[at + 1] == "/":
                    self.end(name)
                    continue
                self.start(name, href)
                if name in RAW:
                    close = _END[name].search(s, i)
                    stop = close.start() if close else len(s)
                    if name not in HIDDEN:
                        self.said(s[i:stop])
                    i = stop
            else:
                self.said("<")
                i += 1
        self.flush()


def page_blocks(source: str | None, closed: bool = False) -> list[tuple[int, str, list[str], str, str | None, int]]:
    """(pos, kind, targets, text, head, div_index) of a page: a heading opens a division; ``head`` is the last one so far."""
    out, head, divisions = [], None, 0
    for pos, (kind, text, links) in enumerate(Page(source or "", closed).blocks):
        if kind == "section_head":
            head, divisions = text, divisions + 1
        out.append((pos, kind, links, text, head, max(divisions - 1, 0)))
    return out
