"""Text blocks of an HTML page in reading order, each with its path of open elements."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Elements whose content is no text of the page.
RAW = ("script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "head", "select", "textarea",
       "button")
#: Of these, the ones that hold text up to their end tag whatever it looks like; a missing end tag takes the rest of the page.
SWALLOWING = frozenset("script style iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split())
#: An element that starts closes an open one of these, if no element of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, set()),
}
_P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())

#: A quote counts after an equals sign only.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]   # one entry for each open element: tag and the words of its class, id and role
    text: str
    linked: int             # characters inside links


def _entry(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    found = [value.strip("\"'") for _, value in _NAMES.findall(attributes)]
    return " ".join([tag, *found]) if found else tag


class Ends:
    """Where the elements of a page end whose content is left out."""

    def __init__(self, html: str):
        self.html = html
        self.last: dict[str, int] = {}   # start of the last end tag

    def after(self, tag: str, at: int) -> int | None:
        """The place after the end tag of an element whose start tag ends at ``at``; None without one."""
        if tag == "head":
            m = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(self.html, at)
            return m.end() if m else at
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in re.finditer(rf"</{tag}\s*>", self.html, re.I)), default=-1)
        if self.last[tag] < at:
            return len(self.html) if tag in SWALLOWING else None
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(self.html, at):
            if m[1]:
                depth -= 1
            elif tag not in SWALLOWING and not m[0].endswith("/>"):
                depth += 1
            if depth == 0:
                return m.end()
        # an inner element of this kind is not closed: the first end tag closes this one
        return re.compile(rf"</{tag}\s*>", re.I).search(self.html, at).end()


def blocks_of(html: str | None) -> list[Block]:
    """Blocks with text: runs of text between starts and ends of elements that are not inline.

    Character references are decoded, white space is one space and trimmed at the ends.  Comments, declarations and the
    content of ``RAW`` elements are left out, elements of the same kind inside them included; what is not closed is closed by
    its parent or the end of the page, and of a ``RAW`` element without end tag only the tag is left out, unless it is
    ``SWALLOWING``.
    """
    out: list[Block] = []
    if not html:
        return out
    ends = Ends(html)
    stack: list[str] = []       # tags
    path: list[str] = []        # entries
    parts: list[str] = []
    linked = depth = 0          # depth: open links

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(path), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal depth
        if any(t not in INLINE for t in stack[to:]):
            flush()
        depth -= stack[to:].count("a")
        del stack[to:], path[to:]

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            text = unescape(html[at:end])
            parts.append(text)
            if depth > 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if tag not in INLINE and tag != "button":
                flush()
            if m[3].endswith("/"):
                continue
            at = ends.after(tag, at) or at
            continue
        if tag in VOID or m[3].endswith("/"):
            if tag not in INLINE:
                flush()
            continue
        if tag in _P_CLOSERS and "p" in stack:
            close(len(stack) - 1 - stack[::-1].index("p"))
        if tag in CLOSES:
            closed, fence = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in fence:
                    break
                if stack[i] in closed:
                    close(i)
                    break
        if tag not in INLINE:
            flush()
        stack.append(tag)
        path.append(_entry(tag, m[3]))
        depth += tag == "a"
    flush()
    return out
