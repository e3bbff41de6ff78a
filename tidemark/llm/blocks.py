"""HTML to leaf blocks: the text between block-level tags, each with the path of elements around it.

One pass over a page, in time linear in its length: unclosed, crossed and stray tags are allowed, and a path is a
node of a tree shared by all blocks, so deep nesting costs nothing per block. What lies ahead is looked for once: the
next ">", whether an opaque element has an end, and the place of a quote without a partner. A tag that meets such a
quote, and each that starts before it from then on, ends at its first ">". Without a ">" ahead a "<" is text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements whose content is never text of the page.
OPAQUE = frozenset("script style noscript template iframe title textarea svg math object xmp button select datalist canvas audio video".split())
#: Opaque elements that end a block; the others stand within a line of text.
ENDING = frozenset("title textarea xmp".split())
#: Elements without content.
EMPTY = frozenset("area base col embed hr input link meta param source track".split())
#: An opening tag of the key ends an open element of the values.
_ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_COMMENT_END = re.compile("--!?>")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Blocks of a page in order, and the path nodes they point to; node 0 is the root and its own parent."""

    parent: list[int] = field(default_factory=lambda: [0])
    marks: list[list[str]] = field(default_factory=lambda: [[]])
    leaf: list[str] = field(default_factory=lambda: ["root"])
    text: list[str] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)


def _marks(tag: str, attributes: str) -> list[str]:
    """What an element says about itself: its name, and the words of its class, id and role."""
    found = [tag]
    if attributes:
        for match in _NAMED.finditer(attributes):
            value = match[2] or match[3] or match[4] or ""
            found += [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in _PART.findall(value.lower())]
    return list(dict.fromkeys(found))


def parse(source: str | None) -> Page:
    """Blocks with at least one visible character; references decoded, white space runs made one space, trimmed."""
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int]] = [("", 0)]
    count: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    links, at, end = 0, 0, len(source)
    gt, loose = -1, 0
    missing: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join("".join(html.unescape(p) for p, _ in parts).split())  # a reference lies in one piece
            if text:
                size = sum(len(p) for p, _ in parts)
                page.text.append(text)
                page.node.append(stack[-1][1])
                page.linked.append(sum(len(p) for p, inside in parts if inside) / size)
            parts.clear()

    def close(tag: str) -> None:
        while True:
            name, _ = stack.pop()
            count[name] -= 1
            if name == tag:
                return

    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append((source[at:lt], links > 0))
        if lt == end:
            break
        if source.startswith("<!--", lt):
            stop = _COMMENT_END.search(source, lt + 2)  # "<!-->" is a whole comment
            at = stop.end() if stop else end
            continue
        if gt < lt:
            gt = source.find(">", lt)
            if gt < 0:
                gt = end
        if source[lt + 1 : lt + 2] in ("!", "?"):
            at = min(gt + 1, end)
            continue
        match = _NAME.match(source, lt) if gt < end else None
        if match is None:
            parts.append(("<", links > 0))
            at = lt + 1
            continue
        stop = gt
        if lt >= loose:
            stop = _ATTRIBUTES.match(source, match.end()).end()
            if source[stop : stop + 1] != ">":
                loose, stop = stop, gt
        closing, tag, attributes = match[1], match[2].lower(), source[match.end() : stop]
        at = stop + 1
        if tag in OPAQUE and not closing:
            if tag in ENDING:
                flush()
            if not attributes.endswith("/"):
                gone = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at) if tag not in missing else None
                stop = source.find(">", gone.end()) if gone else -1
                if stop >= 0:
                    at = stop + 1
                elif tag in ("script", "style", "textarea", "title", "xmp"):
                    at = end
                else:
                    missing.add(tag)
        elif tag in INLINE:
            if tag == "br":
                parts.append((" ", links > 0))
            elif tag == "a":
                links = 0 if closing else 1
        elif closing:
            flush()
            links = 0
            if count.get(tag):
                close(tag)
        else:
            flush()
            links = 0
            if tag in EMPTY:
                continue
            for other in _ENDS.get(tag, ("p",)):
                if stack[-1][0] == other:
                    close(other)
            page.parent.append(stack[-1][1])
            page.marks.append(_marks(tag, attributes))
            page.leaf.append(tag)
            stack.append((tag, len(page.parent) - 1))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return page
