"""HTML into leaf blocks: each block's text with the tags and class words of the elements around it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""")
_PLAIN = re.compile(r"([^>]*)>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg math iframe object noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "body": {"head"}}
SCOPE = frozenset("ul ol table div article section aside main header footer nav form body html blockquote dl select".split())


class Node:
    """An element other than an inline one, with its class words and the element around it; what is worked out for it is kept."""

    __slots__ = ("known", "names", "near", "parent", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.near = words or (parent.near if parent else ())
        self.names: frozenset[str] | None = None
        self.known: tuple | None = None


class Block(NamedTuple):
    text: str
    context: Node | None
    linked: int


def _words(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    found = [a or b or c for _, a, b, c in _ATTR.findall(attributes)]
    return tuple(dict.fromkeys(w.lower() for x in found for w in _WORD.findall(x)))


class _Stack:
    """Open elements; where each kind of them stands is kept, so that no search goes through them."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[Node | None] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        around = self.top()
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(around if tag in INLINE else Node(tag, words, around))

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def close(self, names: frozenset | set, everywhere: bool = False) -> None:
        """Close the innermost element of these names and all in it, unless another scope began since."""
        found = max((self.at[t][-1] for t in names if self.at.get(t)), default=-1)
        if found >= 0 and (everywhere or not self.scopes or found >= self.scopes[-1]):
            self.cut(found)


def leaf_blocks(page: str) -> list[Block]:
    """The page's text blocks in order; text is unescaped, with white space runs as one space. Comments, scripts and styles hold no text.

    The time taken follows the page's length, whatever is nested, unclosed or unbalanced in it.
    """
    stack, out, parts = _Stack(), [], []
    linked, links, context = 0, 0, None

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, context, linked))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal context, linked
        piece = html.unescape(piece)
        if not parts:
            context = stack.top()
        parts.append(piece)
        if links:
            linked += len(piece)

    at, begun, end = 0, 0, len(page)
    last, rest = page.rfind(">"), _REST
    while at < end:
        m = _OPEN.search(page, at)
        if not m or m.start() > last and not m[1]:  # no tag ends any more
            break
        if m[1]:
            close_at = page.find("-->", m.end())
            done = close_at + 3 if close_at >= 0 else end
        else:
            tail = (_PLAIN if m[2] else rest).match(page, m.end())
            if not tail and rest is _REST:  # a quote that is never closed: quotes mean nothing from here on
                rest = _PLAIN
                tail = rest.match(page, m.end())
            if not tail:
                break
            done = tail.end()
        if m.start() > begun:
            add(page[begun : m.start()])
        at = begun = done
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                stack.close({tag})
                continue
            flush()
            stack.close({tag}, everywhere=True)
            continue
        if tag in RAW:
            close_at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = begun = close_at.end() if close_at else end
            if tag not in ("script", "style", "template"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if tag not in VOID:
                stack.push(tag, ())
            continue
        flush()
        links = 0
        if stack.at.get("p") and tag not in VOID:
            stack.close({"p"})
        if tag in CLOSES:
            stack.close(CLOSES[tag])
        while stack.tags and stack.tags[-1] in INLINE:  # a block ends unclosed inline elements
            stack.cut(len(stack.tags) - 1)
        if tag not in VOID and not tail[1].endswith("/"):
            stack.push(tag, _words(tail[1]))
    if begun < end:
        add(page[begun:])
    flush()
    return out
