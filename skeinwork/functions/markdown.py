"""A small Markdown compiler: blocks (headings, lists, quotes, fences, rules, paragraphs) and inline marks."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INLINE = re.compile(r"`([^`]+)`|\*\*(.+?)\*\*|\*(.+?)\*|!\[([^\]]*)\]\(([^)\s]+)\)|\[([^\]]+)\]\(([^)\s]+)\)")


def inline(text: str) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()]))
        code, strong, em, alt, src, label, href = m.groups()
        if code is not None:
            out.append(f"<code>{html.escape(code)}</code>")
        elif strong is not None:
            out.append(f"<strong>{inline(strong)}</strong>")
        elif em is not None:
            out.append(f"<em>{inline(em)}</em>")
        elif src is not None:
            out.append(f'<img src="{html.escape(src)}" alt="{html.escape(alt)}">')
        else:
            out.append(f'<a href="{html.escape(href)}">{inline(label)}</a>')
        at = m.end()
    return "".join([*out, html.escape(text[at:])])


def blocks(source: str) -> list[tuple[str, list[str]]]:
    """(kind, lines) of each block."""
    out: list[tuple[str, list[str]]] = []
    fence = False
    for line in source.splitlines():
        kind = "p"
        if line.startswith("```"):
            fence = not fence
            if fence:
                out.append(("pre", []))
            continue
        if fence:
            out[-1][1].append(line)
            continue
        if not line.strip():
            out.append(("", []))
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append((f"h{len(m[1])}", [m[2]]))
            continue
        if re.fullmatch(r"\s*(?:-{3,}|\*{3,})\s*", line):
            out.append(("hr", []))
            continue
        for name, pattern in (("ul", r"\s*[-*+]\s+(.*)"), ("ol", r"\s*\d+[.)]\s+(.*)"), ("blockquote", r">\s?(.*)")):
            if m := re.match(pattern, line):
                kind, line = name, m[1]
                break
        if out and out[-1][0] == kind:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return [b for b in out if b[0]]


def compile_markdown(source: str) -> str:
    shown = []
    for kind, lines in blocks(source):
        if kind in ("ul", "ol"):
            shown.append(f"<{kind}>" + "".join(f"<li>{inline(x)}</li>" for x in lines) + f"</{kind}>")
        elif kind == "pre":
            shown.append("<pre><code>" + html.escape("\n".join(lines)) + "</code></pre>")
        elif kind == "hr":
            shown.append("<hr>")
        else:
            shown.append(f"<{kind}>{inline(' '.join(lines))}</{kind}>")
    return "\n".join(shown)


def to_html(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else compile_markdown(x))

    return run(source)
