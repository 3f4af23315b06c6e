"""Markdown to HTML (operator H11): a documented subset, or an injected renderer.

The subset: ATX headings, paragraphs, unordered and ordered lists, fenced and
inline code, emphasis, strong, links, images, rules and block quotes.  For full
Markdown hand in a renderer, a function of one text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"\s{0,3}(?:([*+-])|(\d+)[.])\s+(.*)")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), r'<img alt="\1" src="\2" />'),
    (re.compile(r"\[([^\]]*)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"<strong>\2</strong>"),
    (re.compile(r"(\*|_)(?=\S)(.+?)(?<=\S)\1"), r"<em>\2</em>"),
)


def _inline(text: str) -> str:
    parts = text.split("`")
    if len(parts) % 2 == 0:  # an open back-tick is plain text
        parts[-2:] = ["`".join(parts[-2:])]
    out = []
    for i, part in enumerate(parts):
        part = html.escape(part, quote=False)
        if i % 2:
            part = f"<code>{part}</code>"
        else:
            for pattern, by in _INLINE:
                part = pattern.sub(by, part)
        out.append(part)
    return "".join(out)


def render(text: str | None) -> str | None:
    """HTML of a Markdown text; null stays null."""
    if text is None:
        return None
    out: list[str] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : end]), quote=False) + "\n</code></pre>")
            i = end + 1
        elif m := _HEADING.match(line):
            n = len(m[1])
            out.append(f"<h{n}>{_inline(m[2])}</h{n}>")
            i += 1
        elif re.fullmatch(r"\s{0,3}([*_-])(\s*\1){2,}\s*", line):
            out.append("<hr />")
            i += 1
        elif m := _ITEM.match(line):
            tag, items = "ul" if m[1] else "ol", []
            while i < len(lines) and (m := _ITEM.match(lines[i])) and (tag == "ul") == bool(m[1]):
                items.append(f"<li>{_inline(m[3])}</li>")
                i += 1
            out.append(f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>")
        elif line.lstrip().startswith(">"):
            quoted = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                quoted.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            out.append("<blockquote>\n" + (render("\n".join(quoted)) or "") + "\n</blockquote>")
        else:
            body = []
            while i < len(lines) and lines[i].strip() and not lines[i].startswith("```") and not _HEADING.match(lines[i]) and not _ITEM.match(lines[i]):
                body.append(lines[i].strip())
                i += 1
            out.append("<p>" + _inline("\n".join(body)) + "</p>")
    return "\n".join(out)


def to_html(content: Column, renderer: Callable[[str | None], str | None] = render) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([renderer(t) for t in texts.to_pylist()], pa.string())

    return run(content)
