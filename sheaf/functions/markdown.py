"""HTML of one page as GitHub-flavoured markdown, for use inside tasks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# What is dropped, what stays HTML, what starts a paragraph of its own.
DROPPED = {"script", "style", "iframe", "noscript", "head", "template", "title"}
KEPT = {"math"}
BLOCKS = {
    "address", "article", "aside", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "header", "html", "main", "nav", "p", "section", "summary",
}
OTHER_BLOCKS = {"ul", "ol", "pre", "table", "hr", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAX_NESTING = 200

_ESCAPED = re.compile(r"([\\`*_\[\]~])|^(\s*)(#{1,6}|>|[-+])(?=\s)|^(\s*\d+)([.)])(?=\s)", re.M)


def _escape(text: str) -> str:
    return _ESCAPED.sub(
        lambda m: "\\" + m[1] if m[1] else (f"{m[2]}\\{m[3]}" if m[3] else f"{m[4]}\\{m[5]}"), text
    )


class _Node:
    __slots__ = ("tag", "attrs", "children", "plain")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.children, self.plain = tag, attrs, [], False


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name, and
    marks left open go on in the next text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.unclosed: dict[str, None] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in OTHER_BLOCKS:
            self._close({"p"}, {"li", "td", "th", "blockquote", "div", "article", "section"})
        elif tag == "li":
            self._close({"li"}, {"ul", "ol"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag not in DROPPED:
            self._resume()
        self._push(tag, dict(attrs))

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = _Node(tag, attrs)
        # A mark inside its own kind adds nothing.
        node.plain = tag in MARKS and any(MARKS.get(n.tag) == MARKS[tag] for n in self.open)
        self.open[-1].children.append(node)
        # Beyond this depth elements no longer nest, which keeps recursion bounded.
        if tag not in VOID and len(self.open) < MAX_NESTING:
            self.open.append(node)

    def _cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        self.unclosed.update((n.tag, None) for n in self.open[at + 1 :] if n.tag in MARKS)
        del self.open[at:]

    def _close(self, tags: set[str], limits: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                self._cut(at)
                return
            if self.open[at].tag in limits:
                return

    def _resume(self) -> None:
        marks, self.unclosed = self.unclosed, {}
        for tag in marks:
            self._push(tag, {})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        node = self.open[-1]
        if len(self.open) > 1 and node.tag == tag and not node.children:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.unclosed.pop(tag, None)
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._cut(at)
                return

    def handle_data(self, data: str) -> None:
        if self.unclosed and data.strip() and not any(n.tag in DROPPED for n in self.open):
            self._resume()
        self.open[-1].children.append(data)


def _plain(node: _Node) -> str:
    return "".join(c if isinstance(c, str) else ("\n" if c.tag == "br" else _plain(c)) for c in node.children)


def _html(node: _Node) -> str:
    attrs = "".join(f' {k}="{v or ""}"' for k, v in node.attrs.items())
    inner = "".join(c if isinstance(c, str) else _html(c) for c in node.children)
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def _inline(node: _Node) -> str:
    """Children that run in a line; blocks inside come a blank line apart."""
    out: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            text = re.sub(r"[ \t\r\n\f]+", " ", child)
            if out and out[-1].endswith((" ", "\n")):
                text = text.lstrip(" ")
            out.append(_escape(text))
        else:
            out.append(_element(child))
    return "".join(out)


def _block(text: str) -> str:
    return f"\n\n{text}\n\n" if text.strip() else ""


def _element(node: _Node) -> str:
    tag = node.tag
    if tag in DROPPED:
        return ""
    if tag in KEPT:
        return _html(node)
    if tag in BLOCKS:
        return _block(_inline(node).strip())
    if re.fullmatch("h[1-6]", tag):
        text = " ".join(_inline(node).split())
        return _block(f"{'#' * int(tag[1])} {text}") if text else ""
    if tag in MARKS and not node.plain:
        return _marked(node, MARKS[tag])
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return _block("---")
    if tag == "a":
        return _link(node)
    if tag == "img":
        src = node.attrs.get("src") or ""
        return f"![{_escape(node.attrs.get('alt') or '')}]({src})" if src else ""
    if tag == "pre":
        return _fenced(node)
    if tag in ("code", "kbd", "samp", "tt"):
        text = " ".join(_plain(node).split())
        ticks = "`" * (max((len(r) for r in re.findall("`+", text)), default=0) + 1)
        pad = " " if "`" in text else ""
        return f"{ticks}{pad}{text}{pad}{ticks}" if text else ""
    if tag in ("ul", "ol"):
        return _list(node)
    if tag == "blockquote":
        text = _tidy(_inline(node))
        return _block("\n".join(f"> {line}".rstrip() for line in text.split("\n"))) if text else ""
    if tag == "table":
        return _table(node)
    if tag == "input" and node.attrs.get("type") == "checkbox":
        return "[x] " if "checked" in node.attrs else "[ ] "
    return _inline(node)


def _marked(node: _Node, mark: str) -> str:
    text = _inline(node)
    core = text.strip()
    if not core:
        return text
    lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    # Emphasis cannot span paragraphs, so each gets its own marks.
    parts = [p.strip() for p in re.split(r"\n\s*\n", core) if p.strip()]
    plain = [p if p.startswith(("#", "```", "- ", "|", "> ")) else f"{mark}{p}{mark}" for p in parts]
    return ("\n\n" if "\n\n" in lead else " " * bool(lead)) + "\n\n".join(plain) + ("\n\n" if "\n\n" in trail else " " * bool(trail))


def _link(node: _Node) -> str:
    text, href = " ".join(_inline(node).split()), node.attrs.get("href")
    if not href or not text:
        return text
    title = node.attrs.get("title")
    target = f"<{href}>" if re.search(r"[\s()]", href) else href
    return f"[{text}]({target}{f' "{title}"' if title else ''})"


def _fenced(node: _Node) -> str:
    code = next((c for c in node.children if isinstance(c, _Node) and c.tag == "code"), node)
    names = f"{code.attrs.get('class') or ''} {node.attrs.get('class') or ''}"
    lang = re.search(r"lang(?:uage)?-([\w+#-]+)", names)
    text = _plain(node).strip("\n")
    fence = "`" * max(3, max((len(r) for r in re.findall("`+", text)), default=0) + 1)
    return f"\n\n{fence}{lang[1] if lang else ''}\n{text}\n{fence}\n\n"


def _list(node: _Node) -> str:
    lines = []
    number = int(node.attrs["start"]) if (node.attrs.get("start") or "").isdigit() else 1
    for child in node.children:
        if not isinstance(child, _Node):
            continue
        marker = f"{number}. " if node.tag == "ol" else "- "
        text = _tidy(_inline(child) if child.tag == "li" else _element(child))
        if not text:
            continue
        pad = " " * len(marker)
        body = text.split("\n")
        lines.append("\n".join([marker + body[0], *(pad + line if line else "" for line in body[1:])]))
        number += 1
    return _block("\n".join(lines))


def _rows(node: _Node) -> list[_Node]:
    found = []
    for child in node.children:
        if isinstance(child, _Node):
            found += [child] if child.tag == "tr" else _rows(child) if child.tag != "table" else []
    return found


def _table(node: _Node) -> str:
    rows = []
    for row in _rows(node):
        cells = [c for c in row.children if isinstance(c, _Node) and c.tag in ("td", "th")]
        rows.append([" ".join(_inline(c).split()).replace("|", "\\|") for c in cells])
    rows = [r for r in rows if r]
    if not rows:
        return _block(_inline(node).strip())
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = [f"| {' | '.join(r)} |" for r in rows]
    lines.insert(1, "|" + " --- |" * width)
    return _block("\n".join(lines))


def _tidy(text: str) -> str:
    """No blanks before line ends but the two of a break, no runs of blank lines."""
    out, fence = [], ""
    for line in text.split("\n"):
        ticks = re.match(r"\s*(`{3,})", line)
        if ticks and (not fence or ticks[1] == fence):
            fence = "" if fence else ticks[1]
        elif not fence:
            line = line.rstrip() + ("  " if line.endswith("  ") and line.strip() else "")
            if not line and (not out or not out[-1].strip()):
                continue
        out.append(line)
    return "\n".join(out).strip()


def to_markdown(html: str) -> str:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return _tidy(_inline(tree.root))
