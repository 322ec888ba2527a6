"""Markup residue in text documents.

A record is read into one tree, whatever its markup language: HTML elements (with
implied end tags, and visibility by element, attribute and style), Markdown blocks, wiki
tables and templates, and LaTeX environments. The layout pass then writes the visible
text of the tree: headings, list items with their level and number, tables in a grid
with row and column spans, cells padded into columns, nested tables inside their cell,
code and formulas verbatim. The languages met on the way are the record's markup.

The record format's own ``[BLOCK ..]`` and ``[ROW ..]`` markers split a text into
blocks and are kept. What lies in a code block or table is read as text of that
block and adds no other language.

Defined results: null stays null with no markup, empty stays empty; repeated rows
give equal results; a text of any length is read whole; an end tag without a start is
left out; spans beyond ``WIDEST`` count as that many.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.lookalike import SUSPECT_JAVA, canonical

# Element names of HTML, by how they are laid out.
INVISIBLE = {"script", "style", "head", "template", "noscript", "title", "meta", "link"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "source"}
BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "ul", "ol", "dl", "dt", "dd", "form",
         "blockquote", "figure", "address", "body", "html", "center", "fieldset", "caption"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "font", "code", "sub", "sup", "small", "big", "del", "ins", "mark",
          "label", "button", "abbr", "cite", "q", "tt", "kbd", "strike", "iframe", "option", "select"}
ELEMENTS = INVISIBLE | VOID | BLOCK | HEADING | TABLE | INLINE | {"li", "pre", "textarea"}
#: An open element on the left is closed by one of those on the right.
IMPLIED_END = {"li": {"li"}, "p": BLOCK | HEADING | {"p", "li", "table", "pre"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
               "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | dict.fromkeys(HEADING, (BLOCK | HEADING | {"li", "table", "pre"}) - {"center"})

#: Rows without any of this or a suspect character hold no markup; tested in the JVM. A superset of the reader's patterns.
SIGNS_JAVA = (
    r"<[^\s<>0-9]|&(?:#|[^\s&;]{1,31};)|\\[^\s]|\$[^$]*\$|\[\[|\{\{|\{\||'''|`|~~|\*\*|__|\]\(|"
    r"(?m)^(?:\[(?:BLOCK|ROW) [^\]\n]*\] ?)?[ \t]*(?:=|#{1,6}[ \t]|>|[-*+][ \t]|[0-9lOISB]{1,2}\.[ \t]|\||:?-{3,})"
)
_MARKER = re.compile(r"^\[(?:BLOCK|ROW) [^\]\n]*\] ?", re.M)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]{0,11})((?:\s[^<>]*)?)(/?)>", re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_FENCE = re.compile(r"^(```|~~~)[ \t]*[\w+-]*[ \t]*$")
_ATX = re.compile(r"^(#{1,6})[ \t]+(\S.*)$")
_SETEXT = re.compile(r"^(={3,}|-{3,})[ \t]*$")
_BULLET = re.compile(r"^( *)([-*+])[ \t]+(\[[ xX]\] +)?(?=\S)")
_PAGE_DASH = re.compile(r"^[-–—·][ \t]*[0-9lOISB]{1,4}[ \t]*[-–—·][ \t]*$")
_NUMBER = re.compile(r"^( *)([0-9lOISB]{1,2})\.[ \t]+(?=\S)")
_QUOTE = re.compile(r"^>[ \t]?(?=\S)")
_PIPE_RULE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_TEX_ENV = re.compile(r"\\(begin|end)\{([^{}]{1,30})\}")
_MATH = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$|\$([^$\n]{1,300}?)\$", re.S)
_TEX_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\[\]]*\])?")
#: LaTeX environments that are cut out whole: tables, code and formulas.
_TEX_WHOLE = re.compile(r"\\begin\{((?:tabular[x*]?|verbatim|lstlisting|equation|align|gather|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\1\}", re.S)
_TEX_TABLES, _TEX_CODE = ("tabular",), ("verbatim", "lstlisting")
_TEX_LIST = {"itemize": "b", "enumerate": "e", "description": "b"}
# Commands of formulas, kept as written outside of formulas too.
_TEX_FORMULA = {"frac", "dfrac", "tfrac", "sqrt", "binom", "overline", "underline", "hat", "bar", "vec", "mathrm", "mathbf", "mathit", "operatorname", "text", "sum", "prod", "int", "lim"}
_TEX_BARE = {"item", "textbf", "sum", "times", "ge", "le", "alpha", "beta", "quad"}
_EMPHASIS = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
# Attributes and styles that make an element invisible.
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|type\s*=\s*[\"']?hidden|(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPAN = {"colspan": re.compile(r"colspan\s*=\s*[\"']?(\d+)", re.I), "rowspan": re.compile(r"rowspan\s*=\s*[\"']?(\d+)", re.I), "start": re.compile(r"start\s*=\s*[\"']?(\d+)", re.I)}
WIDEST = 100
#: Elements that an implied end does not reach over.
_SCOPE = {"table", "td", "th", "ul", "ol", "dl", "select"}
_MATH_SIGN = re.compile(r"\\[A-Za-z]|[\^_]")
_TEX_HIDDEN = {"label", "ref", "cite", "eqref", "pageref", "index", "vspace", "hspace", "noindent", "centering"}


@dataclass
class Node:
    kind: str  # p, heading, item, code, math, table, rule
    text: str = ""
    level: int = 0
    mark: str = ""
    rows: list[list[str]] = field(default_factory=list)


@dataclass
class Element:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)

    @property
    def unseen(self) -> bool:
        return self.tag in INVISIBLE or bool(self.attributes and _UNSEEN.search(self.attributes))

    def number(self, name: str, default: int = 1) -> int:
        found = _SPAN[name].search(self.attributes) if self.attributes else None
        return max(1, min(int(found[1]), WIDEST)) if found else default


def build_tree(text: str, tags: list[re.Match]) -> Element:
    """The elements of ``text`` as a tree; a start tag ends the elements that can't hold it."""
    root = Element("")
    stack, at = [root], 0
    for m in tags:
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--"):
            continue
        tag = m[2].lower()
        if m[1] != "/":
            for depth in range(len(stack) - 1, 0, -1):
                if tag in IMPLIED_END.get(stack[depth].tag, ()):
                    del stack[depth:]
                    if tag not in TABLE:
                        break
                elif stack[depth].tag in _SCOPE:
                    break
            element = Element(tag, m[3] or "")
            stack[-1].children.append(element)
            if tag not in VOID and not m[4]:
                stack.append(element)
        else:
            for depth in range(len(stack) - 1, 0, -1):
                # any heading's end ends any heading
                if stack[depth].tag == tag or (tag in HEADING and stack[depth].tag in HEADING):
                    del stack[depth:]
                    break
                if stack[depth].tag == "table" and tag not in TABLE:
                    break
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _flat(element: Element, raw: bool = False) -> str:
    """All visible text below an element; ``raw`` keeps its white space."""
    out = []
    for child in element.children:
        if isinstance(child, str):
            out.append(child)
        elif child.unseen:
            continue
        elif child.tag == "table" and not raw:
            out.append(" (" + "; ".join(" | ".join(c for c in row if c) for row in table_grid(child)) + ") ")
        elif child.tag == "br":
            out.append("\n" if raw else " ")
        elif child.tag == "li" and not raw:
            out.append("; " + _flat(child) if "".join(out).strip() else _flat(child))
        else:
            space = " " if child.tag in BLOCK and not raw else ""
            out.append(space + _flat(child, raw) + space)
    return "".join(out)


def table_grid(table: Element) -> list[list[str]]:
    """Cell texts in a grid; a spanned place is empty but for its first."""

    def below(element: Element, tag: set[str]):
        for child in element.children:
            if isinstance(child, Element) and not child.unseen:
                if child.tag in tag:
                    yield child
                elif child.tag != "table":
                    yield from below(child, tag)

    lines: list[list[Element]] = []
    for row in below(table, {"tr"}):
        lines.append(list(below(row, {"td", "th"})))
    if not lines:
        lines = [list(below(table, {"td", "th"}))]
    grid: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(lines):
        c = 0
        for cell in cells:
            while (r, c) in grid:
                c += 1
            wide, high = cell.number("colspan"), cell.number("rowspan")
            for i in range(min(high, len(lines) - r)):
                for j in range(wide):
                    grid.setdefault((r + i, c + j), "")
            grid[(r, c)] = re.sub(r"\s+", " ", html_entities.unescape(_flat(cell))).strip()
            c += wide
    width = max((c for _, c in grid), default=-1) + 1
    rows = [[grid.get((r, c), "") for c in range(width)] for r in range(len(lines))]
    while width and all(not row[-1] for row in rows) and width > max((len(cells) for cells in lines), default=0):
        width -= 1
        rows = [row[:width] for row in rows]
    return [row for row, cells in zip(rows, lines, strict=True) if cells or any(row)]


def _closing(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``; 0 if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "{}":
            depth += 1 if text[i] == "{" else -1
            if not depth:
                return i
    return 0


class _Reader:
    """Reads one block into nodes and notes the languages used."""

    def __init__(self) -> None:
        self.found: set[str] = set()

    # ---- inline text ----------------------------------------------------
    def inline(self, text: str, html: bool = True) -> str:
        if "\\" in text or "$" in text:
            text = _MATH.sub(self._math, text)
        if "\\" in text:
            text = self._commands(text)
        if "[[" in text:
            text = re.sub(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]", self._wiki_link, text)
        if "{{" in text:
            text = re.sub(r"\{\{([^{}]*)\}\}", self._template, text)
        if "'''" in text:
            text = re.sub(r"'{3}(?=\S)(.+?)(?<=\S)'{3}", lambda m: self._take("wiki", m[1]), text, flags=re.S)
        if "](" in text:
            text = re.sub(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s[^()]*)?\)", lambda m: self._take("markdown", m[1]), text)
        if "`" in text:
            text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", lambda m: self._take("markdown", m[1]), text)
        if "**" in text:
            text = re.sub(r"\*\*(?=\S)([^*]+?)(?<=\S)\*\*", lambda m: self._take("markdown", m[1]), text)
        if "__" in text:
            text = re.sub(r"(?<![0-9A-Za-z])__(?=\S)([^_]+?)(?<=\S)__(?![0-9A-Za-z_])", lambda m: self._take("markdown", m[1]), text)
        if "~~" in text:
            text = re.sub(r"~~(?=\S)([^~]+?)(?<=\S)~~", lambda m: self._take("markdown", m[1]), text)
        if html and "&" in text:
            text = _ENTITY.sub(self._entity, text)
        return text

    def _take(self, language: str, text: str) -> str:
        self.found.add(language)
        return text

    def _math(self, match: re.Match) -> str:
        body = next(g for g in match.groups() if g is not None)
        if match[0][0] == "$" and not _MATH_SIGN.search(body):
            return match[0]
        self.found.add("latex")
        return body.strip().replace("\\", "\x00")

    def _commands(self, text: str) -> str:
        """LaTeX commands with their balanced groups; formula commands stay as written."""
        out, at = [], 0
        while (m := _TEX_COMMAND.search(text, at)) is not None:
            name, groups, end = m[1], [], m.end()
            while end < len(text) and text[end] == "{" and (close := _closing(text, end)) > 0:
                groups.append(text[end + 1 : close])
                end = close + 1
            out.append(text[at : m.start()])
            at = end
            if not groups and name not in _TEX_HIDDEN and name not in _TEX_BARE:
                out.append(m[0].replace("\\", "\x00"))
                continue
            self.found.add("latex")
            if name in _TEX_FORMULA and groups:
                out.append(text[m.start() : end].replace("\\", "\x00"))
            elif name not in _TEX_HIDDEN:
                shown = "".join(self._commands(g) for g in groups)
                out.append(f" ({shown})" if name == "footnote" and groups else shown)
        return "".join(out) + text[at:]

    def _wiki_link(self, match: re.Match) -> str:
        self.found.add("wiki")
        target, shown = match[1].strip(), match[2]
        if shown is None and ":" in target:  # categories and files are not shown
            return ""
        return (shown if shown is not None else target).strip()

    def _template(self, match: re.Match) -> str:
        self.found.add("wiki")
        name, *given = (p.strip() for p in match[1].split("|"))
        return f"{name}({', '.join(p.split('=', 1)[-1].strip() for p in given)})" if given else name

    def _entity(self, match: re.Match) -> str:
        shown = html_entities.unescape(match[0])
        if shown == match[0]:
            return match[0]
        self.found.add("html")
        return " " if shown == "\xa0" else shown

    # ---- blocks ----------------------------------------------------------
    def read(self, text: str) -> list[Node]:
        pieces, at = [], 0
        if "\\begin" in text:
            cut = [m for m in _TEX_WHOLE.finditer(text)]
            if cut:
                nodes: list[Node] = []
                for m in cut:
                    nodes += (self.read(text[at : m.start()]) if m.start() > at else []) + [self._environment(m[1].rstrip("*"), m[2])]
                    at = m.end()
                return nodes + (self.read(text[at:]) if at < len(text) else [])
        # fenced code and tables of one language are cut out first: nothing in them counts for another
        for m in re.finditer(r"^(```|~~~)[^\n`]*\n.*?(?:^\1[ \t]*$|\Z)|^\{\|.*?(?:^\|\}[ \t]*$|\Z)|(?:^\|[^\n]*\|[ \t]*(?:\n|\Z)){2,}", text, re.S | re.M):
            if m.start() < at:
                continue
            body = m[0]
            kind = "code" if m[1] else "wikitable" if body.startswith("{|") else "pipe"
            if kind == "pipe" and not any(_PIPE_RULE.match(x) for x in body.split("\n")):
                continue
            pieces += [("text", text[at : m.start()]), (kind, body)]
            at = m.end()
        pieces.append(("text", text[at:]))
        nodes: list[Node] = []
        for kind, body in pieces:
            if kind == "code":
                self.found.add("markdown")
                lines = body.split("\n")
                end = -1 if len(lines) > 1 and re.match(r"^(```|~~~)", lines[-1]) else None
                nodes.append(Node("code", "\n".join(lines[1:end])))
            elif kind == "pipe":
                self.found.add("markdown")
                rows = [re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", x.strip())) for x in body.strip().split("\n") if not _PIPE_RULE.match(x)]
                nodes.append(Node("table", rows=[[self._cell(c.replace("\\|", "|")) for c in r] for r in rows]))
            elif kind == "wikitable":
                self.found.add("wiki")
                nodes.append(self._wiki_table(body))
            elif body:
                nodes += self._html(body)
        return nodes

    def _wiki_table(self, body: str) -> Node:
        rows: list[list[str]] = [[]]
        for line in body.split("\n")[1:]:
            line = line.strip()
            if line.startswith("|}"):
                break
            if line.startswith("|-"):
                rows.append([])
            elif line[:1] in {"|", "!"}:
                cells = re.split(r"\|\||!!", line[1:])
                rows[-1] += [self._cell(c if "[[" in c or "{{" in c else c.split("|")[-1]) for c in cells]
        return Node("table", rows=[r for r in rows if r])

    @staticmethod
    def _cell(text: str) -> str:
        """A cell's text without marks; they belong to the table's language."""
        return _Reader().inline(text.strip(), html=False).replace("\x00", "\\").strip()

    def _environment(self, name: str, body: str) -> Node:
        self.found.add("latex")
        if name.startswith(_TEX_TABLES):
            while body.startswith(("{", "[")):
                close = _closing(body, 0) if body[0] == "{" else body.find("]")
                if close <= 0:
                    break
                body = body[close + 1 :].lstrip(" ")
            body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^{}]*\})", "", body)
            rows = [[self._cell(c) for c in re.split(r"(?<!\\)&", row)] for row in re.split(r"\\\\(?:\[[^\]]*\])?", body) if row.strip()]
            return Node("table", rows=[[c.replace("\\&", "&") for c in r] for r in rows])
        return Node("code" if name in _TEX_CODE else "math", body.strip("\n") if name in _TEX_CODE else body.strip().replace("\\", "\x00"))

    def _html(self, text: str) -> list[Node]:
        if "<" not in text:
            return self._lines(text)
        tags = [m for m in _TAG.finditer(text) if m[0].startswith("<!--") or m[2].lower() in ELEMENTS]
        if not tags:
            return self._lines(text)
        self.found.add("html")
        nodes: list[Node] = []
        text_run: list[str] = []  # text outside tables and preformatted elements

        def flush() -> None:
            if "".join(text_run).strip("\n"):
                nodes.extend(self._lines("".join(text_run)))
            text_run.clear()

        def walk(element: Element, level: int) -> None:
            number = element.number("start", 1) if element.tag == "ol" else 0
            for child in element.children:
                if isinstance(child, str):
                    text_run.append(child)
                elif child.unseen:
                    continue
                elif child.tag == "table":
                    flush()
                    loose = " ".join(re.sub(r"\s+", " ", html_entities.unescape(_flat(c))).strip() for c in child.children if isinstance(c, Element) and c.tag == "caption" and not c.unseen)
                    stray = " ".join(c.strip() for c in child.children if isinstance(c, str) and c.strip())
                    nodes.extend(Node("p", t) for t in (loose, stray) if t)
                    nodes.append(Node("table", rows=table_grid(child)))
                elif child.tag == "pre":
                    flush()
                    nodes.append(Node("code", html_entities.unescape(_flat(child, True))))
                elif child.tag in HEADING:
                    flush()
                    # an unclosed heading ends at a blank line
                    title, _, rest = _flat(child).strip().partition("\n\n")
                    nodes.append(Node("heading", self.inline(re.sub(r"\s+", " ", title)), int(child.tag[1])))
                    text_run.append(rest)
                elif child.tag == "li":
                    text_run.append(f"\n\x01{max(level - 1, 0)},{f'{number}.' if element.tag == 'ol' else '-'}\x02")
                    number += 1
                    walk(child, level)
                    text_run.append("\n")
                elif child.tag in {"ul", "ol"}:
                    text_run.append("\n")
                    walk(child, level + 1)
                    text_run.append("\n")
                elif child.tag in {"br", "hr"}:
                    text_run.append("\n")
                elif child.tag in BLOCK:
                    text_run.append("\n")
                    walk(child, level)
                    text_run.append("\n")
                else:
                    walk(child, level)

        walk(build_tree(text, tags), 0)
        flush()
        return nodes

    def _lines(self, text: str) -> list[Node]:
        if "\\begin" in text or "\\[" in text:
            text = _TEX_ENV.sub(lambda m: self._take("latex", f"\n\x03{_TEX_LIST[m[2]] if m[1] == 'begin' else 'x'}\n" if m[2] in _TEX_LIST else "\n"), text)
        lines, nodes, i = text.split("\n"), [], 0
        paragraph: list[str] = []
        open_lists: list[list] = []  # kind of each open LaTeX list, and its last number

        def end() -> None:
            if paragraph:
                nodes.append(Node("p", self.inline("\n".join(paragraph))))
                paragraph.clear()

        # "1." is a list only if the block counts, i.e. a line starts with one
        counts = [m[2] for m in map(_NUMBER.match, lines) if m]
        ordered = any(n in {"1", "l", "I"} for n in counts)
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                end()
                nodes.append(Node("p", ""))
            elif line.startswith("\x03"):
                end()
                if line[1:2] != "x":
                    open_lists.append([line[1:2], 0])
                elif open_lists:
                    open_lists.pop()
            elif line.startswith("\x01"):
                end()
                about, _, shown = line[1:].partition("\x02")
                level, _, mark = about.partition(",")
                if shown.strip() or not (i + 1 < len(lines) and lines[i + 1].strip() and not lines[i + 1].startswith("\x01")):
                    nodes.append(Node("item", self.inline(shown.strip()), int(level), mark))
                else:  # the item's text is a block of its own
                    i += 1
                    nodes.append(Node("item", self.inline(lines[i].strip()), int(level), mark))
            elif (m := re.match(r"^\s*\\item\b\s*(.*)$", line)) is not None:
                end()
                self.found.add("latex")
                mark = "-"
                if open_lists and open_lists[-1][0] == "e":
                    open_lists[-1][1] += 1
                    mark = f"{open_lists[-1][1]}."
                nodes.append(Node("item", self.inline(m[1]), max(len(open_lists) - 1, 0), mark))
            elif (m := re.match(r"^\s*\\(?:sub)*(section|chapter|paragraph)\*?\{([^{}]*)\}(.*)$", line)) is not None:
                end()
                self.found.add("latex")
                nodes.append(Node("heading", self.inline(m[2]), 1))
                if m[3].strip():
                    paragraph.append(m[3].strip())
            elif (m := _ATX.match(line)) is not None:
                end()
                self.found.add("markdown")
                nodes.append(Node("heading", self.inline(m[2].rstrip("# ")), len(m[1])))
            elif (m := _WIKI_HEAD.match(line)) is not None:
                end()
                self.found.add("wiki")
                nodes.append(Node("heading", self.inline(m[2]), len(m[1])))
            elif (m := _SETEXT.match(line)) is not None and (line[0] == "=" or paragraph) and i:
                self.found.add("markdown")
                title = paragraph.pop() if paragraph else ""
                end()
                nodes.append(Node("heading", self.inline(title), 1 if line[0] == "=" else 2) if title else Node("rule"))
            elif _PAGE_DASH.match(line):
                paragraph.append(line)
            elif (m := _BULLET.match(line)) is not None:
                end()
                self.found.add("markdown")
                nodes.append(Node("item", self.inline(line[m.end() :]), len(m[1]) // 2, (m[3] or "-").strip()))
            elif ordered and (m := _NUMBER.match(line)) is not None:
                end()
                self.found.add("markdown")
                nodes.append(Node("item", self.inline(line[m.end() :]), len(m[1]) // 2, f"{m[2]}."))
            elif (m := _QUOTE.match(line)) is not None:
                end()
                self.found.add("markdown")
                nodes.append(Node("p", self.inline(line[m.end() :])))
            else:
                paragraph.append(line)
            i += 1
        end()
        return nodes


def _width(text: str) -> int:
    return sum(2 if "ᄀ" <= c <= "ᇿ" or "⺀" <= c <= "￠" else 1 for c in text)


def _layout(nodes: list[Node], emphasis: bool = False) -> str:
    out: list[str] = []
    blank = lambda n: n.kind == "p" and not n.text.strip()
    following, after = ["item"] * len(nodes), "item"
    for k in range(len(nodes) - 1, -1, -1):
        following[k] = after
        after = after if blank(nodes[k]) else nodes[k].kind
    before = ""
    for k, node in enumerate(nodes):
        if not blank(node):
            before = node.kind
        elif before == "item" == following[k]:
            continue  # a blank line inside one list
        if emphasis and node.kind in {"p", "heading", "item"} and ("*" in node.text or "_" in node.text):
            node.text = _EMPHASIS.sub(lambda m: m[1] or m[2], node.text)
        if node.kind == "heading":
            out += ["", node.text, ""]
        elif node.kind == "item":
            out.append("  " * node.level + f"{node.mark} {node.text}")
        elif node.kind == "code":
            out += ["", *("    " + line for line in node.text.strip("\n").split("\n")), ""]
        elif node.kind == "math":
            out += ["", node.text, ""]
        elif node.kind == "table" and node.rows:
            columns = max(map(len, node.rows))
            widths = [max(_width(r[c]) if c < len(r) else 0 for r in node.rows) for c in range(columns)]
            out += ["", *(" | ".join(c + " " * (widths[k] - _width(c)) for k, c in enumerate(r)).rstrip() for r in node.rows), ""]
        elif node.kind == "p":
            out.append(node.text)
    text = "\n".join(out).replace("\x00", "\\")
    text = re.sub("[\x01-\x03]", "", text)
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", text)).strip("\n")


def clean_markup(text: str | None) -> tuple[str | None, list[str]]:
    """The visible text of ``text`` and the markup languages in it, sorted."""
    if not text:
        return text, []
    plain = canonical(text) if not text.isascii() else text
    reader, out, at, marker = _Reader(), [], 0, ""
    cuts = [*_MARKER.finditer(plain), None]
    for cut in cuts:
        body = plain[at : cut.start() if cut else len(plain)]
        if body or marker:
            out.append((marker, reader.read(body.strip("\n"))))
        if cut:
            marker, at = cut[0], cut.end()
    # single stars and lines are emphasis only in a text that is Markdown otherwise
    emphasis = "markdown" in reader.found
    return "\n".join(marker + _layout(nodes, emphasis) for marker, nodes in out), sorted(reader.found)


def render_markup(df: DataFrame, key: str, column: str) -> DataFrame:
    """(record_id, clean_text, markups): clean text and markup languages of each row.

    Rows without any sign of markup keep their text and skip the Python stage; rows
    that are read only for a suspect character keep their text if they hold no markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, sign in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                clean, found = clean_markup(text)
                done.append((clean if sign or found else text, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], pa.list_(pa.string()))],
                names=["record_id", "clean_text", "markups"],
            )

    rows = df.select(F.col(key).cast("string").alias("record_id"), F.col(column).alias("clean_text"))
    signed = F.coalesce(F.col("clean_text").rlike(SIGNS_JAVA), F.lit(False))
    read = signed | F.coalesce(F.col("clean_text").rlike(SUSPECT_JAVA), F.lit(False))
    plain = rows.where(~read).withColumn("markups", F.array().cast("array<string>"))
    return rows.where(read).withColumn("sign", signed).mapInArrow(run, "record_id string, clean_text string, markups array<string>").unionByName(plain)


def markup_found(df: DataFrame, key: str, column: str) -> DataFrame:
    """(record_id, markup): one row for each record and each language in it."""
    return render_markup(df, key, column).select("record_id", F.explode("markups").alias("markup")).distinct()
