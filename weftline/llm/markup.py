"""Problem 5: HTML, Markdown, wiki and LaTeX residue rendered to clean text that keeps its structure.

Layout-aware rendering: tags are read into a tree whose builder adds the ends and parents that broken markup leaves out
(an item closes the item before it, a cell its neighbour, a block the open paragraph); visibility rules drop comments,
scripts, styles and hidden elements and keep all other text. The tree is then laid out: blocks on lines of their own,
headings underlined, items by '- ' or their number, preformatted text as it is, table cells aligned in columns. Markdown,
wiki and LaTeX are rewritten first, with code and formulas protected; LaTeX groups are read into a tree of their own.

``take_out(text)`` gives the clean text and the kinds of markup that the rewriting and the tree builder took out of it: a
value holds markup when they took anything. Only values with a character that markup needs ever reach Python, once.
Defined results: null stays null; text without markup is returned as it is, other text in the consistent form of problem
7; broken or unclosed markup is closed at the end of its block; nesting and length have no bound, and every rule is one
pass (tags that were escaped several times take one pass a time).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.folding import fold
from weftline.runtime import ship

# Element names of HTML, and those of wikis.
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
INLINE = "a abbr acronym b bdi bdo big button cite code del dfn em font i img input ins kbd label map mark math meter nobr object q s samp select small span strike strong sub sup textarea time tt u var wbr br col colgroup link meta base area embed param source track audio video canvas iframe picture svg option optgroup ref references nowiki gallery".split()
HIDDEN = "head script style template noscript title datalist iframe object svg math ref references".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr references".split())

_NAMES = "|".join(sorted({*BLOCKS, *INLINE, *HIDDEN}, key=len, reverse=True))
_TAG = re.compile(rf"<(/?)({_NAMES})((?:\s[^<>\n]*|\s*/)?)(?:>|(?=\n|\Z))", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|(?=\n\s*\n)|\Z)|<!doctype[^>]*>|<\?xml[^>]*>|-->", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|([A-Za-z][A-Za-z0-9]{1,31});|(?:nbsp|amp|quot|mdash|ndash|ldquo|rdquo|lsquo|rsquo|hellip|lt|gt)(?![\w=;]))")

#: kind -> where a rewriting rule may act.
SYNTAX = {
    "latex": r"\\(?:[A-Za-z]|[&%#_{}$\\])|\$[^$\n]*[\\^_{][^$\n]*\$",
    "md_bold": r"\*\*(?=\S)|(?<=\S)\*\*|(?<!\w)__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)",
    "md_italic": r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w/])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?!\w)",
    "md_code": r"```|`[^`\n]+`|^~~~",
    "md_strike": r"~~(?=\S)[^~\n]+~~",
    "md_link": r"\]\((?:[^()\s]|$)|!\[[^\]\n]*\]|\[[^\[\]\n]+\]\[\w*\]|^\[[^\[\]\n]+\]:\s*\S|<(?:https?|mailto):[^<>\s]*>?",
    "md_heading": r"^ {0,3}#{1,6}[ \t]+\S",
    "md_quote": r"^ {0,3}>[ \t]*\S",
    "md_table": r"^[ \t]*\|.*\|[ \t]*$|^[ \t]*:?-{3,}:?[ \t]*\|",
    "md_list": r"^[ \t]*[*+][ \t]+\S[^\n]*\n[ \t]*[*+][ \t]+\S",
    "wiki_link": r"\[\[(?=[^\[\]\s])|\[https?://[^\s\]]+(?: |\])",
    "wiki_quote": r"(?<!')''(?!')[^'\n]|'''[^'\n]",
    "wiki_heading": r"^={2,6}[^=\n].*?={2,6}[ \t]*$",
    "wiki_template": r"\{\{[^{}\n]|\{\||^\|[-}]|^![^!\n]*!!",
}
_SYNTAX = {k: re.compile(v, re.M) for k, v in SYNTAX.items()}
#: One pattern for the JVM: markup needs one of these.
MAY_HOLD = r"[<&*_`\[{\\~=|#^\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e]|''|(?m:^ {0,3}[>+])|-->"


def entity(m: re.Match) -> bool:
    return m.group(1) is None or m.group(1) + ";" in html5


_HEADINGS = {f"h{i}" for i in range(1, 7)}
_BLOCK_SET, _HIDDEN_SET = frozenset(BLOCKS), frozenset(HIDDEN)
#: An opening tag ends these open elements, up to the nearest of the second set.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "thead", "tbody"}, {"table"}), "tfoot": ({"td", "th", "tr", "tbody"}, {"table"}),
}
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)


def table_lines(rows: list[list[str]]) -> list[str]:
    """Cells aligned in columns, two spaces apart."""
    rows = [r for r in rows if any(r)]
    width = [max(len(r[i]) if i < len(r) else 0 for r in rows) for i in range(max(map(len, rows), default=0))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows]


class _Layout:
    """Stack of open elements and the text laid out so far; one pass, without recursion, however deep the nesting."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.hidden = self.pre = 0
        self.lines: list[list[str]] = [[]]  # a frame for the page and one for each open cell
        self.line: list[str] = [""]
        self.tables: list[list[list[str]]] = []
        self.lists: list[int | None] = []

    def flush(self, blank: bool = False) -> None:
        text = self.line[-1] if self.pre else " ".join(self.line[-1].split(" ")).strip()
        if text.strip():
            self.lines[-1].append(text)
        self.line[-1] = ""
        if blank and self.lines[-1] and self.lines[-1][-1]:
            self.lines[-1].append("")

    def text(self, s: str) -> None:
        if self.hidden:
            return
        if self.pre:
            parts = s.split("\n")
            for x in parts[:-1]:
                self.lines[-1].append("    " + self.line[-1] + x)
                self.line[-1] = ""
            self.line[-1] += parts[-1]
            return
        parts = s.split("\n")
        for i, x in enumerate(parts):
            if i:
                self.flush()
                if not x.strip() and i < len(parts) - 1 and self.lines[-1] and self.lines[-1][-1]:
                    self.lines[-1].append("")
            self.line[-1] += x

    def start(self, tag: str, attributes: str) -> None:
        if tag in _IMPLIED:
            ends, stop = _IMPLIED[tag]
            for i in range(len(self.open) - 1, -1, -1) if any(self.names[x] for x in ends) else ():
                if self.open[i].lstrip("!") in stop:
                    break
                if self.open[i].lstrip("!") in ends:
                    while len(self.open) > i:
                        self.pop()
        elif tag in _BLOCK_SET and "p" in self.open[-1:]:
            self.pop()
        if tag in VOID or attributes.rstrip().endswith("/"):
            if not self.hidden:
                if tag == "br":
                    self.flush()
                elif tag == "hr":
                    self.flush(True)
            return
        invisible = tag in _HIDDEN_SET or bool(attributes) and bool(_INVISIBLE.search(attributes))
        self.open.append("!" + tag if invisible else tag)
        self.names[tag] += 1
        if invisible:
            self.hidden += 1
        if self.hidden:
            return
        if tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.lines.append([])
            self.line.append("")
        elif tag in _BLOCK_SET:
            self.flush(tag in _HEADINGS or tag in ("p", "table", "ul", "ol", "pre", "blockquote"))
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            self.line[-1] = "  " * max(0, len(self.lists) - 1) + ("- " if n is None else f"{n + 1}. ")
            if n is not None:
                self.lists[-1] = n + 1
        elif tag == "pre":
            self.pre += 1

    def pop(self) -> None:
        tag = self.open.pop()
        self.names[tag.lstrip("!")] -= 1
        if tag[0] == "!":
            self.hidden -= 1
            return
        if self.hidden:
            return
        if tag in ("td", "th") and self.tables and len(self.lines) > 1:
            self.flush()
            self.line.pop()
            self.tables[-1][-1].append(" ".join(x.strip() for x in self.lines.pop() if x.strip()))
        elif tag == "table" and self.tables:
            self.flush()
            self.lines[-1] += [*table_lines(self.tables.pop()), ""]
        elif tag in _HEADINGS:
            before = len(self.lines[-1])
            self.flush()
            if len(self.lines[-1]) > before:
                self.lines[-1] += [("=" if tag in ("h1", "h2") else "-") * max(3, len(self.lines[-1][-1])), ""]
        elif tag == "pre":
            if self.line[-1]:
                self.lines[-1].append("    " + self.line[-1])
                self.line[-1] = ""
            self.pre -= 1
            self.flush(True)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.flush(True)
        elif tag in _BLOCK_SET:
            self.flush(tag in ("p", "blockquote"))

    def end(self, tag: str) -> None:
        if not self.names[tag]:
            if tag in ("p", "br", "div", "tr", "table", "li", "ul", "ol") and not self.hidden:
                self.flush()
            return
        while self.open[-1].lstrip("!") != tag:
            self.pop()
        self.pop()

    def close(self) -> str:
        while self.open:
            self.pop()
        self.flush()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in self.lines[0])).strip("\n")


def _entities(text: str, taken: list[str]) -> str:
    def plain(m: re.Match) -> str:
        if not entity(m):
            return m.group()
        taken.append("html_entity")
        return html.unescape(m.group()).replace("\xa0", " ")

    return _ENTITY.sub(plain, text) if "&" in text else text


def render_html(text: str, taken: list[str]) -> str:
    """All visible text of (possibly broken) HTML, laid out; what was read is added to ``taken``."""
    page, at = _Layout(), 0
    if "<" in text or "-->" in text:
        text, n = _COMMENT.subn("", text)
        taken += ["html_comment"] * min(n, 1)
        tags = list(_TAG.finditer(text))
    else:
        tags = []
    if not tags:
        return _entities(text, taken)
    taken.append("html_tag")
    for m in tags:
        page.text(_entities(text[at : m.start()], taken))
        at = m.end()
        (page.end(m.group(2).lower()) if m.group(1) else page.start(m.group(2).lower(), m.group(3) or ""))
    page.text(_entities(text[at:], taken))
    return page.close()


def _heading(level: int, title: str) -> str:
    title = title.strip()
    return f"\n{title}\n{('=' if level < 3 else '-') * max(3, len(title))}\n" if title else ""


_KEEP = re.compile("\x00(\\d+)\x00")


_RULE = re.compile(r"[|:\s-]*-{3,}[|:\s-]*")


def _tables(text: str) -> str:
    """Pipe tables and wiki tables to aligned columns."""
    out: list[str] = []
    rows: list[list[str]] = []
    wiki = ruled = False

    def flush() -> None:
        nonlocal wiki, ruled, rows
        out.extend(table_lines(rows))
        wiki, ruled, rows = False, False, []

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("{|"):
            flush()
            wiki, rows = True, [[]]
        elif s.startswith("|}"):
            flush()
            out += [s[2:].strip()] if s[2:].strip() else []
        elif s.startswith("|-"):
            wiki = wiki or not s.endswith("|")
            rows.append([])
        elif wiki and s.startswith("|+"):
            out.append(s[2:].strip())
        elif s and (wiki and s[0] in "|!" or s[0] == "!" and "!!" in s):
            rows = rows or [[]]
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", s[1:])]
        elif wiki and s:  # a stray line inside a table stands before it
            out.append(line)
        elif "|" in s and _RULE.fullmatch(s):
            if out and "|" in out[-1] and not rows:
                rows.append([c.strip() for c in out.pop().strip().strip("|").split("|")])
            ruled = True
        elif len(s) > 1 and s[0] == "|" and s[-1] == "|" or ruled and "|" in s:
            rows.append([c.strip() for c in s.strip("|").split("|")])
        else:
            if rows or wiki or ruled:
                flush()
            out.append(line)
    flush()
    return "\n".join(out)


# Commands of LaTeX by what becomes of their argument.
SECTIONS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
UNSEEN = re.compile(r"(?:cite|label|ref|eqref|index|vspace|hspace)[a-z]*|pageref|usepackage|documentclass|bibliography|includegraphics")
NAMED = {"LaTeX": "LaTeX", "TeX": "TeX", "ldots": "…", "dots": "…", "textbackslash": "\\"}

_TEX = re.compile(
    r"\\begin\{(?P<env>equation|align|displaymath|math)\*?\}(?P<eq>.*?)(?:\\end\{(?P=env)\*?\}|\Z)|\$\$?(?P<math>[^$\n]*[\\^_{][^$\n]*)\$\$?|(?P<mark>\\(?:begin|end)\{[^{}\n]*\}?(?:\[[^\]\n]*\])?)"
    r"|(?P<tie>~?)\\(?P<sign>[&%#_{}$])|(?P<end>\\\\)|(?P<brace>\{?)\\(?P<command>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?[^\S\n]*(?P<open>\{?)|(?P<left>\{)|(?P<right>\})|(?P<line>\n)", re.S
)


def _latex(text: str, keep) -> str:
    """Groups and commands of LaTeX read into a tree and written out; ``keep`` protects formulas."""
    frames: list[tuple[str, list[str]]] = [("", [])]  # what becomes of a group's text, and the text
    at = 0
    link = -1  # end of the address of a link

    def close() -> None:
        what, parts = frames.pop()
        inner = "".join(parts)
        if what == "plain":
            inner = "{" + inner + "}"
        elif what.startswith("head"):
            inner = _heading(int(what[4:]), inner)
        elif what in ("unseen", "address"):
            inner = ""
        frames[-1][1].append(inner)

    for m in _TEX.finditer(text):
        put = frames[-1][1].append
        put(text[at : m.start()])
        at = m.end()
        if m["eq"] is not None:
            put("\n" + keep(m["eq"].strip()) + "\n")
        elif m["math"] is not None:
            put(keep(m["math"].strip()))
        elif m["mark"] is not None:
            put("\n")
        elif m["sign"] is not None:
            put((" " if m["tie"] else "") + keep(m["sign"]))
        elif m["end"] is not None:
            put("\n")
        elif m["command"] is not None:
            name = m["command"]
            if m["brace"]:
                frames.append(("text", []))
            if name == "item":
                parts = frames[-1][1]
                while parts and not parts[-1].strip():
                    parts.pop()
                parts[-1:] = [x.rstrip() for x in parts[-1:]]
                parts.append("\n- ")
            elif name == "paragraph":
                frames[-1][1].append("\n")
            elif name in NAMED:
                frames[-1][1].append(NAMED[name] + (" " if text[at - 1].isspace() else ""))
            if m["open"]:
                frames.append((f"head{SECTIONS[name]}" if name in SECTIONS else "unseen" if UNSEEN.fullmatch(name) else "address" if name == "href" else "text", []))
        elif m["left"] is not None:
            frames.append(("text" if link == m.start() else "plain", []))
        elif m["right"] is not None:
            if len(frames) > 1:
                link = m.end() if frames[-1][0] == "address" else -1
                close()
            else:
                put("}")
        else:
            # A heading or an unseen argument that isn't closed ends with its line.
            while frames[-1][0].startswith(("head", "unseen", "address")):
                close()
            frames[-1][1].append("\n")
    frames[-1][1].append(text[at:])
    while len(frames) > 1:
        if frames[-1][0] == "plain":
            _, parts = frames.pop()
            frames[-1][1].append("{" + "".join(parts))
        else:
            close()
    return "".join(frames[0][1])


def _wiki_links(t: str) -> str:
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)(?:\]\]|(?=\n|\Z))", r"\1", t)
    t = re.sub(r"\[https?://[^\s\]]+ ?([^\]\n]*)(?:\]|(?=\n|\Z))", r"\1", t)
    return re.sub(r"\[\[(?=[^\[\]\s])", "", t)


def _templates(t: str) -> str:
    t = re.sub(r"\{\{\s*(?:cite|citation|ref|reflist)\b[^{}]*\}\}", "", t, flags=re.I)
    t = re.sub(r"\{\{([^{}]*)\}\}", lambda m: "\n" + "; ".join(x.strip().replace("=", ": ") for x in m.group(1).split("|")) + "\n" if "|" in m.group(1) else m.group(1), t)
    t = _tables(re.sub(r"\{\{(?=[^{}\n])|\}\}", "", t))
    return re.sub(r"\{\||^\|[-}]", "", t, flags=re.M)


def _links(t: str) -> str:
    t = re.sub(r"!\[([^\]\n]*)\](?:\([^()\n]*\)|\[\w*\])?", r"\1", t)
    t = re.sub(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?(?:\)|(?=\s|\Z))", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\]\[\w*\]", r"\1", t)
    t = re.sub(r"^\[[^\[\]\n]+\]:\s*\S+.*\n?", "", t, flags=re.M)
    t = re.sub(r"<((?:https?|mailto):[^<>\s]*)>?", r"\1", t)
    return re.sub(r"\]\((?=[^()\s]|$)[^()\s]*\)?", "", t, flags=re.M)


def _bold(t: str) -> str:
    t = re.sub(r"\*\*+(?=\S)([^*\n]*?)(?:\*\*+|(?=\n|\Z))", r"\1", t)
    t = re.sub(r"(?<!\w)__(?=[^\s_])([^\n]*?)(?<=[^\s_])__(?!\w)", r"\1", t)
    return re.sub(r"\*\*+(?=\S)|(?<=\S)\*\*+", "", t)


def _italic(t: str) -> str:
    t = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])", r"\1", t)
    return re.sub(r"(?<![\w/])_(?=[^\s_])([^_\n]*)(?<=[^\s_])_(?!\w)", r"\1", t)


def _bullets(t: str) -> str:
    return re.sub(r"^([ \t]*)[*+][ \t]+(?=\S)", r"\1- ", t, flags=re.M)


def _wiki_quotes(t: str) -> str:
    t = re.sub(r"'{2,5}([^'\n](?:[^\n]*?[^'\n])?)'{2,5}", r"\1", t)
    return re.sub(r"(?<!')'''?(?=[^'\n])|'''(?=[^'\n])", "", t)


def _code(t: str, keep) -> str:
    t = re.sub(r"```[^\n`]*\n?(.*?)(?:```|\Z)", lambda m: "\n" + keep("\n".join("    " + x for x in m.group(1).rstrip("\n").split("\n"))) + "\n", t, flags=re.S)
    t = re.sub(r"^~~~[^\n]*\n?(.*?)(?:^~~~[^\n]*$|\Z)", lambda m: "\n" + keep("\n".join("    " + x for x in m.group(1).rstrip("\n").split("\n"))) + "\n", t, flags=re.S | re.M)
    return re.sub(r"`([^`\n]+)`", lambda m: keep(m.group(1)), t)


#: (kind, a character sequence it needs, rule), in order. A rule takes out at least what its pattern matches.
_RULES = [
    ("md_code", ("`", "~~~"), _code),
    ("latex", ("\\", "$"), _latex),
    ("md_table", ("|",), lambda t, keep: _tables(t)),
    ("wiki_template", ("{{", "{|", "|", "!!"), lambda t, keep: _templates(t)),
    ("md_link", ("](", "![", "][", "]:", "<http", "<mailto"), lambda t, keep: _links(t)),
    ("wiki_link", ("[[", "[http"), lambda t, keep: _wiki_links(t)),
    ("wiki_quote", ("''",), lambda t, keep: _wiki_quotes(t)),
    ("wiki_heading", ("==",), lambda t, keep: re.sub(r"^(={2,6})([^=\n].*?)={2,6}[ \t]*$", lambda m: _heading(len(m.group(1)) - 1, m.group(2)), t, flags=re.M)),
    ("md_heading", ("#",), lambda t, keep: re.sub(r"^ {0,3}(#{1,6})[^\S\n]+(.*?)[ \t]*#*$", lambda m: _heading(len(m.group(1)), m.group(2)), t, flags=re.M)),
    ("md_quote", (">",), lambda t, keep: re.sub(r"^ {0,3}(?:>[ \t]?)+", "", t, flags=re.M)),
    ("md_bold", ("**", "__"), lambda t, keep: _bold(t)),
    ("md_italic", ("*", "_"), lambda t, keep: _italic(t)),
    ("md_strike", ("~~",), lambda t, keep: re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)),
    ("md_list", ("*", "+"), lambda t, keep: _bullets(t)),
]


def take_out(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text of one value and the kinds of markup taken out, in a fixed order; a value without any comes back as it is."""
    if not text:
        return text, []
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    t, taken = fold(text).replace("\x00", ""), []
    for kind, needs, rule in _RULES:
        if any(x in t for x in needs) and _SYNTAX[kind].search(t):
            new = rule(t, keep)
            if new != t:
                taken.append(kind)
                t = new
    while "<" in t or "&" in t or "-->" in t:  # escaped tags become tags
        before = len(taken)
        t = render_html(t, taken)
        if len(taken) == before:
            break
    if not taken:
        return text, []
    t = _bullets(t)
    while _KEEP.search(t):
        t = _KEEP.sub(lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else "", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", t)).strip("\n"), sorted(set(taken))


def render(text: str | None) -> str | None:
    """Clean text of one value."""
    return take_out(text)[0]


_FOUND = T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])


@F.pandas_udf(_FOUND)
def _rendered(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in values:
        done = [take_out(x) for x in s]
        yield pd.DataFrame({"kinds": [k for _, k in done], "clean": [t for t, _ in done]})


def syntax(text: str | None) -> list[str]:
    """Kinds of markup in ``text``."""
    return take_out(text)[1]


def _suspects(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields))
    return df.select(F.col(f"`{key}`").alias(key), F.explode(F.filter(values, lambda v: v["text"].rlike(MAY_HOLD))).alias("v")).select(key, "v.field", "v.text")


def residues(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kinds, clean) of every value that holds markup, rendered."""
    ship(df.sparkSession)
    return _suspects(df, key, fields).withColumn("r", _rendered("text")).where(F.size("r.kinds") > 0).select(key, "field", "r.kinds", "r.clean")


def clean(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``fields`` rendered in place; no shuffle, and only values that may hold markup go to Python."""
    ship(df.sparkSession)
    for f in fields:
        c = F.col(f"`{f}`")
        df = df.withColumn(f, F.when(c.rlike(MAY_HOLD), _rendered(F.when(c.rlike(MAY_HOLD), c))["clean"]).otherwise(c))
    return df
