"""Markup in text documents (problem 6): HTML, Markdown, wiki and LaTeX to plain text that keeps its structure.

HTML goes through the standard library's streaming parser; each line of what comes out has a text-to-tag ratio, which
is smoothed with a Gaussian and split by a threshold, so that runs of tags without text (menus, footers) fall away.
Headings come out as ``# …``, list items as ``- …`` or ``1. …``, indented by their depth, table rows with bars, code in
fences or backticks and formulas between dollar signs. The sorts of markup a text held are those that the conversion
took out: HTML is what the parser reports as known tags, comments and entities, and every other converter reports
what it replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm import residue
from stratlas.llm.residue_rules import TAGS
from stratlas.session import materialise, read

KINDS = ("html", "markdown", "wiki", "latex")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "title"))
BLOCKS = HEADINGS | frozenset("p div ul ol li table tr td th section article header footer nav main aside blockquote center details summary dl dt dd figure hr br body html head".split())
FORMATS = frozenset("b code em i kbd mark q s samp small strong sub sup u var".split())  # these don't count against a line's text
HIDDEN = frozenset(("script", "style", "svg"))
#: LaTeX commands that mark up running text, and those of formulas.
COMMANDS = (
    "section subsection subsubsection paragraph chapter part title author date emph textbf textit texttt textsc textsf underline href url cite "
    "citep citet ref eqref label item caption footnote includegraphics documentclass usepackage maketitle begin end input include newcommand centering"
)
FORMULA_COMMANDS = "alpha beta gamma delta epsilon lambda mu pi sigma theta omega frac sqrt sum prod int leq geq neq cdot times infty partial mathbb mathcal mathrm left right"
FORMULA_COMMAND = re.compile(r"(?<![\w:\\])\\(?:" + "|".join(FORMULA_COMMANDS.split()) + r")(?![a-zA-Z])")
COMMAND = re.compile(r"(?<![\w:\\])\\(?:" + "|".join(COMMANDS.split()) + r")\*?(?![a-zA-Z])(?:\[[^\]\n]*\])?")
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(?=[^\n]*[\\^_=+<>])(.+?)\\\]|\\\((.+?)\\\)", re.S)
INLINE = re.compile(r"(?<![\w$\\])\$(?=[^\s$])((?:[^$\n]*(?:\\[a-zA-Z]|[\^_=])[^$\n]*?|[a-zA-Z]))(?<!\s)\$(?![\w$])")
FENCE = re.compile(r" {0,3}(```+|~~~+)(.*)$")
HASH = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*?)[ \t#]*$")
UNDER = re.compile(r" {0,3}(?:={3,}|-{3,})[ \t]*$")
RULE_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
PIPE_ROW = re.compile(r"[ \t]*\|[^|].*\|[ \t]*$")
QUOTE = re.compile(r" {0,3}>[ \t]?(?=\S)")
LINK_DEF = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]+\S+.*$")
IMAGE = re.compile(r"!\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])")
LINKED_IMAGE = re.compile(r"\[!\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])\](?:\([^)\n]*\)|\[[^\]\n]*\])")
LINK = re.compile(r"(?<![\w\]\[])\[([^\[\]\n]+)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\[\]\n]*\])(?!\])")
AUTO = re.compile(r"<((?:https?|mailto):[^<>\s]+)>")
CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
STRONG = re.compile(r"\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*|(?<![\w.])__(?=[^\s_])((?:(?!__).)+?)(?<=[^\s_])__(?![\w(])")
EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
STRIKE = re.compile(r"(?<![~\w])~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
BOX = re.compile(r"[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+")
DUNDER = frozenset("init main name file all doc dict class str repr call iter next enter exit new del len getitem setitem version".split())
WIKI_HEAD = re.compile(r"(={1,6})[ \t]*([^=\s](?:[^=\n]*[^=\s])?)[ \t]*\1[ \t]*$")
WIKI_LINK = re.compile(r"(?<![\w\[])\[\[(?=[^\W\d_]|:|#)([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_BOLD = re.compile(r"(?<!')('{2,3}|'{5})(?![\s'])([^'\n]+(?:'[^'\n]+)*?)(?<!\s)\1(?!')")
WIKI_TABLE = re.compile(r"\{\||\|\}|\|-[^|]*$|\|\+")
WIKI_NEXT = re.compile(r"\|\||!!")
WIKI_CELL = re.compile(r"^[ \t]*(?:[a-z]+=(?:\"[^\"]*\"|\w+)[ \t]*)+\|(?!\|)")
WIKI_TEMPLATE = re.compile(r"\{\{(?!\{)[^{}\n|]+\|[^{}\n]*\}\}|<ref\b[^>]*>|__(?:TOC|NOTOC|FORCETOC)__|^#REDIRECT\b", re.I)
WIKI_SURE = re.compile(r"^={2,6}[^=\n]+={2,6}[ \t]*$|'''|\[\[[^\W\d_]", re.M)
LIST_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]+")
ANY = re.compile(r"[<&*_`#\[|\\$=~>]|''|-{3}|\{\{")
MARK, HEAD, SPAN = "\x00", "\x01", "\x02"  # what was put aside; a heading made from other markup; code inside a line of HTML
#: Tags that stand right behind a letter; behind one, others are types (``list<int>``).
BEHIND = frozenset("a b br em i li p strong sub sup td".split())


class Reader(HTMLParser):
    """Parser events to lines of structured text, with each line's number of tags; ``events`` counts the markup seen."""

    RCDATA_CONTENT_ELEMENTS = ()  # an unclosed title must not swallow the text

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.low = text.lower()
        self.hides = {t for t in HIDDEN if f"</{t}" in self.low}  # without its end a tag hides nothing
        self.CDATA_CONTENT_ELEMENTS = tuple(t for t in ("script", "style") if t in self.hides)
        self.starts = [0]
        for at, sign in enumerate(text):
            if sign == "\n":
                self.starts.append(at + 1)
        self.text = text
        self.lines: list[list] = [["", 0, False]]  # text, tags, structural
        self.hidden = self.pre = self.events = 0
        self.lists: list[int] = []  # the open lists' last numbers, -1 where they have none
        self.rows = 0  # open table rows

    def _at(self) -> int:
        line, offset = self.getpos()
        return self.starts[line - 1] + offset

    def _break(self) -> None:
        if self.rows:  # a row's cells stay in its line
            if self.lines[-1][0][-1:].strip():
                self.lines[-1][0] += " "
        elif self.lines[-1][0].strip() or self.lines[-1][1]:
            self.lines.append(["", 0, False])

    def _is_type(self, tag: str) -> bool:
        at = self._at()
        behind = at > 0 and (self.text[at - 1].isalnum() or self.text[at - 1] == "_")
        return behind and tag not in BEHIND and self.low.find(f"</{tag}", at) < 0

    def _structural(self, text: str) -> None:
        self.lines[-1][0] += text
        self.lines[-1][2] = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        if tag not in TAGS or self._is_type(tag):
            self.handle_data(raw)
            return
        self.events += 1
        if tag in self.hides:
            self.hidden += tag != "svg" or not raw.endswith("/>")
            return
        if self.pre and tag not in ("pre", "code"):
            return
        if tag == "pre":
            self._break()
            self._structural("```\n")
            self.pre += 1
        elif tag == "code" and not self.pre:
            self.lines[-1][0] += SPAN
        elif tag == "tr":
            self.rows = 0
            self._break()
            self._structural("")
            self.rows = 1
        elif tag in ("td", "th") and self.rows:
            if self.lines[-1][0].strip():
                self.lines[-1][0] = self.lines[-1][0].rstrip() + " | "
        elif tag in ("ul", "ol"):
            self._break()
            self.lists.append(0 if tag == "ol" else -1)
        elif tag in BLOCKS:
            self._break()
            if tag in HEADINGS and not self.rows:
                self._structural(HEAD * (int(tag[1]) if tag[1:].isdigit() else 1) + " ")
            elif tag == "li":
                if self.lists and self.lists[-1] >= 0:
                    self.lists[-1] += 1
                number = f"{self.lists[-1]}. " if self.lists and self.lists[-1] > 0 else "- "
                self._structural("  " * max(0, len(self.lists) - 1) + number)
        self.lines[-1][1] += tag not in FORMATS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in self.hides:
            self.events += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in TAGS:
            self.handle_data(f"</{tag}>")
            return
        self.events += 1
        if tag in self.hides:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.lines[-1][0] = self.lines[-1][0].rstrip("\n") + "\n```"
            self.lines.append(["", 0, False])
        else:
            self.lines[-1][1] += tag not in FORMATS
            if tag == "code" and not self.pre:
                self.lines[-1][0] += SPAN
            elif tag in ("tr", "table", "thead", "tbody"):
                self.rows = 0
                self._break()
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self._break()
            elif tag in BLOCKS and not self.pre and tag not in ("td", "th"):
                self._break()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.pre:
            self.lines[-1][0] += data
            return
        if self.rows:
            self.lines[-1][0] += " ".join(data.split("\n")) if data.strip() else ""
            return
        first, *more = data.split("\n")
        self.lines[-1][0] += first
        for line in more:
            self.lines.append([line, 0, False])

    def _reference(self, name: str) -> None:
        ends = self.text[self._at() + 1 + len(name) :][:1] == ";"
        if ends and (name[0] == "#" or name + ";" in html5):
            self.events += 1
            self.handle_data(unescape(f"&{name};"))
        else:
            self.handle_data(f"&{name}" + ";" * ends)

    def handle_entityref(self, name: str) -> None:
        self._reference(name)

    def handle_charref(self, name: str) -> None:
        self._reference(f"#{name}")

    def handle_comment(self, data: str) -> None:
        # what isn't a comment by its own marks comes here too, and is kept
        if self.text.startswith("<!--", self._at()):
            self.events += 1
        else:
            self.handle_data(self.text[self._at() : self._at() + 2] + data + ">")

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.events += 1
        else:
            self.handle_data(f"<!{decl}>")

    def handle_pi(self, data: str) -> None:
        self.handle_data(f"<?{data}>")

    def unknown_decl(self, data: str) -> None:
        self.handle_data(f"<![{data}]>")


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Values under a Gaussian of ``sigma`` lines."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def two_means(values: np.ndarray, rounds: int = 20) -> float:
    """Midway between the means of the two clusters that the values fall into."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        upper = values > (low + high) / 2
        if upper.all() or not upper.any():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return (low + high) / 2


def content_regions(lines: list[list]) -> list[str]:
    """The lines of content: those whose smoothed text-to-tag ratio reaches the threshold, and all structural ones.

    The smoothed ratios are clustered in two, and the threshold lies midway between the clusters' means. A line of few
    tags and a sentence never fall away.
    """
    texts = [t for t, _, _ in lines]
    ratio = np.array([len(t.strip()) / max(1, n) for t, n, _ in lines], float)
    soft = smoothed(ratio)
    least = two_means(soft)
    keep = []
    for (text, tags, structural), r in zip(lines, soft):
        bare = text.strip()
        thin = tags >= 4 and r < least and not re.search(r"[.!?。！？]$", bare)
        keep.append(structural or not thin)
    return [t for t, k in zip(texts, keep) if k]


def from_html(text: str) -> tuple[str, bool]:
    """The text without HTML, and whether the parser met any; types such as ``list<int>`` and comparisons are none."""
    reader = Reader(text)
    try:
        reader.feed(text)
        reader.close()
    except (AssertionError, ValueError):
        return text, False
    return ("\n".join(content_regions(reader.lines)), True) if reader.events else (text, False)


def convert(text: str) -> tuple[str, list[str]]:
    """``(clean text, kinds)``: the text without markup, its structure kept, and the sorts of markup it held."""
    if MARK in text or HEAD in text or SPAN in text:
        text = text.replace(MARK, "").replace(HEAD, "").replace(SPAN, "")
    if not ANY.search(text):
        return text, []
    kinds: set[str] = set()
    out: list[str] = []
    plain: list[str] = []
    wiki = bool(WIKI_SURE.search(text))

    def flush() -> None:
        if plain:
            out.extend(convert_plain("\n".join(plain), kinds, wiki).split("\n"))
            plain.clear()

    fence = ""
    verbatim = pre = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        match = None if verbatim or pre or ("`" not in line and "~" not in line) else FENCE.match(line)
        if fence:
            if match and match.group(1).startswith(fence) and not match.group(2).strip():
                out.append("```")
                fence = ""
            else:
                out.append(line)
        elif verbatim:
            verbatim = "\\end{verbatim}" not in line and "\\end{lstlisting}" not in line
            out.append("```" if not verbatim else line)
        elif match and "`" not in match.group(2):
            flush()
            kinds.add("markdown")
            fence = match.group(1)[:3]
            out.append("```" + match.group(2).strip())
        elif line.startswith(("\\begin{verbatim}", "\\begin{lstlisting}")):
            flush()
            kinds.add("latex")
            verbatim = True
            out.append("```")
        elif not pre and line.startswith(("    ", "\t")) and indented_code(line) and not "".join(plain[-1:]).strip():
            flush()
            out.append(line)
        else:
            if "<pre" in line:
                pre = True
            if "</pre>" in line:
                pre = False
            plain.append(line)
    flush()
    if fence or verbatim:
        out.append("```")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip(), [k for k in KINDS if k in kinds]


def indented_code(line: str) -> bool:
    """Whether an indented line after a blank or another such line is code: not blank, no list item, no tag."""
    bare = line.strip()
    return bool(bare) and not bare.startswith("<") and not LIST_ITEM.match(line)


def convert_plain(text: str, kinds: set[str], wiki: bool) -> str:
    """Text outside fences: code spans and formulas are put aside, then tags, wiki, LaTeX and Markdown marks go."""
    kept: list[str] = []

    def aside(value: str) -> str:
        kept.append(value)
        return f"{MARK}{len(kept) - 1}{MARK}"

    def put(kind: str, value: str) -> str:
        kinds.add(kind)
        return value

    if "`" in text and "<pre" not in text:
        text = CODE.sub(lambda m: put("markdown", aside(f"`{m.group(2).strip()}`")), text)
    if "$$" in text or "\\[" in text or "\\(" in text:
        text = DISPLAY.sub(lambda m: put("latex", aside(f"${next(g for g in m.groups() if g).strip()}$")), text)
    if "$" in text:
        text = INLINE.sub(lambda m: put("latex", aside(f"${m.group(1)}$")), text)
    if "\\" in text and re.search(r"\\[a-zA-Z]", text):
        text = from_latex(text, kinds, aside)
    if "<" in text:
        text = AUTO.sub(lambda m: put("markdown", m.group(1)), text)
    if "<" in text or "&" in text:
        text, html = from_html(text)
        if html:
            kinds.add("html")
            text = re.sub(r"```\n.*?\n```", lambda m: aside(m.group()), text, flags=re.S)
            text = re.sub(f"{SPAN}([^{SPAN}\n]*){SPAN}", lambda m: aside(f"`{m.group(1).strip()}`") if m.group(1).strip() else "", text).replace(SPAN, "")
    lines: list[str] = []
    table = False  # inside a wiki table
    for line in text.split("\n"):
        bare = line.strip()
        if table and bare[:1] in ("|", "!") and not WIKI_TABLE.match(bare):
            lines.append(" | ".join(WIKI_CELL.sub("", c).strip() for c in WIKI_NEXT.split(bare[1:])))
            continue
        table = (table or bare.startswith("{|")) and not bare.startswith("|}")
        new = from_line(line, lines, kinds, wiki)
        if new is not None:
            lines.append(new)
    text = "\n".join(lines)
    if "''" in text:
        text = WIKI_BOLD.sub(lambda m: put("wiki", m.group(2)), text)
    if "[[" in text:
        text = WIKI_LINK.sub(lambda m: put("wiki", "" if m.group(1).lower().startswith(("category:", "file:", "image:")) else m.group(2) or m.group(1)), text)
    if "{{" in text or "__" in text or "<ref" in text:
        text = WIKI_TEMPLATE.sub(lambda m: put("wiki", ""), text)
    if "]" in text:
        text = LINKED_IMAGE.sub(lambda m: put("markdown", ""), text)
        text = IMAGE.sub(lambda m: put("markdown", m.group(1)), text)
        text = LINK.sub(lambda m: put("markdown", m.group(1)), text)
    if "**" in text or "__" in text:
        text = STRONG.sub(lambda m: m.group() if m.group(2) in DUNDER else put("markdown", m.group(1) or m.group(2)), text)
    if "*" in text or "_" in text:
        text = EMPHASIS.sub(lambda m: put("markdown", m.group(1) or m.group(2)), text)
    if "~~" in text:
        text = STRIKE.sub(lambda m: put("markdown", m.group(1)), text)
    while MARK in text:
        text = re.sub(f"{MARK}(\\d+){MARK}", lambda m: kept[int(m.group(1))], text)
    return text.replace(HEAD, "#")


def from_latex(text: str, kinds: set[str], aside) -> str:
    """LaTeX's sections, lists, environments and commands."""

    def equation(match: re.Match) -> str:
        kinds.add("latex")
        return aside(f"${match.group(2).strip()}$")

    text = re.sub(r"\\begin\{(equation|align|displaymath|gather|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", equation, text, flags=re.S)
    if FORMULA_COMMAND.search(text):
        kinds.add("latex")
    if not COMMAND.search(text):
        return text
    kinds.add("latex")
    text = re.sub(r"\\(?:chapter|section|part|title)\*?\{([^{}\n]*)\}", HEAD + r" \1", text)
    text = re.sub(r"\\subsection\*?\{([^{}\n]*)\}", HEAD * 2 + r" \1", text)
    text = re.sub(r"\\(?:subsubsection|paragraph)\*?\{([^{}\n]*)\}", HEAD * 3 + r" \1", text)
    text = from_lists(text)
    text = re.sub(r"~?\\(?:cite[pt]?|ref|eqref|label|includegraphics)(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = re.sub(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}", r"\1", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*", "", text)
    text = re.sub(r"\\(?:documentclass|usepackage)(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    for _ in range(3):
        text = re.sub(r"\\(?:emph|text[a-z]{2}|underline|url|caption|footnote|author|date)\{([^{}\n]*)\}", r"\1", text)
    return re.sub(r"\\(?:maketitle|centering)\b", "", text)


LATEX_LIST = re.compile(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?[ \t]*|\\item\b[ \t]*")


def from_lists(text: str) -> str:
    """LaTeX's lists: items with dashes or, in an enumeration, numbers, indented by their depth."""
    open_: list[int] = []

    def mark(match: re.Match) -> str:
        if match.group(1) == "begin":
            open_.append(0 if match.group(2) == "enumerate" else -1)
        elif match.group(1) == "end":
            if open_:
                open_.pop()
        elif open_ and open_[-1] >= 0:
            open_[-1] += 1
            return "  " * (len(open_) - 1) + f"{open_[-1]}. "
        else:
            return "  " * max(0, len(open_) - 1) + "- "
        return ""

    return LATEX_LIST.sub(mark, text)


def from_line(line: str, before: list[str], kinds: set[str], wiki: bool) -> str | None:
    """One line's block marks; None drops the line."""
    if not line:
        return line
    head = line.lstrip()[:1]
    if head == "#":
        match = HASH.match(line)
        if match and not (wiki and match.group(2)[-1] in ".。" and len(match.group(1)) == 1):
            kinds.add("markdown")
        return line
    if head == "=":
        match = WIKI_HEAD.match(line)
        if match and (len(match.group(1)) > 1 or " " in line):
            kinds.add("wiki")
            return "#" * len(match.group(1)) + " " + match.group(2)
    if head in "=-" and UNDER.match(line) and before and before[-1].strip() and not LIST_ITEM.match(before[-1]):
        kinds.add("markdown")
        before[-1] = "# " + before[-1].strip()
        return None
    if head == ">":
        match = QUOTE.match(line)
        if match:
            kinds.add("markdown")
            return line[match.end() :]
    if head in "|:-" and RULE_ROW.match(line):
        kinds.add("markdown")
        return None
    if head in "{|" and WIKI_TABLE.match(line):
        kinds.add("wiki")
        return None
    if head == "|" and PIPE_ROW.match(line) and "||" not in line:
        kinds.add("markdown")
        return " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
    if head == "[" and LINK_DEF.match(line):
        kinds.add("markdown")
        return None
    if BOX.match(line):
        kinds.add("markdown")
        return BOX.sub("- ", line)
    return line


CONVERTED = "origin string, row_id long, kinds array<string>, clean string, source string, parts " + residue.PARTS


def converted(texts: DataFrame, with_text: bool) -> DataFrame:
    """One pass over texts: what each converts to, the markup found, and its residue signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                origin, ids, names, source, text = (batch.column(i) for i in range(5))
                rows = text.to_pylist()
                done = [convert(t) for t in rows]
                marks = [
                    None if o == "readme_raw" else residue.signature(t, n) for o, t, n in zip(origin.to_pylist(), rows, names.to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        origin, ids, pa.array([k for _, k in done], pa.list_(pa.string())),
                        pa.array([c if with_text else None for c, _ in done], pa.string()), source,
                        pa.array(marks, residue.ARROW_PARTS),
                    ],
                    names=["origin", "row_id", "kinds", "clean", "source", "parts"],
                )

    return texts.select("origin", "row_id", "name", "source", "text").mapInArrow(run, CONVERTED)


ORIGINS = ("clean_text", "readme_raw", "documents")


def cleaned(repo: DataFrame, documents: DataFrame, with_text: bool = True) -> DataFrame:
    """``(origin, row_id, kinds, clean)`` of every non-blank text of the three origins that isn't residue.

    A repository's ``readme_raw`` counts as residue where its ``clean_text`` does. Code is kept as it is.
    """
    rows = materialise(converted(residue.texts_of(repo, documents, ORIGINS), with_text), "markup-converted")
    waste = residue.residue_of(rows.where("parts is not null"))
    both = waste.unionByName(waste.where("origin = 'clean_text'").withColumn("origin", F.lit("readme_raw")))
    return rows.select("origin", "row_id", "kinds", "clean").join(both, ["origin", "row_id"], "left_anti")


def found(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaned(read(spark, sf, "repo"), read(spark, sf, "documents"), with_text=False)
    return rows.select("origin", "row_id", F.explode("kinds").alias("markup")).distinct()
