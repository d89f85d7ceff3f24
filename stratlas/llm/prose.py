"""Sentences of running text: code, markup, formulas, addresses and headings left out."""

from __future__ import annotations

import re
from unicodedata import normalize

TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
HEADING = re.compile(r"\s*(?:#{1,6}\s|={1,6}[^=].*=\s*$|\\(?:sub)*section|\\(?:title|chapter|paragraph)\b|<h[1-6]\b|<title\b|[=~-]{3,}\s*$|\|)", re.I)
TARGET = re.compile(r"\]\([^)\n]*\)|https?://\S+|\]\[[^\]\n]*\]|\[\[(?:Category|File|Image):[^\]\n]*\]\]")
MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]{1,200}\$|\\\(.*?\\\)|\\\[.*?\\\]")
COMMAND = re.compile(r"\\(?:href|cite|ref|label|url|includegraphics)(?:\[[^\]\n]*\])?\{[^}\n]*\}|\\[a-zA-Z]+\*?")
CODE = re.compile(r"`[^`\n]*`|<code\b[^>]*>.*?</code>", re.I)
ENTITY = re.compile(r"&(?:[a-zA-Z]+|#\d+);")
END = re.compile(r"(?<=[.!?…])(?=[\s\"'»)*_]|$)|(?<=[。！？])")
WORD = re.compile(r"[^\W\d_]+")
NOISE = re.compile(r"[\u200b-\u200f\u2060\ufeff]")
LAST = ".!?…。！？"


def sentences(text: str) -> list[str]:
    """The sentences of a text in their order; of a text without any, its headings and other short lines."""
    out: list[str] = []
    short: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = line[:3]
        if fence:
            if mark == fence or (len(fence) > 3 and fence in line):
                fence = ""
            continue
        if mark == "```" or mark == "~~~":
            fence = mark
            continue
        if line[:4] == "    " or line[:1] == "\t" or not line or line.isspace():
            continue
        if "\\begin{" in line or "<pre" in line:
            for begin, end in (("\\begin{verbatim", "\\end{verbatim"), ("\\begin{lstlisting", "\\end{lstlisting"), ("\\begin{equation", "\\end{equation"), ("\\begin{align", "\\end{align"), ("<pre", "</pre>")):
                if begin in line:
                    fence = "" if end in line else end
                    line = line.split(begin)[0]
        if HEADING.match(line):
            short.append(TAG.sub(" ", line) if "<" in line else line)
            continue
        if "\u200b" in line or "\ufeff" in line or "\u200d" in line:
            line = NOISE.sub("", line)
        if "`" in line or "<code" in line:
            line = CODE.sub(" ", line)
        if "<" in line:
            line = TAG.sub(" ", line)
        if "&" in line:
            line = ENTITY.sub(" ", line)
        if "]" in line or "://" in line:
            line = TARGET.sub(" ", line)
        if "$" in line or "\\" in line:
            line = COMMAND.sub(" ", MATH.sub(" ", line))
        for part in END.split(line):
            part = part.strip(" \t\r*_'\"»«>)-")
            if part:
                if not part.isascii():
                    part = normalize("NFKC", part)  # letters made of several signs, or of mathematical ones, as one plain letter
                (out if part[-1] in LAST or part.count(" ") >= 8 else short).append(part)
    return out or short
