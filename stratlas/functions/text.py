"""Cleaning of project pages into capability text, one document at a time or as column expressions."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings whose sections say nothing about what a project can do.
STOP_HEADINGS = frozenset(
    [
        "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "author", "authors", "backers", "badges", "build", "building",
        "building from source", "changelog", "change log", "citation", "cite", "citing", "code of conduct", "community", "contact", "contents",
        "contribute", "contributing", "contribution", "contributions", "contributors", "credits", "dependencies", "development", "developing",
        "donate", "donating", "donation", "donations", "documentation", "docs", "download", "downloads", "faq", "funding", "getting help", "help",
        "install", "installation", "installing", "license", "licence", "licensing", "links", "maintainers", "notes", "prerequisites",
        "cloning", "community integrations", "ecosystem", "integrations", "projects using", "related", "related projects", "release notes", "releases",
        "showcase", "used by", "who uses", "requirements", "resources", "roadmap", "security", "setup", "sponsor", "sponsors", "sponsorship",
        "star history", "stargazers", "support", "supported platforms", "table of contents", "testing", "tests", "thanks", "toc", "troubleshooting",
    ]
)
#: Hosts that serve badges (patterns).
BADGE_HOSTS = (
    "img.shields.io", "badge.fury.io", "travis-ci", "circleci.com", "codecov.io", "coveralls.io", "appveyor.com", "badgen.net", "pepy.tech", "readthedocs.org", "snyk.io",
    "codeclimate.com", "opencollective.com", "herokucdn.com", "gitpod.io", "deepsource.io", "bestpractices.coreinfrastructure.org", "isitmaintained.com",
    "githubusercontent.com/.*badge", "sonarcloud.io", "codefactor.io",
)
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ATX = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)\s*$")
LINKED = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+.*(?:\]\(|\]\[|https?://)")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
SCRIPTS = re.compile("[Ѐ-ӿ؀-ۿ぀-ヿ㐀-鿿가-힯]")


class Cleaned(NamedTuple):
    """A page's capability text and how it came out."""

    clean_text: str
    low_signal: bool
    non_english: bool
    reduction: float
    dropped: list[str]


def strip_badges(text: str) -> str:
    text = re.sub(r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", "", text)
    text = re.sub(r"!\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])", "", text)
    hosts = "|".join(BADGE_HOSTS)
    return re.sub(rf"\[[^\]]*\]\([^)]*(?:{hosts})[^)]*\)", "", text)


def strip_html(text: str) -> str:
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = re.sub(r"<(script|style|svg)\b.*?(?:</\1\s*>|\Z)", "", text, flags=re.S | re.I)
    text = re.sub(r"<br\s*/?>", "\n", text, flags=re.I)
    return re.sub(r"</?[a-zA-Z][^<>]*>", "", text)


def lines_of(text: str) -> list[tuple[str, bool]]:
    """Lines with whether each is code; a fence that isn't closed runs to the end."""
    out, fence = [], ""
    for line in text.split("\n"):
        match = FENCE.match(line)
        if fence:
            out.append((line, True))
            if match and match.group(1)[0] == fence[0] and len(match.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif match:
            fence = match.group(1)
            out.append((line, True))
        else:
            out.append((line, False))
    return out


def heading_key(text: str) -> str:
    """A heading to compare: no links, anchors, emoji codes or punctuation; lower case."""
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"<[^>]*>|:[a-z0-9_+-]+:|\{#[^}]*\}", " ", text)
    return re.sub(r"[\W_]+", " ", text).strip().lower()


def is_stop(key: str) -> bool:
    """A stop phrase itself, or one followed by more words."""
    return key in STOP_HEADINGS or any(key.startswith(p + " ") for p in STOP_HEADINGS)


def sections(text: str) -> list[tuple[int, str, list[tuple[str, bool]]]]:
    """``(level, heading, lines)``; the part before the first heading has level 0. ATX and underlined headings count."""
    out: list[tuple[int, str, list[tuple[str, bool]]]] = [(0, "", [])]
    for line, code in lines_of(text):
        match = None if code else ATX.match(line)
        if match:
            out.append((len(match.group(1)), match.group(2), []))
            continue
        under = None if code else UNDERLINE.match(line)
        body = out[-1][2]
        if under and body and not body[-1][1] and body[-1][0].strip() and not ITEM.match(body[-1][0]) and (len(under.group(1)) > 2 or under.group(1)[0] == "="):
            title = body.pop()[0].strip()
            out.append((1 if under.group(1)[0] == "=" else 2, title, []))
            continue
        body.append((line, code))
    return out


def family(parts: list[tuple[int, str, list[tuple[str, bool]]]], i: int) -> list[list[tuple[str, bool]]]:
    """The lines of a section and of the sections under it."""
    end = i + 1
    while end < len(parts) and parts[end][0] > parts[i][0]:
        end += 1
    return [lines for _, _, lines in parts[i:end]]


def is_link_dump(lines: list[tuple[str, bool]]) -> bool:
    items = [t for t, code in lines if not code and ITEM.match(t)]
    return len(items) >= 6 and sum(bool(LINKED.match(t)) for t in items) >= 0.7 * len(items)


def without_long_code(lines: list[tuple[str, bool]], most: int = 5) -> list[str]:
    out: list[str] = []
    block: list[str] = []
    for text, code in [*lines, ("", False)]:
        if code:
            block.append(text)
            continue
        if block:
            inner = [t for t in block if not FENCE.match(t)]
            if sum(bool(t.strip()) for t in inner) <= most:
                out += inner
            block = []
        out.append(text)
    return out[:-1]


def flatten_links(text: str) -> str:
    text = re.sub(r"^ {0,3}\[[^\]]+\]:\s*\S+.*$", "", text, flags=re.M)
    text = re.sub(r"\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])", r"\1", text)
    text = re.sub(r"(?<![\w\]])\[([^\[\]\n]+)\](?![(\[:])", r"\1", text)
    return re.sub(r"<?https?://[^\s<>)]+>?", "", text)


def strip_marks(text: str) -> str:
    text = html.unescape(text)
    text = re.sub(r"^ {0,3}#{1,6}\s*", "", text, flags=re.M)
    for _ in range(2):
        text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
        text = re.sub(r"(?<![\w*_])([*_])(?=\S)([^*_\n]+?)(?<=\S)\1(?![\w*_])", r"\2", text)
    return re.sub(r"`([^`\n]*)`", r"\1", text)


def tidy(text: str) -> str:
    kept = []
    for line in text.split("\n"):
        line = re.sub(r":[a-z0-9_+-]+:", "", line).rstrip()
        bare = line.strip()
        if bare and (re.fullmatch(r"[-*_\s]{3,}", bare) or bare.startswith("|") or not any(c.isalpha() for c in bare)):
            continue
        kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def truncate(text: str, most: int = 6000) -> str:
    """At most ``most`` characters, cut at a paragraph, else a sentence, else a word, if it leaves 60 %."""
    if len(text) <= most:
        return text
    head, floor = text[:most], int(most * 0.6)
    for marks, keep in ((("\n\n",), 0), ((". ", ".\n", "! ", "? "), 1), ((" ",), 0)):
        at = max(head.rfind(mark) for mark in marks)
        if at >= floor:
            return head[: at + keep].rstrip()
    return head.rstrip()


def is_non_english(text: str) -> bool:
    """At least 40 letters, over a quarter of them of other scripts than the Latin."""
    letters = sum(c.isalpha() for c in text)
    return letters >= 40 and len(SCRIPTS.findall(text)) > 0.25 * letters


def clean_readme(raw: str | None, description: str | None = None, most: int = 6000) -> Cleaned:
    """A page to capability text: no badges, tags, stop sections, link dumps, long code, links or marks.

    Null and empty pages give empty text. Sections under a stop heading go until a heading of the same or a
    higher level, link dumps with the sections under them, whose lines count too. Text and description both under 120 characters make it low signal.
    """
    raw = raw or ""
    text = strip_html(strip_badges(raw.replace("\r\n", "\n").replace("\r", "\n")))
    kept: list[str] = []
    dropped: list[str] = []
    left: list[tuple[int, str, list[tuple[str, bool]]]] = []
    stop = 0
    for level, title, lines in sections(text):
        if stop and level and level <= stop:
            stop = 0
        key = heading_key(title)
        if not stop and level and is_stop(key):
            stop = level
        if stop:
            if level and key and key not in dropped:
                dropped.append(key)
            continue
        left.append((level, title, lines))
    inside = 0  # the level of the link dump that the section is in
    for i, (level, title, lines) in enumerate(left):
        if inside and level <= inside:
            inside = 0
        if level and is_link_dump([x for part in family(left, i) for x in part]):
            inside = inside or level
            key = heading_key(title)
            if key and key not in dropped:
                dropped.append(key)
        if inside:
            continue
        if level:
            kept.append(title)
        kept += without_long_code(lines)
    text = truncate(tidy(strip_marks(flatten_links("\n".join(kept)))), most)
    low = len(text) < 120 and len((description or "").strip()) < 120
    return Cleaned(text, low, is_non_english(text), round(1 - len(text) / len(raw), 4) if raw else 0.0, dropped)


CLEANED = "clean_text string, low_signal boolean, non_english boolean, reduction double, dropped array<string>"


def cleaned(raw: Column, description: Column) -> Column:
    """``clean_readme`` over Arrow batches."""

    @F.pandas_udf(CLEANED)
    def run(raw: pd.Series, description: pd.Series) -> pd.DataFrame:
        rows = [clean_readme(r, d) for r, d in zip(raw, description)]
        return pd.DataFrame(rows, columns=Cleaned._fields)

    return run(raw, description)


def embedding_input(full_name: Column, description: Column, language: Column, topics: Column, text: Column) -> Column:
    """``name — description``, a line of language and up to 12 topics, then the text; empty parts fall away."""
    head = F.concat_ws(" — ", full_name, F.nullif(F.trim(description), F.lit("")))
    lang = F.concat(F.lit("Language: "), F.nullif(F.trim(language), F.lit("")), F.lit("."))
    tags = F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice(topics, 1, 12), ", "), F.lit(".")))
    line = F.nullif(F.concat_ws(" ", lang, tags), F.lit(""))
    return F.concat_ws("\n", head, line, F.nullif(F.trim(text), F.lit("")))


def clamped(text: Column, most: int = 6500) -> Column:
    """At most ``most`` characters, at a word's end if that leaves 90 %."""
    head = F.substring(text, 1, most)
    last = F.lit(most) - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).when((F.instr(head, " ") > 0) & (last > most * 0.9), F.substring(head, F.lit(1), last)).otherwise(head)


def non_english(text: Column) -> Column:
    """The column form of ``is_non_english`` for one pass in the JVM."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    other = F.regexp_count(text, F.lit(r"[\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"))
    return (letters >= 40) & (other > 0.25 * letters)


def parse_iso(text: Column) -> Column:
    """A timestamp with or without Z; null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def repo_of_url(url: Column) -> Column:
    """``owner/name`` of a code host's address with exactly two path parts; else null."""
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    return F.nullif(F.regexp_extract(bare, r"^(?:https?://)?(?:www\.)?github\.com/([^/\s]+/[^/\s]+)$", 1), F.lit(""))


def chosen_readme(entries: Column) -> Column:
    """Of ``array<struct<name, text, mode>>`` the longest real text: symlinks and one-line paths are none."""
    real = F.filter(entries, lambda e: (e["mode"] != 0o120000) & e["text"].isNotNull() & ~((F.length(e["text"]) < 200) & ~e["text"].contains("\n") & ~e["text"].contains(" ")))
    return F.array_max(F.transform(real, lambda e: F.struct(F.length(e["text"]).alias("size"), e["name"].alias("name"), e["text"].alias("text"))))
