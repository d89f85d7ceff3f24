from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratlas.llm import language as L
from stratlas.llm import markup as M
from stratlas.llm import residue
from stratlas.llm.prose import sentences
from stratlas.llm.residue_rules import read_text

SAID = {
    "en": "The parser reads large files and keeps memory low. You can replace the cache with your own when it is not enough.",
    "de": "Der Parser liest große Dateien und braucht wenig Speicher. Sie können den Zwischenspeicher ersetzen, wenn er nicht reicht.",
    "fr": "L'analyseur lit des fichiers volumineux et utilise peu de mémoire. Vous pouvez remplacer le cache si celui-ci ne suffit pas.",
    "es": "El analizador lee archivos grandes y usa poca memoria. Usted puede cambiar la caché si no es suficiente para la tarea.",
    "ru": "Анализатор читает большие файлы и занимает мало памяти. Можно заменить кэш, если его не хватает.",
    "zh": "解析器可以读取大型文件，占用的内存很少。如果缓存不够用，可以换成自己的实现。",
    "ja": "パーサーは大きなファイルを読み込み、メモリをあまり使いません。キャッシュが足りない場合は置き換えられます。",
}


@pytest.fixture(scope="module")
def tables(spark, data):
    return spark.read.parquet(f"{data}/repo.parquet"), spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return L.sample_model(tables[1])


def langs(model, text):
    return [L.LANGS[int(s.argmax())] for s in L.segments(model.score([sentences(text)])[0])]


@pytest.mark.parametrize("lang", sorted(SAID))
def test_languages_of_other_texts_than_the_sample(model, lang):
    assert langs(model, SAID[lang]) == [lang]


def test_segments_headings_and_code(model):
    text = f"# Usage\n\n{SAID['en']}\n\n```\nder die das und ist nicht\n```\n\n## Verwendung\n\n{SAID['de']} {SAID['zh']}\n\n    the and is of to\n"
    assert langs(model, text) == ["en", "de", "zh"]
    assert langs(model, "## Verwendung\n\n" + SAID["en"] + "\n\nParser: `die der das`") == ["en"]
    assert L.segments(model.score([[]])[0]) == []


def test_labels_in_every_spelling(spark):
    said = ["EN", "en-US", "en_GB", "English", " eng ", "Deutsch", "zh-CN", "zho", "pt-BR", "und", "n/a", "", "-", "unknown", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(L.label_code(F.col("s"))).collect()] == ["en"] * 5 + ["de", "zh", "zh", "pt"] + [None] * 6
    paths = spark.createDataFrame([("docs/fr/x.md",), ("readme.de.md",), ("docs/from/x.md",), (None,)], "s string")
    assert [r[0] for r in paths.select(L.address_code(F.col("s"))).collect()] == ["fr", "de", None, None]


DOC = "doc_id long, repo_id long, full_name string, path string, text string, lang string, source string"
REPO = "id long, host string, full_name string, clean_text string, non_english boolean, readme_raw string"


def test_markup_declares_its_language():
    assert L.markup_language('<html lang="de-AT"><p>x') == "de" and L.markup_language("<html><p lang=fr>") is None and L.markup_language("html lang=de") is None


def test_labels_in_any_spelling(spark):
    said = ["en-US", " EN_gb", "English (US)", "(de)", "Deutsch", "français", "русский", "中文", "日本語", "por", "sv", "-", "", "n/a", "und", None]
    got = [r.c for r in spark.createDataFrame([(x,) for x in said], "l string").select(L.label_code(F.col("l")).alias("c")).collect()]
    assert got == ["en", "en", "en", "de", "de", "fr", "ru", "zh", "ja", "pt", *[None] * 6]


def test_a_foreign_language_is_none_of_the_eleven(model):
    for text in ("이 프로그램은 큰 파일을 빠르게 읽습니다. 메모리를 적게 사용합니다.", "Аналізатор читає великі файли й не потребує багато пам'яті. Кеш можна замінити, якщо його бракує.", "Det här verktyget läser stora filer snabbt och använder lite minne. Du kan byta ut cachen om den inte räcker till."):
        parts = L.segments(model.score([sentences(text)])[0])
        assert len(parts) == 1 and parts[0].argmax() == len(L.LANGS)


def test_letters_in_other_forms_are_the_same_letters():
    import unicodedata

    plain = "Für größere Dateien genügt ein einfacher Aufruf."
    assert sentences(unicodedata.normalize("NFD", plain)) == [plain] and sentences("𝐁𝐨𝐥𝐝 words are words.") == ["Bold words are words."]


def test_a_line_of_names_makes_no_segment(model):
    text = SAID["en"] + "\n\n" + SAID["zh"] + "\n\n[famuda](docs/famuda.md)."
    assert [L.LANGS[p[:11].argmax()] for p in L.segments(model.score([sentences(text)])[0])] == ["en", "zh"]


def test_a_hot_owner_s_prior_leaves_the_text_out(spark):
    """Owners with a third of all rows, null owners and hosts: no row is lost or doubled, and a lone text gets its host's prior."""
    rows = [("documents", i, "hot/x" if i % 3 == 0 else None if i % 3 == 1 else f"o{i}/p", [None, "h", "g"][i % 3], [[float(k == i % 2) for k in range(12)]], None) for i in range(900)]
    read_ = spark.createDataFrame(rows, "origin string, row_id long, owner string, host string, segs array<array<float>>, label string")
    joined, world = L.with_counts(L.with_votes(read_))
    got = joined.select("row_id", "k", L.left_out_prior(world).alias("p")).collect()
    assert len(got) == 900 == len({r.row_id for r in got}) and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    by = {r.row_id: r for r in got}
    assert by[0].k == 0 and abs(by[0].p[0] - by[3].p[1]) < 0.02  # 150 of either language in the hot owner, less the text's own
    assert abs(by[2].p[0] - by[5].p[0]) < 0.02  # an owner of one text says nothing once that text is left out


def test_wrong_missing_and_mixed_labels(spark):
    rows = []
    for i in range(220):
        lang = list(SAID)[i % len(SAID)]
        rows.append((i, i, f"o{i % 40}/p{i}", "a.md", SAID[lang].replace("1", str(i)), lang, "readme"))
    rows += [(900, 1, "o1/p", "a", SAID["de"], "fr", "readme"), (901, 1, None, None, SAID["fr"], None, None), (902, 1, "o/p", "a", SAID["en"] + "\n\n" + SAID["ru"], "en", "wiki"), (903, 1, "o/p", "a", "   ", None, None), (904, 1, "o/p", "a", "v1.2", None, None), (905, 1, "o/p", "a", None, "en", None), (906, 1, "o/p", "a", "404 Not Found\n\nThis page could not be found.", "de", None)]
    docs = spark.createDataFrame(rows, DOC)
    repo = spark.createDataFrame([(1, "h", "o/p", SAID["en"], True, None), (2, "h", "o/q", SAID["es"], None, None), (3, None, None, SAID["es"], True, None), (4, "h", "o/r", SAID["zh"], False, None), (5, "h", "o/s", None, None, None)], REPO)
    found = L.languages(repo, docs)
    cases = {(r.origin, r.row_id, r.seg_no): r.lang for r in L.segment_table(L.wrong_labels(found)).collect()}
    assert cases == {("documents", 900, -1): "de", ("documents", 901, -1): "fr", ("documents", 902, 0): "en", ("documents", 902, 1): "ru", ("clean_text", 1, -1): "en", ("clean_text", 2, -1): "es", ("clean_text", 4, -1): "zh"}
    assert all(0 < r.confidence <= 1 for r in L.segment_table(found).collect())


RESIDUE = [
    "# {{project_name}}\n\n<%= description %>\n\nCopyright __COMPANY__", "Lorem ipsum dolor sit amet consectetur. Sed do eiusmod tempor.", "test test test test test",
    "tool\n\nThis project is called [your project name] and was made by [your name].", "502 Bad Gateway\n\nThe upstream did not answer in time.\n\nReference: 55f34eb14e",
    "<html><body><h1>404 Not Found</h1><hr>srv/1.2</body></html>", "<noscript>Please enable JavaScript to continue.</noscript>", "Diese Seite wurde leider nicht gefunden.", "请启用 JavaScript 后再访问本页面。",
    "Fast parsing of large files with little memory.\n\n${SHORT_DESCRIPTION}\n\nMaintained by ${AUTHOR}.",
]
CONTENT = [
    SAID["en"], SAID["zh"], f"{SAID['en']}\n\nThe router answers with a 404 Not Found page when none of the routes match, and tests cover it.",
    f"{SAID['de']}\n\n```\n502 Bad Gateway\n{{{{ name }}}}\n```", "", "   ", "v1.2", "...", f"{SAID['fr']} A value such as `{{{{ user_name }}}}` is replaced before the page leaves the server, usually at once.",
    "Two routes | 503 | x\n\n| 503 | nuserulo |\n|---|---|\n\n" + SAID["es"],
]


#: Messages that no rule lists in full: they count where they recur over several sources.
RECURRING = [
    "Une erreur s'est produite. Veuillez réessayer plus tard.", "This site can't be reached. The host refused to connect.", "JavaScript is not available. We've detected that it is off in this browser.",
    "tool\n\nYour session has expired. Please log in again.", "Just a moment... checking your browser before you go on.",
]
#: Ordinary sentences that only sound like messages.
SOUNDING = ["This package requires JavaScript 12 or later to build.", "Page moved to the wiki.", "Handles too many requests gracefully.", "Answers with 404 not found."]
TEXT = "origin string, row_id long, name string, source string, text string"


def waste_of(spark, texts):
    rows = [("documents", i, "tool", source, text) for i, (source, text) in enumerate(texts)]
    return {r.row_id for r in residue.residue_of(residue.signatures(spark.createDataFrame(rows, TEXT))).collect()}


def test_residue_that_recurs_and_content(spark):
    texts = [("ab"[k % 2], t) for t in [*RESIDUE, *RECURRING] for k in range(12)]
    once = [("a", t) for t in CONTENT]
    assert waste_of(spark, [*texts, *once]) == set(range(len(texts)))


def test_a_single_message_counts_only_beside_a_second(spark):
    alone = [("a", t) for t in [*RECURRING, *SOUNDING, "404 Not Found", *CONTENT]]
    surely = [("b", t) for t in [RESIDUE[0], RESIDUE[1], RESIDUE[2], RESIDUE[3], RESIDUE[4], RESIDUE[9]]]
    assert waste_of(spark, [*alone, *surely]) == set(range(len(alone), len(alone) + len(surely)))


def test_unknown_messages_count_only_where_they_recur(spark):
    odd = "Kettle error: the browser said no."
    rows = [("documents", i, f"n{i}", ["a", "b"][i % 2], odd) for i in range(12)] + [("documents", 50, "x", "a", "Pot error: the browser is fine.")]
    texts = spark.createDataFrame(rows, TEXT)
    assert {r.row_id for r in residue.residue_of(residue.signatures(texts)).collect()} == set(range(12))
    assert residue.residue_of(residue.signatures(texts.unionByName(texts))).count() == 12
    one = texts.where("source = 'a'")
    assert residue.residue_of(residue.signatures(one.unionByName(one))).count() == 0  # a row that is there twice counts once
    assert {r.row_id for r in residue.kept(texts).collect()} == {50}


def test_any_number_of_messages_is_read(spark):
    many = [f"The {a}{b} server refused to connect." for a in "abcdef" for b in "vwxyz"]  # 30 of weaker hints
    residue_ = ["404 Not Found\n" * 25, "404 Not Found. " * 300, "tool\n\n" + "404 Not Found\n\n502 Bad Gateway\n\n" * 40, "\n".join(many), "A parser for you and your files.\n" + "\n".join(many)]
    content = ["404 Not Found\n" * 30 + SAID["en"], "\n".join(many) + "\nA parser for you and your files.", "\n".join(["A parser for you and your files.", *many, "It is small."])]
    single = "\n".join(f"The {a}{b} kettle refused to connect." for a in "abcdef" for b in "vwxyz")  # none of these recurs
    texts = [("ab"[k % 2], t) for t in residue_ for k in range(12)]
    assert waste_of(spark, [*texts, *(("a", t) for t in [*content, single])]) == set(range(len(texts)))


def test_copies_of_messages_are_left_out_in_order():
    parts = read_text("404 Not Found\n" * 5000 + "A parser for you and your files.\n" + "Error 503. Go back. " * 5000)
    assert [(p.body, p.line, p.follows) for p in parts] == [
        ("0 not found", 0, True), ("0 not found", 1, True), ("", 5000, False), ("error 0.", 5001, False), ("error 0.", 5001, True), ("error 0.", 5001, True),
    ]


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_text_is_read_and_converted(text):
    read_text(text, "name")
    clean, kinds = M.convert(text)
    assert isinstance(clean, str) and set(kinds) <= set(M.KINDS)


KINDS = [
    ("<p>Hello <b>you</b></p>", ["html"]), ("a &amp; b", ["html"]), ("x <!-- note --> y", ["html"]), ("# Title\n\ntext", ["markdown"]), ("Title\n=====\n\ntext", ["markdown"]),
    ("see [this](a.md)", ["markdown"]), ("**bold**", ["markdown"]), ("`code`", ["markdown"]), ("```\n<b>x</b>\n```", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("'''x''' is", ["wiki"]), ("== Use ==\n\ntext", ["wiki"]), ("see [[Page|this]]", ["wiki"]), ("\\section{A}\n\n\\emph{x}", ["latex"]), ("so $$x^2$$ holds", ["latex"]), ("<div>\\( a_1 \\)</div>", ["html", "latex"]),
    ("3 < n and n > 2", []), ("list<int> and Map<K, V>", []), ("C:\\data\\x and /usr/bin", []), ("max_open_files and __init__.py", []), ("- one\n- two\n\n1. three", []), ("$5 to $10", []),
    ("C# and F#, issue #28, R&D [sic]", []), ("a[5] and f(x)", []), ("{{ user_name }} and ${DATA}", []), ("    indented # code", []), ("", []), ("5 * 3 * 2, *args, **kwargs", []),
]


@pytest.mark.parametrize("text,kinds", KINDS)
def test_kinds(text, kinds):
    assert M.convert(text)[1] == kinds


def test_structure_survives():
    html = "<h2>Use</h2><p>Call <code>f</code> now.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\nif x &lt; 2:</code></pre><script>bad()</script>"
    clean, _ = M.convert(html)
    assert "## Use" in clean and "Call `f` now." in clean and "- one" in clean and "- two" in clean and "```\nx = 1\nif x < 2:\n```" in clean and "bad" not in clean
    tex, _ = M.convert("\\section{Use}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\[ x^2 \\]\n\\begin{verbatim}\n$ run\n\\end{verbatim}")
    assert "# Use" in tex and "- one" in tex and "$x^2$" in tex and "```\n$ run\n```" in tex
    md, _ = M.convert("Use\n---\n\n> quoted **text**\n\n```py\nx = [1](2)\n```\n\n[ref]: http://x.y")
    assert md.startswith("# Use") and "quoted text" in md and "x = [1](2)" in md and "http" not in md


def test_lists_tables_and_code_keep_their_form():
    html = "<ol><li>one</li><li>two<ul><li>deep</li></ul></li></ol><table><tr><th>a</th><th>b</th></tr><tr><td><p>1</p></td><td>2 <b>x</b></td></tr></table><p>so <code>a_b_c</code> it is</p>"
    lines = M.convert(html)[0].split("\n")
    assert [x for x in lines if x] == ["1. one", "2. two", "  - deep", "a | b", "1 | 2 x", "so `a_b_c` it is"]
    wiki = M.convert("== Use ==\n\n{| class=x\n|+ Title\n|-\n! a !! b\n|-\n| style=\"x\" | 1 || 2\n|}\n\n'''end'''")
    assert "a | b\n1 | 2" in wiki[0] and wiki[1] == ["wiki"]
    tex = M.convert("\\begin{enumerate}\n\\item one\n\\begin{itemize}\n\\item deep\n\\end{itemize}\n\\item two\n\\end{enumerate}")[0]
    assert [x for x in tex.split("\n") if x.strip()] == ["1. one", "  - deep", "2. two"]
    assert M.convert("use `a_b` here")[0] == "use `a_b` here"


@pytest.mark.parametrize("text,html", [("x <b>y</b>", True), ("List<int> a", False), ("Map<a, b>", False), ("a < b & c > d", False), ("R&D x &amp; y", True), ("AT&T; &nosuch;", False), ("&#65;", True), ("<!-- c -->", True), ("<nosuch>x</nosuch>", False), ("<?php x ?>", False)])
def test_html_is_what_the_parser_meets(text, html):
    assert M.from_html(text)[1] == html
    assert html or M.from_html(text)[0] == text


def test_an_unclosed_tag_hides_nothing():
    assert "all of it stays" in M.convert("see <script> for this, all of it stays <b>here</b>")[0]
    assert M.convert("<svg><text>gone</text></svg>kept")[0] == "kept"


@pytest.mark.parametrize("text", ["<" * 5000, "[" * 5000, "*_" * 4000, "<a " * 3000, "`" * 4001, "''" * 3000, "$" * 3000, "&" * 4000, "{{" * 3000, "\\begin{" * 800, "<p>" * 3000, "|" * 5000, "# " * 4000, "=" * 5000])
def test_hostile_texts_end_quickly(text):
    import time

    began = time.time()
    M.convert(text)
    read_text(text)
    sentences(text)
    assert time.time() - began < 3


def test_menus_fall_away_and_sentences_stay():
    menu = "<p>" + "".join(f'<a href="/{i}"><b>{i}</b></a>' for i in range(9)) + "</p>"
    body = "".join(f"<p>Sentence number {i} says something of its own about the parser and its files.</p>" for i in range(8))
    clean = M.convert(menu + body)[0]
    assert "012345678" not in clean and all(f"Sentence number {i} says" in clean for i in range(8))


def test_residue_is_left_out_of_the_conversion(spark):
    repo = spark.createDataFrame([(1, "h", "o/p", "{{name}}", None, "# {{name}}\n\n<b>x</b>"), (2, "h", "o/q", "plain words here", None, "# Title")], REPO)
    docs = spark.createDataFrame([(7, 1, "o/p", "a", "**a** b", "en", "s"), (8, 1, None, None, None, None, None)], DOC)
    rows = {(r.origin, r.row_id): r.kinds for r in M.cleaned(repo, docs).collect()}
    assert rows == {("clean_text", 2): [], ("readme_raw", 2): ["markdown"], ("documents", 7): ["markdown"]}
