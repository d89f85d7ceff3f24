from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratlas.functions import judgement as J
from stratlas.functions import text as T
from stratlas.operators.search import query_terms, stem_word

PAGE = """[![build](https://img.shields.io/x.svg)](https://ci.example/x)

<p align="center"><b>Fast matrix algebra for tiny devices</b></p>

# Tinymat

A library for **dense** and _sparse_ matrices, with [solvers](https://docs.example/solve) &amp; decompositions that need little memory and no heap at all.

```python
a = 1
```

Usage
-----

Call `solve` with a matrix and a vector.

```sh
1
2
3
4
5
6
7
```

## Installation

pip install tinymat

### From source

make

## Links

- [a](https://a.example)
- [b](https://b.example)
- [c](https://c.example)
- [d](https://d.example)
- [e](https://e.example)
- [f](https://f.example)

## License

MIT
"""


def test_a_page_keeps_what_it_says_and_loses_the_rest():
    c = T.clean_readme(PAGE)
    assert "Fast matrix algebra" in c.clean_text and "dense and sparse matrices, with solvers & decompositions" in c.clean_text
    assert "a = 1" in c.clean_text and "Usage" in c.clean_text and "Call solve" in c.clean_text
    for gone in ("shields.io", "pip install", "make", "MIT", "https://", "**", "\n6\n"):
        assert gone not in c.clean_text
    assert c.dropped[0] == "installation" and "license" in c.dropped and not c.low_signal and c.reduction > 0.3


@pytest.mark.parametrize("raw", [None, "", "   ", "\n\n", "#", "```\nopen", "<!-- open", "[" * 2000, "*" * 3000, "\x00"])
def test_hostile_pages(raw):
    c = T.clean_readme(raw)
    assert isinstance(c.clean_text, str) and c.low_signal


@given(st.text(max_size=400))
@settings(max_examples=80, deadline=None)
def test_any_text_is_cleaned(text):
    c = T.clean_readme(text)
    assert len(c.clean_text) <= 6000


def test_truncation_prefers_paragraphs():
    text = "word " * 100 + "\n\n" + "more " * 100
    assert T.truncate(text, 600) == ("word " * 100).rstrip()
    assert T.truncate("x" * 50, 20) == "x" * 20


def test_scripts_tell_other_languages():
    assert T.is_non_english("Это библиотека для работы с матрицами и векторами на устройствах") and not T.is_non_english("кратко")
    assert not T.is_non_english("An English text with one слово and many more words to read here")


def test_the_last_valid_judgement_counts():
    good = {d: 150 for d in J.DIMENSIONS} | {"summary": "s" * 400, "flags": ["f" * 50] * 12}
    out = J.parse("<think>{\"x\": 1}</think> " + json.dumps({"a": "}{"}) + json.dumps(good))
    assert out["maintenance"] == 100 and len(out["summary"]) == 300 and len(out["flags"]) == 8 and len(out["flags"][0]) == 40
    assert J.parse(None) is None and J.parse("{") is None and J.parse(json.dumps({d: 1 for d in J.DIMENSIONS[:5]})) is None
    assert J.gives_popularity_away(["log_stars", "readme_length", "start_size"]) == ["log_stars"]


def test_terms_are_stemmed_without_stop_words():
    assert query_terms("The parsers of streaming records, parsed!") == ["parser", "stream", "record", "pars"]
    assert stem_word("class") == "class" and stem_word("libraries") == "library"
