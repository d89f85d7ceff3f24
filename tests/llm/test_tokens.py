from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratlas.llm import encode, mixing
from stratlas.llm.bpe import MatrixBpe, vocabulary_path


@pytest.fixture(scope="module")
def both():
    known = Tokenizer.from_file(vocabulary_path())
    known.encode_special_tokens = True
    return MatrixBpe(vocabulary_path(), cache_words=50), known


def ids(bpe, texts):
    flat, ends = bpe.encode(texts)
    return [flat[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))]


TEXTS = ["", " ", "\n\n  \t", "a", "a" * 3000, "ab" * 900, "aab" * 500, "<|endoftext|>", "naïve café", "日本語の文書" * 80, "🚀🚀 v1.2", "don't we'll I'D", "1234567890" * 60, "\u200b\ufeff x", "x" * 257, "é" * 600, "\x00\x01"]


def test_ids_are_those_of_the_public_tokenizer(both):
    bpe, known = both
    assert ids(bpe, TEXTS) == [e.ids for e in known.encode_batch(TEXTS, add_special_tokens=False)]


@given(st.lists(st.text(max_size=120), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(both, texts):
    bpe, known = both
    assert ids(bpe, texts) == [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]


@given(st.text(alphabet="abc \n", min_size=200, max_size=900))
@settings(max_examples=40, deadline=None)
def test_long_words_of_few_letters(both, text):
    bpe, known = both
    word = text.replace(" ", "").replace("\n", "")
    assert ids(bpe, [text, word]) == [known.encode(t, add_special_tokens=False).ids for t in (text, word)]


@pytest.mark.parametrize("seed", range(6))
def test_long_words_of_many_letters(both, seed):
    """Words over the bound of the matrices, of letters, digits or signs: all occurrences of a pair merge in one round there."""
    bpe, known = both
    rng = np.random.default_rng(seed)
    alphabet = ["etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzäöüß", "0123456789", "-=_*#.", "日本語文書解析器可以读取", "aab"][seed]
    words = ["".join(rng.choice(list(alphabet), rng.integers(150, 2500))) for _ in range(12)]
    assert ids(bpe, words) == [e.ids for e in known.encode_batch(words, add_special_tokens=False)]


def test_round_trip(both):
    bpe, known = both
    assert [known.decode(x, skip_special_tokens=False) for x in ids(bpe, TEXTS[:-1])] == TEXTS[:-1]


def test_empty_and_null_texts_have_empty_lists(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi", 7), (3, "hi", 7)], "doc_id long, text string, ids int")
    got = encode.encode_ids(df).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert encode.encode_ids(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_permutations(size):
    out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 12345, np.int64))
    assert sorted(out.tolist()) == list(range(size))


def documents(spark, rows):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")


def targets(spark, rows, budget):
    return spark.createDataFrame([(*r, budget) for r in rows], "source string, target_weight double, max_repeats int, budget_tokens long")


def test_shares_repeats_and_shortfalls(spark):
    hot = [("Big ", "one two three four five six " * 40)] * 60
    rows = hot + [("small", "seven eight nine " * 30)] * 2 + [(None, "x y z " * 50), ("small", None), ("other", "no " * 500)]
    want = targets(spark, [("big", 0.6, 1), ("SMALL", 0.3, 3), ("absent", 0.1, 2)], 4000)
    plan, mixed = mixing.mix(documents(spark, rows).repartition(3), want, block_len=64, shard_blocks=8)
    report = {r.source: r for r in mixing.mix_report(plan, mixed).collect()}
    assert {s for s, r in report.items() if r.short} == {"small", "absent"}
    assert abs(report["big"].mixed_tokens - 2400) <= 2 * 64 and report["big"].most_uses == 1
    assert report["small"].most_uses <= 3 and report["small"].mixed_tokens == report["small"].capacity_tokens
    assert report["absent"].mixed_tokens == 0 and abs(sum(r.actual_share for r in report.values() if r.actual_share) - 1) < 1e-9


def test_blocks_hold_every_token_once(spark):
    texts = [f"document {i} says {'word ' * (i % 50)}" for i in range(200)]
    blocks = mixing.token_blocks(documents(spark, [("a", t) for t in texts]).repartition(4), ["a"], 32).collect()
    known = Tokenizer.from_file(vocabulary_path())
    assert sum(r.n_tokens for r in blocks) == sum(len(known.encode(t, add_special_tokens=False).ids) for t in texts)
    assert all(len(r.ids) == r.n_tokens <= 32 for r in blocks)
    numbers = [r.block_no for r in mixing.numbered(mixing.token_blocks(documents(spark, [("a", t) for t in texts]).repartition(4), ["a"], 32)).collect()]
    assert sorted(numbers) == list(range(len(numbers)))


def test_shard_counts_add_up_and_vary():
    plan = [{"source": s, "slots": n, "held_blocks": n} for s, n in (("a", 700), ("b", 250), ("c", 50))]
    drawn = mixing.shard_draws(plan, 64, 7)
    assert drawn.groupby("source").n_slots.sum().to_dict() == {"a": 700, "b": 250, "c": 50}
    assert set(drawn.groupby("shard").n_slots.sum()[:-1]) == {64}
    assert len(set(drawn[drawn.source == "a"].n_slots)) > 2
