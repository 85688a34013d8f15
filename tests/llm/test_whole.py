"""Inputs beyond those of the given tables: null and repeated ids, many languages."""

from __future__ import annotations

import numpy as np
import pytest

from veridoc.llm import html_extract, language_id, lm_score, simhash


def test_unlike_texts_without_an_id_or_with_one_id_all_stay(spark):
    unlike = [" ".join(f"{a}{b}" for b in range(40)) for a in "pqrstu"]
    rows = [*((None, x) for x in unlike[:3]), *((7, x) for x in unlike[3:]), (None, unlike[4]), (3, unlike[0])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, unlike[0]), (None, unlike[1]), (None, unlike[2]), *((7, x) for x in unlike[3:])]
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted((i or 0, x) for i, x in want)


def test_every_language_is_learned(spark):
    rows = [(k, f"l{k % 70:02}", f"text {k}") for k in range(700)] + [(700, None, "x"), (701, "l00", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample = language_id.sample_rows(docs, "doc_id", "text", "lang", ~language_id.held_out())
    assert {lang for lang, _ in sample} == {f"l{k:02}" for k in range(70)}


def test_a_text_of_many_languages_stays(spark):
    words = {lang: [f"{lang}{a}{b}" for a in "aeiou" for b in "nrst"] for lang in ("xx", "yy", "zz", "qq")}
    model = language_id.train([(lang, " ".join(own * 5)) for lang, own in words.items()])
    even = " ".join(" ".join(own) for own in words.values())
    docs = spark.createDataFrame([(1, even), (2, "12 ** 34"), (3, None)], "doc_id long, text string")
    assert language_id.identify(docs, model).where("doc_id = 1").first().score < language_id.LEAST_SCORE
    assert [r.doc_id for r in language_id.keep_identified(docs, model).collect()] == [1]


def test_filter_holds_every_pair_at_the_fill_of_large_inputs():
    rng = np.random.default_rng(9)
    segments = 1 << 11  # those of 30 GB, which have about as many pairs each as one here
    keys = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64))
    for least in (1, 20, 1200):  # counts of 25 MB, 0.5 GB and 30 GB of text
        counts = rng.zipf(1.6, len(keys)).clip(max=1 << 30) * least
        part = lm_score.segment_filter(keys, counts, segments)
        held = lm_score.LogFrequencyFilter([part])
        got = held.counts(keys)
        floor = np.array(lm_score.LEVELS)[np.searchsorted(lm_score.LEVELS, counts, side="right") - 1]
        assert (got >= floor).all() and (got == floor).mean() > 0.98
        assert (held.counts(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.02
        for size, start in zip(held.sizes[0], held.starts[0], strict=True):
            assert np.unpackbits(held.bits[start : start + -(-size // 8)]).sum() <= size / 2


LONG = "word " * 59 + "word"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<form id=aspnetForm><nav><a>x</a></nav><article><p>{LONG}</p></article></form>", LONG),
        (f"<div class='layout has-sidebar'><div class=sidebar><p>a b</p></div><div><p>{LONG}</p></div></div>", LONG),
        (f"<form><div class=content><p>{LONG}</p></div></form><footer><p>a b c</p></footer>", LONG),
        (f"<aside><div role=main><p>{LONG}</p></div></aside>", LONG),
        (f"<div class=comments><article><p>{LONG}</p></article></div>", ""),
        (f"<div hidden><main><p>{LONG}</p></main></div>", ""),
        (f"<div class='ad'><article><p>{LONG}</p></article></div>", ""),
        (f"<article><p>short one</p></article><div class=sidebar><p>{LONG}</p></div>", "short one"),
    ],
)
def test_an_article_within_a_container_apart(page, text):
    assert html_extract.extract(page, html_extract.grow()) == text
