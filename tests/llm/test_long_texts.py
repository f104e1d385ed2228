"""Random and degenerate texts: no crash, no overlap, no position outside, and no time that explodes with the length."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import credentials, leakage, matching, packing, pii
from factloom.llm.tokens import DEFAULT_VOCAB
from factloom.operators import shredding

JUDGE = credentials.Judge(DEFAULT_VOCAB)
PIECES = ["@", " at ", "[at]", " dot ", "\\n", "\\u0041", "\\ud800", "&amp;", "<b>", "<!--", "-->", "password=", "'", '"', " + ", "${", "}", "://", "-----BEGIN PRIVATE KEY-----", "Calle ", "12", "name=", "Dr. ", "Ä", "İ", "\n", "-", "(303) 555-0131", "word", "AKIA", "\x00", "😀"]
TEXTS = st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_are_inside_and_apart(text):
    spans = pii.find(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    found = credentials.find(text, JUDGE)
    assert all(0 <= a < b <= len(text) for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert len(credentials.mask(text, found)) == len(text)
    leakage.words(text)
    matching.places(matching.tokens(text))
    shredding.decoded(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(1, 40))
def test_plans_place_every_item_that_fits(hist, cap):
    rows, bins = packing.plan(hist, cap)
    assert {k: v for k, v in hist.items() if k <= cap} == {k: sum(r[2] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    used = sum(r[0] * r[2] for r in rows)
    assert bins * cap >= used and (not used or bins >= -(-used // cap))


@given(st.text(max_size=8), st.text(max_size=8))
def test_distance_is_symmetric(a, b):
    assert matching.distance(a, b) == matching.distance(b, a) and (matching.distance(a, b) == 0) == (a == b)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "a.", "'", '" ', "' + '", "<!-- ", "-\n", "@", "a@", " at ", "1", "0 ", "(", "{", "${", "Aa ", "Calle Aa ", "\\", "\\n", "password=", "key = (", "-----BEGIN PRIVATE KEY-----"])
def test_long_texts_take_time_in_proportion(unit):
    for run in (lambda t: pii.find(t), lambda t: credentials.find(t, JUDGE), leakage.words):
        took = []
        for n in (4_000, 16_000):
            text = "'" + unit * (n // len(unit)) + "x"
            began = time.perf_counter()
            run(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 1 or took[1] < 9 * took[0], (unit, took)
