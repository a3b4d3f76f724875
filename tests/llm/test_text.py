import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from qanat.llm import textcore
from tests.llm import common

alphabet = st.text(st.sampled_from(list("aB1'’-_ \n\t.éßﬁΑσςИ²Ⅻ…한אعी٣x́​￿ İ")), max_size=40)


def form(*texts):
    return textcore.consistent_form(pa.array(texts, pa.string())).to_pylist()


def test_alike_texts_are_equal():
    groups = [("fine", "ﬁne", "f​ine", "fіne"), ("ABC 1", "ＡＢＣ　１", "АВС 1"), ("café", "café"), ("صلى الله عليه وسلم", "ﷺ"), ("لا", "ﻻ"), ("a-b", "a‑b"), ("12 Ω", "12 Ω"), ("a\nb", "a\r\nb"), ("AH", "𝐀ℌ", "ᎪℋꞋ"[:2]), ("(1) a", "⑴ ɑ"), ("NO", "ⲚⲞ"), ("wait...", "wait…")]
    for g in groups:
        assert len(set(form(*g))) == 1, g


def test_visible_differences_stay():
    for x, y in (("a", "A"), ("e", "é"), ("1", "2"), ("a.", "a,"), ("a\nb", "a b"), ("x2", "x²"), ("1", "①"), ("1/2", "½"), ("a b", "ab"), ("m", "rn"), ("ي", "ى")):
        assert len(set(form(x, y))) == 2, (x, y)


def test_null_empty_and_long():
    long = "word " * 200_000 + "Ａ"
    assert form(None, "", long) == [None, "", long[:-1] + "A"]
    assert textcore.consistent_form(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(alphabet, max_size=6))
def test_form_is_idempotent_and_words_follow_the_rule(texts):
    once = form(*texts)
    assert form(*once) == once
    h, of = textcore.words(once)
    assert np.bincount(of, minlength=len(texts)).tolist() == [len(common.words(x)) for x in texts]
    flat = [w for x in texts for w in common.words(x)]
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


def test_window_hashes_tell_windows_apart():
    h = textcore.words(["a b c a b c d"])[0]
    for n in (2, 3, 12):
        want = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
        got = textcore.window_hashes(h, n).tolist()
        assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]
    big = textcore.words([" ".join(f"w{i % 20}" for i in range(100))])[0]
    got = textcore.window_hashes(big, 40)
    assert got[0] == got[20] != got[1]
