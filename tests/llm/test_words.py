import itertools

import numpy as np
import pyarrow as pa

from millrace.llm import words as W


def thue(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_a_polynomial_confuses():
    long = thue(1024)
    texts = [long, long.translate(str.maketrans("ab", "ba")), long[:-1], "A" + long[1:], "b" * 1024]
    found, begins = W.hashes(pa.array(texts), W.spaces())
    assert begins.tolist() == [0, 1, 2, 3, 4, 5] and len(set(found.tolist())) == 4 and found[0] == found[3]


def test_all_short_words_differ():
    texts = ["".join(p) for k in (1, 2, 3, 4) for p in itertools.product("abzé", repeat=k)]
    found, _ = W.hashes(pa.array(texts), W.spaces())
    assert len(set(found.tolist())) == len(texts)


def test_words_and_where_texts_begin():
    found, begins = W.hashes(pa.array(["One  two\nONE", None, "", "two", " \t"]), W.spaces())
    assert begins.tolist() == [0, 3, 3, 3, 4, 4] and found[0] == found[2] and found[1] == found[3] and found[0] != found[1]
    assert W.hashes(pa.array([None, " "], pa.string()), W.spaces())[0].dtype == np.uint64


def test_steps_change_nothing(monkeypatch):
    texts = pa.array(["one two", None, "", "three " * 50, "four", " ", "five six seven"] * 20)
    whole = W.hashes(texts, W.spaces())
    for step in (1, 7, 100):
        monkeypatch.setattr(W, "STEP", step)
        again = W.hashes(texts, W.spaces())
        assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    assert W.hashes(texts[:0], W.spaces())[1].tolist() == [0]
