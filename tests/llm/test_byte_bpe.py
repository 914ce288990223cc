import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import byte_bpe as B
from millrace.runtime import table
from helpers import SMALL


def by_pieces(own, text, size):
    parts = B.pieces(text, size)
    assert "".join(p for p, _ in parts) == text
    return [i for p, one in parts for i in (own._match(p).tolist() if one else own._encoding.encode_ordinary(p))]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from("ab c\n\t'sS1é漢😀.  \x1c\x1f\x85\xa0\u3000"), max_size=200), st.sampled_from([2, 3, 7, 30]))
def test_pieces_change_nothing(text, size):
    own = B.codec()
    whole = own._encoding.encode_ordinary(text)
    assert by_pieces(own, text, size) == whole
    assert own.decode(np.array(whole, np.uint32)) == text.encode()


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", " ", "\n", "1", ".", "\u3000", " x", "\x1c"]), st.integers(1, 40)), max_size=8))
def test_long_runs_change_nothing(runs):
    own, text = B.codec(), "".join(c * n for c, n in runs)
    assert by_pieces(own, text, 10) == own._encoding.encode_ordinary(text)


@pytest.mark.parametrize("sign", [" ", "\n", "\u3000", "7", "a", ".", "é"])
def test_very_long_runs(sign):
    own = B.codec()
    for text in (sign * 1_000_000, "ab" + sign * 1_000_001 + "cd"):
        ids = own.encode(text)
        assert own.decode(ids) == text.encode()
    # what a long run gives is what it gives in a text that the library takes whole
    short = "ab" + sign * 60_000 + "cd" + sign * 70_001
    assert own.encode(short).tolist() == own._encoding.encode_ordinary(short)


def test_ten_million():
    own = B.codec()
    text = "x" + " " * 10_000_000 + "y"
    assert own.decode(own.encode(text)) == text.encode()


def test_query(spark):
    got = {r["doc_id"]: r for r in B.op6_byte_bpe(spark, SMALL).collect()}
    own = B.codec()
    for r in table(spark, SMALL, "documents").collect():
        ids = own._encoding.encode_ordinary(r["text"])
        want = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want


def test_odd_rows(odd, none):
    got = [r.asDict() for r in B.encode(odd).collect()]
    assert len(got) == odd.count() and B.digests(none).count() == 0
    empty = next(r for r in got if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids"] == [] and empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"]}
    for r in got:
        if r["doc_id"]:
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]
    assert public_tokenizers.PATTERN
