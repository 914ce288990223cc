import numpy as np
import public_tokenizers
from helpers import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_counts as T
from millrace.llm import word_transducer as W
from millrace.runtime import table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("abstmdrvel'’ 12.,!\n\x1c\x85éÉ漢ΣİſK²é<|>"), max_size=60), min_size=1, max_size=4))
def test_counts_are_the_library_s(texts):
    assert T.counter().count(texts).tolist() == plain(texts)


def test_every_code_point_counts_as_in_the_library():
    """Beside letters, signs and numbers, of all planes that hold any; whatever Unicode versions both have."""
    counter = T.counter()
    for start in (*range(0, 0x40000, 1 << 14), 0xE0000, 0xFC000, 0x10C000):
        texts = [f"a{chr(i)}b !{chr(i)}1" for i in range(start, start + (1 << 14)) if not 0xD800 <= i < 0xE000]
        got, want = counter.count(texts).tolist(), plain(texts)
        assert got == want, [hex(ord(t[1])) for t, g, w in zip(texts, got, want, strict=True) if g != w][:20]


def test_special_strings():
    texts = ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]
    assert T.counter().count(texts).tolist() == plain(texts)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from("abeinorst"), min_size=1, max_size=30) | st.text(st.sampled_from("aab"), min_size=1, max_size=40) | st.text(st.sampled_from("!?.-=*#$"), min_size=1, max_size=30) | st.text(st.sampled_from("éñüßбаг漢字"), min_size=1, max_size=8) | st.text(st.sampled_from("😀❤😂✨"), min_size=1, max_size=8))
def test_words_are_counted_by_the_merges_alone(word):
    want = plain([word])[0]
    merges = T.counter().words.merges
    assert merges.count(word.encode()) == want == T.counter().count([word])[0]


def test_tokens_of_the_vocabulary_are_one():
    merges = T.counter().words.merges
    names = [n[:-4] for n in LIBRARY.get_vocab() if n.endswith("</w>") and n[:-4].isascii() and n[:-4].isalpha()][:4000]
    assert [merges.count(n.encode()) for n in names] == plain(names)


def test_unseen_words_share_states_and_full_tables_begin_anew():
    words = W.Transducer(T.counter().words.merges, states=400, symbols=20)
    texts = ["supercalifragilistic", "expialidocious", "antidisestablishmentarianism", "z" * 100, "ab" * 3000, "漢字", "jumping", "jumps", "a"] + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}ing" for k in range(200)]
    raw = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    want = plain(texts)
    assert words.count(raw, starts, ends).tolist() == want and len(words.state) == 400  # full
    assert words.count(raw, starts, ends).tolist() == want
    wide = W.Transducer(words.merges)
    wide.count(raw, starts, ends)
    before = len(wide.state)
    assert wide.count(raw, starts, ends).tolist() == want and len(wide.state) == before
    assert wide.run(raw, starts, ends).tolist() == [n if len(t) <= W.LONGEST else -1 for t, n in zip(texts, want, strict=True)]


def test_very_long_words_take_linear_time():
    import time

    began = time.process_time()
    texts = ["a" * 1_000_000, "ab" * 500_000, "!" * 1_000_000, "é" * 500_000]
    got = T.counter().count(texts).tolist()
    assert time.process_time() - began < 30
    assert got == plain(texts)


def test_query(spark):
    rows = table(spark, SMALL, "documents").collect()
    want = {r["doc_id"]: n for r, n in zip(rows, plain([r["text"] for r in rows]), strict=True)}
    for r in T.op7_token_counts(spark, SMALL).collect():
        assert r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048)


def test_odd_rows(odd, none, monkeypatch):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    got = T.count(odd).collect()
    assert len(got) == odd.count() and T.count(none).count() == 0
    for r in got:
        if r["doc_id"]:
            assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), plain([texts[r["doc_id"]]])[0])
    monkeypatch.setattr(T, "CHARS", 10)
    assert "".join(T.parts(texts[11])) == texts[11] and sum(T.counter().count([p])[0] for p in T.parts(texts[10])) == plain([texts[10]])[0]
