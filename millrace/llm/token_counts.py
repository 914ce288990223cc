"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for the tokenizer. The first splits text as
the tokenizer's pattern does; it has seven states, so a chunk of text is a map
from its state before to its state after, and the maps of all chunks compose
in a parallel prefix scan, after which every chunk runs from its own first
state. The second reads each split word; it is compiled from the vocabulary's
merges, and its transitions emit by how many tokens a word has more (see
``word_transducer``). The library is not asked; tests hold the counts against it.

The pattern and normal form are those of the lower-casing word-end BPE
vocabularies. Special strings in a text count one token each, as the library
has it by default.

Defined cases: a null text counts as empty, 0 bytes and 0 tokens; a very long
text is counted whole, in parts that end where words end; repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import CHARS, kept, map_batches, slices, texts_of
from millrace.llm.word_transducer import Merges, Transducer
from pyspark.sql import DataFrame

#: Code points of a chunk, and the limit of the over_limit column.
CHUNK, LIMIT = 256, 2048

# States of the splitter: between words, in letters, in other signs, after a
# quote that began a word, and after that quote and r, v or l.
ROOT, LETTERS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
# Classes of code points.
SPACE, NUMBER, APOSTROPHE, SIGN, LETTER, STMD, R, V, L, E = range(10)
# Outputs: a word begins at this code point; one began at the code point before.
HERE, BEFORE = 1, 2

#: Code points that are white space in Unicode.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Letters and numbers (first, last) that the library's Unicode has and Python's has not, and what to add to its capitals for their small letters.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEWER_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
#: Sigma, whose small letter Python takes from its place in a word, and the newer capitals, by their small letters.
SMALL = {0x3A3: 0x3C3} | {i: i + d for a, b, d in NEWER_CAPITALS for i in range(a, b + 1)}
_CAPITALS = re.compile("[" + "".join(map(chr, SMALL)) + "]")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for each state and class."""
    to, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)

    def rule(state: int, c: int) -> tuple[int, int]:
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            if c == (L if state == QUOTE_L else E):
                return ROOT, 0
            there, o = rule(LETTERS, c)
            return there, o | BEFORE
        if state == QUOTE and c in (STMD, R, V, L):
            return {STMD: ROOT, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        if c == SPACE:
            return ROOT, 0
        if c == NUMBER:
            return ROOT, HERE
        if c in letters:
            return LETTERS, 0 if state == LETTERS else HERE
        if state in (SIGNS, QUOTE):
            return SIGNS, 0
        return (QUOTE, HERE) if c == APOSTROPHE else (SIGNS, HERE)

    for state in range(7):
        for c in range(10):
            to[state, c], out[state, c] = rule(state, c)
    return to, out


def classes() -> np.ndarray:
    """Class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.array([of.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x110000)], np.uint8)
    for ranges, c in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = c
    out[WHITE_SPACE] = SPACE
    for chars, c in (("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in chars]] = c
    return out


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the rows, each a map from states to states, in log2 steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def split(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a class sequence begin and end."""
    to, out = kept("splitter", splitter)
    n = len(kinds)
    rows = -(-(n + 1) // CHUNK)
    grid = np.full(rows * CHUNK, SPACE, np.uint8)  # white space follows the last code point
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = to.ravel().astype(np.intp) * 10  # states times ten, so that a class only has to be added
    state = np.repeat(np.arange(7, dtype=np.intp)[:, None] * 10, rows, 1)
    for column in columns:
        state = flat[state + column]
    ends = scan((state // 10).T.astype(np.uint8))
    now = np.concatenate([[ROOT], ends[:-1, ROOT]]).astype(np.intp) * 10
    said, outs = np.empty_like(columns), out.ravel()
    for k, column in enumerate(columns):
        now = now + column
        said[k] = outs[now]
        now = flat[now]
    said = said.T.ravel()
    begins = (said & HERE) > 0
    begins[:-1] |= (said[1:] & BEFORE) > 0
    marks = np.flatnonzero(begins | (grid == SPACE))
    starts = begins[marks]
    at = np.flatnonzero(starts)
    return marks[at], marks[at + 1]


class Counter:
    """Both transducers of one vocabulary, and the texts' counts by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            specials = [t["content"] for t in json.load(f)["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.kinds = classes()
        self.words = Transducer(Merges(path))

    def normal(self, text: str) -> tuple[str, int]:
        """The normalised text and the number of special strings, which white space replaces."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        whole = "\n".join(unicodedata.normalize("NFC", p) for p in parts)
        return (whole.translate(SMALL) if _CAPITALS.search(whole) else whole).lower(), len(parts) - 1

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        normal = [self.normal(t) for t in texts]
        total = np.array([n for _, n in normal], np.int64)
        whole = "\n".join(t for t, _ in normal) + "\n"
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in normal])])
        starts, ends = split(self.kinds[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)])
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        place = np.flatnonzero((raw & 0xC0) != 0x80)  # of each code point
        tokens = self.words.count(raw, place[starts], place[ends])
        owner = np.searchsorted(begins, starts, side="right") - 1
        return total + np.bincount(owner, tokens, len(texts)).astype(np.int64)


def parts(text: str) -> list[str]:
    """A very long text cut behind line ends or spaces, where words end whatever follows."""
    out, start = [], 0
    while len(text) - start > CHARS:
        found = re.compile(r"[ \n]").search(text, start + CHARS)
        if not found:
            break
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    return kept(("counter", path), lambda: Counter(path))


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, 1):
            texts = texts_of(batch.column(1))
            cut = [parts(t) for t in texts]
            if all(len(c) == 1 for c in cut):
                n = own.count(texts)
            else:
                n = np.array([sum(int(own.count([p])[0]) for p in c) for c in cut], np.int64)
            size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["_id", "n_bytes", "n_tokens", "over_limit"])

    out = map_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)


def op7_token_counts(spark, sf_dir):
    from millrace.runtime import table

    return count(table(spark, sf_dir, "documents"))
