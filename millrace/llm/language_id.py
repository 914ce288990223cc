"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language answers how far a text can be
read as a substring of that language. Reading greedily gives longest matches;
each match is a phrase, and the language whose automaton needs the fewest
phrases wins, after the counts are normalised as in the cross-parsing estimate
of cross entropy: phrases * log2(length of the labelled text) / symbols read.

The automata are compiled into one table of (state, symbol) -> (state, phrase
ended), and all texts of a batch run through the tables of all languages at
once in numpy, a symbol a step. Texts are cut into blocks of BLOCK symbols that
parse on their own, so that a very long text is as parallel as many short ones.

Learning uses a bounded sample, SYMBOLS symbols of the DOCS distinct labelled
texts with the lowest hashes for each language, or of all if it has fewer (a text
may be cut so that each of them takes part); so every language with a labelled text that has a letter is learned, however many
copies there are. Texts are told apart by their first SYMBOLS code points.
Reading covers whole texts.

A text in no learned language reads badly in all of them: ``phrase_length`` tells
how many symbols a phrase of the best one takes, and ``keep`` lets go what falls
short.

Defined cases: a text that is null or has no letter is ``und`` with score and
phrase_length 0; a very long text is read whole; repeated rows give repeated
results; ties go to the language that sorts first; with nothing to learn from, every
text is ``und``; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import kept, map_batches, offsets, slices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what is learned: documents sampled and symbols read for each language.
DOCS, SYMBOLS = 64, 20_000
#: Symbols of the table besides "no letter" (0) and "another letter" (1); symbols of a block.
ALPHABET, BLOCK = 60, 4096
#: Symbols of the mean phrase below which a text is in no learned language: random letters and other scripts read a symbol or so at a time.
SHORTEST = 2.0
#: Bytes of text that are judged at once, unless one text is longer.
CHARS = 1_500_000
UNKNOWN = "und"


class Automaton:
    """Suffix automaton of one sequence of symbols, with rows of transitions."""

    def __init__(self, symbols: list[int], width: int):
        none = array("i", [0]) * width
        self.next = [none[:]]  # 0: none, as no transition leads to the root
        link, length, last = [-1], [0], 0
        for c in symbols:
            here = len(self.next)
            self.next.append(none[:])
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and not self.next[p][c]:
                self.next[p][c] = here
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    copy = len(self.next)
                    self.next.append(self.next[q][:])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p][c] == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here

    def moves(self) -> np.ndarray:
        """The rows of transitions, and one more for the state that follows a symbol which the text lacks."""
        width = len(self.next[0])
        return np.frombuffer(b"".join(self.next) + bytes(4 * width), np.int32).reshape(-1, width)


class Parser:
    """Cross-parsing tables of all languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        """samples: (language, labelled text), one for each language, sorted."""
        self.languages = [lang for lang, _ in samples]
        seen = Counter(ch.lower() for _, t in samples for ch in t if ch.isalpha())
        top = sorted(seen, key=lambda c: (-seen[c], c))[:ALPHABET]
        self.symbol = symbol_table({c: k + 2 for k, c in enumerate(top)})
        width = len(top) + 2
        tables, self.roots, self.weights = [], [], []
        for _, text in samples:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            codes = squeeze(self.symbol[points], np.zeros(len(points), bool))[0][:SYMBOLS]
            moves = Automaton(codes.tolist(), width).moves()
            base, stray = sum(len(t) for t in tables), len(moves) - 1
            fresh = np.where(moves[0] > 0, moves[0], stray)  # a phrase ends, the next begins here
            own = np.where(moves > 0, (moves + base) * width * 2, (fresh + base) * width * 2 + 1)
            own[0] = (fresh + base) * width * 2  # the first phrase ends none
            tables.append(own)
            self.roots.append(base * width)
            self.weights.append(np.log2(max(len(codes), 2)))
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32)
        self.weights = np.array(self.weights)

    def phrases(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block in each language."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state = np.repeat(self.roots[:, None], len(at), 1)
        count = np.ones((len(self.roots), len(at)), np.int64)  # the last phrase of a block has no end of its own
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for step, k in enumerate(alive.tolist()):
            moved = self.table[state[:, :k] + codes[at[:k] + step]]
            count[:, :k] += moved & 1
            state[:, :k] = moved >> 1
        out = np.empty_like(count)
        out[:, order] = count
        return out


def symbol_table(own: dict[str, int]) -> np.ndarray:
    """Symbol of every code point, letters in either case: 0 no letter, 1 a letter not in own."""
    letters = kept("letters", lambda: np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    out = letters.astype(np.int32)
    for c, k in own.items():
        for form in {c, c.upper()}:
            if len(form) == 1:
                out[ord(form)] = k
    return out


def squeeze(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes without repeats of "no letter", and which stay. first: where a text begins."""
    stays = codes != 0
    stays[1:] |= codes[:-1] != 0
    if len(codes):
        stays[0] = True
    stays |= first
    return codes[stays], stays


def points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and where each text begins; null has none."""
    at = offsets(column)
    raw = memoryview(column.buffers()[2] or b"")[at[0] : at[-1]]
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    begins = np.concatenate([[0], np.cumsum(heads)])[at - at[0]]
    return np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32), begins


def judge(parser: Parser, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and mean length of a phrase in that language of each text."""
    points, begins = points_of(column)
    n = len(column)
    codes = parser.symbol[points]
    del points
    letters = np.concatenate([[0], np.cumsum(codes != 0, dtype=np.int32)])
    has = letters[begins[1:]] > letters[begins[:-1]]
    del letters
    if not parser.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    first = np.zeros(len(codes), bool)
    first[begins[:-1][begins[:-1] < len(codes)]] = True
    codes, stays = squeeze(codes, first)
    begins = np.concatenate([[0], np.cumsum(stays, dtype=np.int32)])[begins]
    size = np.diff(begins)
    blocks = -(-size // BLOCK)
    text_of = np.repeat(np.arange(n), blocks)
    inner = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = begins[:-1][text_of] + inner * BLOCK
    lengths = np.minimum(size[text_of] - inner * BLOCK, BLOCK)
    found = np.stack([np.bincount(text_of, row, n) for row in parser.phrases(codes, starts, lengths)])
    cost = found * parser.weights[:, None] / np.maximum(size, 1)
    best = cost.argmin(0)
    ranked = np.sort(cost, 0)
    score = ranked[1] / np.maximum(ranked[0] + ranked[1], 1e-12) if len(ranked) > 1 else np.ones(n)
    names = [parser.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
    # the last phrase of a block may be cut short, and so is counted for a part only where there are others
    length = size / np.maximum(found[best, np.arange(n)] - blocks, 0.5)
    return names, np.where(has, score, 0.0), np.where(has, length, 0.0)


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The labelled text of each language: SYMBOLS code points at most, of the DOCS distinct texts with the lowest hashes."""
    head = F.when(F.octet_length(text_col) <= SYMBOLS, F.col(text_col)).otherwise(F.substring(text_col, 1, SYMBOLS))  # copies long texts only
    lettered = F.substring("text", 1, 100).rlike(r"\p{L}") | F.col("text").rlike(r"\p{L}")  # whole texts are decoded only if need be
    rows = labelled.select(F.col(lang_col).alias("lang"), head.alias("text")).filter(F.col("lang").isNotNull() & lettered)
    rows = rows.withColumn("mark", F.xxhash64("text"))
    marks = rows.select("lang", "mark").distinct()
    counts = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    lowest: dict[str, list[int]] = {lang: [] for lang in counts}
    wide = 4
    while any(len(lowest[lang]) < min(n, DOCS) for lang, n in counts.items()):  # once, but for odds of 1 to 10**30 or so
        bounds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min((wide * DOCS << 64) // n, (1 << 64) - 1) - (1 << 63))])
        lowest = {lang: [] for lang in counts}
        for r in marks.filter(F.col("mark") <= bounds[F.col("lang")]).collect():
            lowest[r["lang"]].append(r["mark"])
        wide *= 4
    picked = labelled.sparkSession.createDataFrame([(lang, mark) for lang, own in lowest.items() for mark in sorted(own)[:DOCS]], "lang string, mark long")
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    found = rows.join(F.broadcast(picked), ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))  # DOCS a language
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["mark"])):
        texts[r["lang"]].append(r["text"])
    return [(lang, "\n".join(t[: even([len(t) + 1 for t in own], SYMBOLS + 1) - 1] for t in own)) for lang, own in texts.items()]


def even(sizes: list[int], total: int) -> int:
    """What each may take at most so that all together take the total at most: what short ones leave goes to long ones."""
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > total:
            return total // (len(sizes) - k)
        total -= size
    return max(sizes)


def predict(docs: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, phrase_length of every row; only the text is read."""
    kind = docs.schema[id_col].dataType.simpleString()
    key = ("parser", hash(tuple(samples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kept(key, lambda: Parser(samples))
        for batch in slices(batches, 1, CHARS):
            names, score, length = judge(parser, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(length, pa.float64())], names=["_id", "lang_pred", "score", "phrase_length"])

    out = map_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, f"_id {kind}, lang_pred string, score double, phrase_length double")
    return out.withColumnRenamed("_id", id_col)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def keep(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", languages: set[str] | None = None) -> DataFrame:
    """The rows whose text is in one of the languages, by default in any that is learned. All columns of the rows stay.

    A text is in none of the languages if it has no letter, or if even the
    language that reads it best needs a phrase for less than SHORTEST symbols.
    """
    samples = sample(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    wanted = {lang for lang, _ in samples if languages is None or lang in languages}
    names, at = docs.columns, docs.columns.index(text_col)
    key = ("parser", hash(tuple(samples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kept(key, lambda: Parser(samples))
        for batch in slices(batches, at, CHARS):
            found, _, length = judge(parser, batch.column(at))
            yield batch.filter(pa.array([x in wanted for x in found] & (length >= SHORTEST), pa.bool_()))

    out = map_batches(docs.toDF(*[f"c{k}" for k in range(len(names))]), run, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)))
    return out.toDF(*names)


def op1_language_id(spark, sf_dir):
    from millrace.runtime import table

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, sample(docs.filter(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_length")
