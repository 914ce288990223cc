"""Cross-entropy difference of matched n-gram language models.

A target model is counted on the documents chosen as target (here: labelled of
good quality), a background model on all documents. Both are bigram models with
Dirichlet smoothing towards their unigrams over one shared vocabulary, the
distinct words of all documents; the background counts are scaled to the target's number of tokens, so that the
two are matched in size as well. What a document adds to the counts itself is
left out when it is scored, so that target documents are not judged by their own
words. A document's score is the mean over its tokens
of the target loss less the background loss, in nats: the lower, the more it
reads like the target.

Every distinct word and pair has a count of its own, under its 64-bit hash.
Documents are dealt into blocks of about BLOCK bytes by a hash of the row. A
block sends each of its distinct n-grams once to the slab of hashes that the
n-gram belongs to, however often it occurs, so that a common n-gram weighs no
more than a rare one; a slab sums them and answers each block in the order in
which the block asked. Blocks and slabs grow in number with the input, and
nothing but the number of bytes reaches the driver.

Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case.
Defined cases: a null or wordless text has 0 tokens and null losses; without
any target token all losses are null; a text that alone has target tokens is
scored by models that know nothing; very long texts are scored whole, by one
task each; rows that repeat an id are scored each,
and an id labelled twice is target if any label says so; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm import words as W
from millrace.llm.arrow import hold_little, map_batches, slices
from millrace.llm.sizes import small
from millrace.runtime import share_code
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, least blocks and slabs, blocks for each slab beyond these, and the weights of the unigrams and of each word.
BLOCK, LEAST, FAN, MU, ALPHA = 4_000_000, 64, 4, 32.0, 0.5


def keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts, sorted; which of them each word and each pair is; where texts begin.

    Words have odd keys and pairs even ones. A text's first word follows the
    mark of a beginning, which is no word.
    """
    words, begins = W.hashes(pa.concat_arrays(column.chunks), W.signs())
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[begins[:-1][begins[:-1] < begins[1:]]] = W.salt(77)
    pair = W.mix(words * W.salt(21) + before * W.salt(22))
    found, which = np.unique(np.concatenate([words | np.uint64(1), pair & ~np.uint64(1)]), return_inverse=True)
    return found, which[: len(words)], which[len(words) :], begins


def packed(*columns: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all low bytes first, which compresses well."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def dealt(docs: DataFrame, target: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The rows by block, and the number of slabs."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(LEAST, size // BLOCK + 1)
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(target).alias("_target"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), max(LEAST, blocks // FAN)


def totals(rows: DataFrame) -> tuple[int, int, int]:
    """Target tokens, tokens and distinct words of all rows. A batch sends each of its distinct words once."""
    share_code(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, begins = W.hashes(batch.column(1), W.signs())
            if len(words):
                found = np.unique(words | np.uint64(1)).view(np.int64)
                tokens, chosen = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                tokens[0], chosen[0] = len(words), np.diff(begins)[np.array(batch.column(0).to_pylist(), bool)].sum()
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(chosen), pa.array(tokens)], names=["word", "chosen", "tokens"])

    each = map_batches(rows.select("_target", "_text"), count, "word long, chosen long, tokens long").groupBy("word").agg(F.sum("chosen").alias("chosen"), F.sum("tokens").alias("tokens"))
    row = each.agg(F.sum("chosen"), F.sum("tokens"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1] or 0, row[2]


def asked(rows: DataFrame, slabs: int) -> DataFrame:
    """block, slab, cells: the n-grams of the block in the slab, sorted, with their target counts and counts; for the slabs of which the block has n-grams."""
    share_code(rows.sparkSession)
    bounds = np.array([-(-(k << 64) // slabs) for k in range(1, slabs)], np.uint64)

    def ask(rows: pa.Table) -> pa.Table:
        hold_little()
        found, own, pair, begins = keys(rows.column("_text"))
        hit = np.tile(np.repeat(np.array(rows.column("_target").to_pylist(), bool), np.diff(begins)), 2)
        which = np.concatenate([own, pair])
        n, chosen = np.bincount(which, minlength=len(found)), np.bincount(which[hit], minlength=len(found))
        slab = np.searchsorted(bounds, found, side="right")
        starts = np.flatnonzero(np.append(True, slab[1:] != slab[:-1])) if len(found) else slab
        blobs = [packed(found[a:b], chosen[a:b], n[a:b]) for a, b in zip(starts, [*starts[1:], len(found)], strict=bool(len(found)))]
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(blobs), pa.int32()), "slab": pa.array(slab[starts], pa.int32()), "cells": pa.array(blobs, pa.binary())})

    return rows.groupBy("block").applyInArrow(ask, "block int, slab int, cells binary")


def merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of what blocks ask, which of them each one asked is, and the sums of the counts."""
    found, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    chosen, n = (np.bincount(which, np.concatenate([p[k] for p in parts]), len(found)).astype(np.int64) for k in (1, 2))
    return found, which, chosen, n


def summed(rows: DataFrame, slabs: int) -> DataFrame:
    """block, slab, cells: what all rows hold of the n-grams of the block in the slab: target counts and counts in the order asked."""

    def answer(rows: pa.Table) -> pa.Table:
        hold_little()
        parts = [unpacked(blob.as_py(), 3) for blob in rows.column("cells")]
        _, which, chosen, n = merged(parts)
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        blobs = [packed(chosen[own], n[own]) for own in np.split(which, ends)]
        return pa.table({"block": rows.column("block"), "slab": rows.column("slab"), "cells": pa.array(blobs, pa.binary())})

    return asked(rows, slabs).groupBy("slab").applyInArrow(answer, "block int, slab int, cells binary")


def gathered(answers: pa.Table) -> np.ndarray:
    """Target counts and counts of a block's n-grams, in their order, as slabs follow one another."""
    return np.concatenate([np.zeros((2, 0)), *(np.stack(unpacked(blob.as_py(), 2)) for blob in answers.sort_by("slab").column("cells"))], 1).astype(np.float64)


def counts(docs: DataFrame, target: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the target rows and of all rows, to look at a small corpus: of words, then of pairs."""
    parts = [unpacked(r["cells"], 3) for r in asked(*dealt(docs, target, text_col, text_col)).collect()]
    found, _, *both = merged(parts)
    word = found % np.uint64(2) == 1
    return tuple(np.concatenate([n[word], n[~word]]) for n in both)


def within(text_of: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How often each token's n-gram occurs in the token's own text."""
    if not len(which):
        return np.zeros(0)
    _, back, n = np.unique(text_of * (int(which.max()) + 1) + which, return_inverse=True, return_counts=True)
    return n[back].astype(np.float64)


def losses(single: np.ndarray, pair: np.ndarray, first: np.ndarray, scale: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
    """Loss of each token under the model that counts its word and pair so often, times scale. first: tokens that begin a text; size: of the vocabulary."""
    alone = (single * scale + ALPHA) / (tokens + ALPHA * size)
    last = np.zeros(len(single))
    last[1:] = single[:-1]
    last[first] = 0
    return -np.log((pair * scale + MU * alone) / (last * scale + MU))


def score(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, target_loss, background_loss, score of every row. chosen: the ids of the target documents."""
    ids = small(chosen.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct())
    texts = docs.select(docs[id_col].alias("_own"), docs[text_col].alias("_text"))
    flagged = texts.join(ids, F.col("_own") == F.col("_id"), "left").select("_own", F.col("_id").isNotNull().alias("_target"), "_text")
    rows, slabs = dealt(flagged, "_target", "_own", "_text")
    tokens, all_tokens, size = totals(rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hold_little()
        _, own, pair, begins = keys(rows.column("_text"))
        table = gathered(answers)
        n = np.diff(begins)
        text_of, first = np.repeat(np.arange(len(n)), n), begins[:-1][n > 0]
        target = np.array(rows.column("_target").to_pylist(), bool)
        # a text is judged by what the models counted elsewhere
        words, pairs = within(text_of, own), within(text_of, pair)
        target_tokens = tokens - n * target
        scale = (target_tokens / np.maximum(all_tokens - n, 1))[text_of]
        tokens_of, apart = target_tokens[text_of].astype(np.float64), target[text_of]
        by_target = losses(table[0][own] - words * apart, table[0][pair] - pairs * apart, first, np.ones(len(own)), tokens_of, size)
        by_all = losses(table[1][own] - words, table[1][pair] - pairs, first, scale, tokens_of, size)
        with np.errstate(invalid="ignore"):
            a, b = (np.bincount(text_of, loss, len(n)) / n for loss in (by_target, by_all))
        none = (n == 0) | (not tokens)
        return pa.table([rows.column("_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (a, b, a - b))], names=["_id", "n_tokens", "target_loss", "background_loss", "score"])

    out = rows.groupBy("block").cogroup(summed(rows, slabs).groupBy("block")).applyInArrow(run, f"_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("_id", id_col)


def op10_lm_score(spark, sf_dir):
    from millrace.runtime import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))
