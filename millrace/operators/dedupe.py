"""Exact and near duplicates of rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from millrace.functions import hashing
from millrace.operators import meetings
from millrace.runtime import cut, share_code, spread
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Keys that a hot row's copies are dealt over.
SALTS = 64
#: Signs from which difflib itself gives a ratio (it takes frequent signs for junk from 200 on); pairs that are scored together.
LONG, TOGETHER = 200, 4096


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by order of each key. Each task keeps its first rows before the shuffle."""
    first = Window.partitionBy("_key").orderBy(order)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_key", "_r")


def repeats(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The rows that keep_first drops, by a number (order) that no two rows share.

    The first of each key is a minimum of minima over salts, and rows learn of it
    by key and salt, so that copies of a hot row never meet in a task.
    """
    rows = df.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64(order), F.lit(SALTS))})
    salted = rows.groupBy("_key", "_salt").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    several = salted.groupBy("_key").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts")).filter("_n > 1")
    known = several.select("_key", F.explode("_salts").alias("_salt"), "_first")
    return rows.join(known, ["_key", "_salt"]).filter(F.col(order) > F.col("_first")).select(*[rows[f"`{c}`"] for c in df.columns])


def new_rows(df: DataFrame, state: DataFrame, key: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each hash that the state lacks, and what to append to the state (row_hash, first_seen_row)."""
    fresh = keep_first(df.withColumn("row_hash", key).join(state.select("row_hash"), "row_hash", "left_anti"), F.col("row_hash"), order)
    return fresh, fresh.select("row_hash", F.col(order).alias("first_seen_row"))


def bucket_sets(df: DataFrame, text: Column, row_id: str, family: str = "sha256") -> DataFrame:
    """(row_id, text, keys): the distinct buckets of each row's text, and of a text too short for a shingle one by its own; null texts have none.

    Texts without a shingle all have the same empty signature; they meet their
    equals instead of each other. Signatures take long, so that a small table is
    dealt out to all cores before.
    """
    share_code(df.sparkSession)
    rows = spread(df.select(F.col(row_id).alias("row_id"), text.alias("_text")))
    sets = rows.select("row_id", "_text", hashing.shingles(F.col("_text")).alias("_set")).filter("_text is not null")
    apart = F.array(F.concat(F.lit("short:"), F.md5("_text")))
    if family == "sha256":
        keyed = sets.withColumn("_keys", hashing.sha256_buckets(F.col("_set")))
    else:
        keyed = sets.withColumn("_keys", hashing.lsh_buckets(hashing.minhash(F.col("_set"), family=family)))
    buckets = F.when(F.size("_set") > 0, F.array_distinct("_keys")).otherwise(apart)
    return keyed.select("row_id", F.col("_text").alias("text"), buckets.alias("keys"))


def bucket_keys(df: DataFrame, text: Column, row_id: str, family: str = "sha256") -> DataFrame:
    """(row_id, bucket_key): a row for each bucket; see bucket_sets."""
    return bucket_sets(df, text, row_id, family).select("row_id", F.explode("keys").alias("bucket_key"))


def lsh_samples(df: DataFrame, text: Column, row_id: str, every: int = 50, family: str = "sha256") -> DataFrame:
    """(bucket_key, sampled_row_id, snippet) of every so many rows: what later rows are compared to."""
    sample = df.filter(F.col(row_id) % every == 0)
    keyed = bucket_keys(sample, text, row_id, family).withColumnRenamed("row_id", "sampled_row_id")
    return keyed.join(sample.select(F.col(row_id).alias("sampled_row_id"), text.alias("snippet")), "sampled_row_id").select("bucket_key", "sampled_row_id", "snippet")


def candidate_pairs(df: DataFrame, text: Column, row_id: str, samples: DataFrame | None = None, every: int = 50, family: str = "sha256", how: str | None = None, threshold: float = 0.0) -> DataFrame:
    """(row_id, candidate_id): the distinct pairs of rows with sampled rows of their buckets, itself left out. No pair is shuffled.

    samples, every and family: see near_candidates. how: pairs that cannot reach the threshold may be left out; see near_duplicates.
    """
    rows = cut(bucket_sets(df, text, row_id, family))
    if samples is None:
        own = rows.filter(F.col("row_id") % every == 0)
    else:
        own = cut(samples.groupBy(F.col("sampled_row_id").alias("row_id")).agg(F.min("snippet").alias("text"), F.collect_set("bucket_key").alias("keys")))
    if how == "jaccard":
        rows, own = (x.withColumn("text", hashing.shingles(F.col("text"))) for x in (rows, own))
    return meetings.pairs(rows, own, how, threshold)


def near_candidates(df: DataFrame, text: Column, row_id: str, samples: DataFrame | None = None, every: int = 50, family: str = "sha256", how: str | None = None, threshold: float = 0.0) -> DataFrame:
    """(row_id, candidate_id, text, candidate): each row with the sampled rows of its buckets, itself left out.

    samples: what lsh_samples gave before; without, every so many rows of df are
    the samples, and each signature is computed once. family: see minhash. how
    and threshold: see candidate_pairs.
    """
    rows = df.select(F.col(row_id).alias("row_id"), text.alias("text"))
    if samples is None:
        snippets = rows.filter(F.col("row_id") % every == 0).select(F.col("row_id").alias("candidate_id"), F.col("text").alias("candidate"))
    else:
        snippets = samples.groupBy(F.col("sampled_row_id").alias("candidate_id")).agg(F.min("snippet").alias("candidate"))
    pairs = candidate_pairs(df, text, row_id, samples, every, family, how, threshold)
    return pairs.join(rows, "row_id").join(snippets, "candidate_id").select("row_id", "candidate_id", "text", "candidate")


def near_groups(df: DataFrame, text: Column, row_id: str, threshold: float = 0.85, how: str = "ratio", every: int = 50, family: str = "sha256") -> DataFrame:
    """(row_id, representative_id, similarity): each row with the representatives of its buckets that it is similar to, itself left out.

    A bucket is represented by its smallest sampled row, so a bucket of n rows
    gives at most n rows, and one that a third of the table shares no more than
    its share. A row has at most one representative for each of its buckets.
    """
    keys = cut(bucket_keys(df, text, row_id, family))
    first = keys.filter(F.col("row_id") % every == 0).groupBy("bucket_key").agg(F.min("row_id").alias("candidate_id"))
    pairs = keys.join(first, "bucket_key").filter("row_id <> candidate_id").select("row_id", "candidate_id").distinct()
    rows = df.select(F.col(row_id).alias("row_id"), text.alias("text"))
    heads = rows.filter(F.col("row_id") % every == 0).select(F.col("row_id").alias("candidate_id"), F.col("text").alias("candidate"))
    return scored(pairs.join(rows, "row_id").join(heads, "candidate_id"), threshold, how).withColumnRenamed("candidate_id", "representative_id")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two shingle sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def near_duplicates(df: DataFrame, text: Column, row_id: str, samples: DataFrame | None = None, threshold: float = 0.85, how: str = "ratio", every: int = 50, family: str = "sha256") -> DataFrame:
    """(row_id, candidate_id, similarity) of candidates at or above the threshold; rows are flagged, none dropped.

    samples, every and family: see near_candidates. how: ratio for the matching-blocks ratio, jaccard for the shingle sets', levenshtein for edits.
    """
    return scored(near_candidates(df, text, row_id, samples, every, family, how, threshold), threshold, how)


def scored(pairs: DataFrame, threshold: float, how: str) -> DataFrame:
    """(row_id, candidate_id, similarity) of pairs (row_id, candidate_id, text, candidate) at or above the threshold; see near_duplicates.

    Before the matching-blocks ratio, which runs in Python, its bound by the
    lengths lets go pairs that cannot reach the threshold, and for long texts,
    which take longer than the bound itself, that by shared signs.
    """
    a, b = F.col("text"), F.col("candidate")
    if how == "ratio":
        pairs, score = pairs.filter(length_bound(a, b) >= threshold).filter(F.when(F.greatest(F.length(a), F.length(b)) < LONG, True).otherwise(ratio_bound(a, b) >= threshold)), ratio(a, b)
    elif how == "jaccard":
        score = jaccard(hashing.shingles(a), hashing.shingles(b))
    else:
        score = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return pairs.select("row_id", "candidate_id", score.alias("similarity")).filter(F.col("similarity") >= threshold)


def length_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts is at most by their lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * F.least(F.length(a), F.length(b)) / total).otherwise(1.0)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts is at most by the signs that they share: the blocks that match are made of them."""
    total = F.length(a) + F.length(b)
    signs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1))))
    times = lambda text, sign: F.length(text) - F.length(F.replace(text, sign, F.lit("")))
    shared = F.aggregate(signs, F.lit(0), lambda n, sign: n + F.least(times(a, sign), times(b, sign)))
    return F.when(total > 0, 2.0 * shared / total).otherwise(1.0)


def ratio(a: Column, b: Column) -> Column:
    """difflib's matching-blocks ratio, which no SQL function has; Arrow batches, see matching_blocks."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = pd.Series(np.nan, x.index).astype(object).where(known, None)
        out[known] = matching_blocks(x[known].tolist(), y[known].tolist())
        return out.astype("float64")

    return F.pandas_udf(score, T.DoubleType())(a, b)


def matching_blocks(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher(None, x, y).ratio() of each pair, by numpy over many short pairs at once; of texts of LONG signs or more by difflib.

    The longest block that both texts share (the first in a, then in b) is found
    for all pairs together, sign of a by sign; what lies left and right of it are
    pairs of the next round.
    """
    out = np.ones(len(a))
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    short = np.flatnonzero(sizes.max(1) < LONG)
    for at in np.flatnonzero(sizes.max(1) >= LONG):
        out[at] = SequenceMatcher(None, a[at], b[at]).ratio()
    short = short[np.argsort(sizes[short].max(1), kind="stable")]  # texts of like sizes side by side
    for start in range(0, len(short), TOGETHER):
        some = short[start : start + TOGETHER]
        total = sizes[some].sum(1)
        shared = _shared([a[i] for i in some], [b[i] for i in some])
        out[some] = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
    return out


def _shared(a: list[str], b: list[str]) -> np.ndarray:
    """How many signs lie in the matching blocks of each pair."""

    def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        signs = np.zeros((len(texts), size.max(initial=0)), np.uint32)
        signs[np.arange(signs.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return signs, size

    (x, m), (y, n) = packed(a), packed(b)
    shared, of = np.zeros(len(a), np.int64), np.arange(len(a))
    lo, start = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)  # where each piece begins in its texts, m and n long
    while len(keep := np.flatnonzero((m > 0) & (n > 0))):
        of, lo, start, m, n = (v[keep] for v in (of, lo, start, m, n))
        wide = np.arange(max(m.max(), n.max()))[:, None]
        own = x[of, np.minimum(lo + wide[: m.max()], x.shape[1] - 1)]
        other = y[of, np.minimum(start + wide[: n.max()], y.shape[1] - 1)]
        inside, back = wide[: n.max()] < n, (LONG - wide[: n.max()]).astype(np.uint16)
        run, best = np.zeros((n.max() + 1, len(of)), np.uint16), np.zeros(len(of), np.int64)
        for i in range(len(own)):
            run[1:] = (run[:-1] + np.uint16(1)) * ((other == own[i]) & inside & (i < m))  # blocks that end here, by their end in b
            longest = (run[1:] * np.uint16(LONG + 1) + back * (run[1:] > 0)).max(0).astype(np.int64)  # the first of the longest
            better = longest // (LONG + 1) > best // (LONG + 1) % (LONG + 1)
            best = np.where(better, longest + i * (LONG + 1) ** 2, best)
        size = best // (LONG + 1) % (LONG + 1)
        i, j = best // (LONG + 1) ** 2 - size + 1, LONG - best % (LONG + 1) - size + 1
        np.add.at(shared, of, size)
        some = size > 0
        of, lo, start, m, n, i, j, size = (v[some] for v in (of, lo, start, m, n, i, j, size))
        of, lo, start, m, n = np.concatenate([of, of]), np.concatenate([lo, lo + i + size]), np.concatenate([start, start + j + size]), np.concatenate([i, m - i - size]), np.concatenate([j, n - j - size])
    return shared
