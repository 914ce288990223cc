"""Rows meet sampled rows of their buckets in tiles: which pairs do, and of them which may be similar.

Where a third of a table shares a bucket, pairs by a join of keys are many times
the table, and telling the distinct ones shuffles them all. Here both sides are
packed: every tile of samples goes to each part of the rows, and a task marks,
for a row at a time, the samples that any of its keys holds. A pair comes up
once, so nothing is shuffled after. Where all pairs are asked for, rows of a
block that hold the same of a tile's keys are marked together, and leave Python
as lists of rows and of samples, which Spark expands. Bounds of similarity are
taken of all marked samples at once, by counts of what texts share and by common
subsequences.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.runtime import share_code
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a tile on average and signs of their texts, rows of a block on average, pairs of a batch.
TILE, SIGNS, ROWS, PAIRS = 16_384, 1 << 20, 2048, 1 << 18
#: Rows of a block on average where all pairs are asked for; samples of a list, pairs of two lists and members of the lists of a batch.
MANY, WIDE, EXPANDED, LISTED = 8192, 1024, 8192, 1 << 18
#: Marked samples of a row from which bounds are taken here; fewer pairs are left to what comes after.
FEW = 32
#: Pairs whose common subsequences are found in step.
TOGETHER = 1 << 15
#: Words of 64 bits that a tile's signs may take for common subsequences.
MASKS = 1 << 22


def pairs(rows: DataFrame, samples: DataFrame, how: str | None = None, threshold: float = 0.0) -> DataFrame:
    """(row_id, candidate_id): each row with the samples that share a key, itself left out. Both are counted, so cut them before.

    rows and samples: (row_id, text, keys). how: pairs that cannot reach the
    threshold may be left out: ratio and levenshtein of texts, and jaccard of
    sets, for which text is an array of distinct values.
    """
    spark = rows.sparkSession
    share_code(spark)
    fields = ["row_id", "text", "keys"] if how else ["row_id", "keys"]
    size = F.sum(F.size("text") if how == "jaccard" else F.length("text") if how else F.lit(0))
    total = samples.agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("signs")).first()
    tiles, blocks = max(1, -(-total["n"] // TILE), -(-total["signs"] // SIGNS)), max(1, -(-rows.count() // (ROWS if how else MANY)))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not how:  # small tables still take all cores
        blocks = max(blocks, min(cells, spark.sparkContext.defaultParallelism))
    parts = min(cells, blocks)
    kind = rows.schema["row_id"].dataType.simpleString()

    def packed(df: DataFrame, key: str, n: int) -> DataFrame:
        by = F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int").alias(key)
        return df.groupBy(by).agg(F.collect_list(F.struct(*fields)).alias("r"))

    side = lambda own: [F.col(f"r.{c}").alias(f"{own}{c}") for c in fields]
    grid = packed(samples, "tile", tiles).select("tile", *side("")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = packed(rows, "block", blocks).select((F.col("block") % parts).alias("cell"), *side("own_"))
    own_task = lambda df: df.repartitionById(parts, "cell")  # noqa: E731  by hash, tasks would get none or several
    met = own_task(grid).hint("merge").join(own_task(dealt), "cell").select("tile", *fields, *[f"own_{c}" for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, *values = (c[i] for c in batch.columns)
                if number.as_py() != now:
                    own = [v.values for v in values[: len(fields)]]
                    now, tile = number.as_py(), Tile(*own, how, threshold, FEW) if how else Holders(*own)
                yield from tile.meet(*(v.values for v in values[len(fields) :]))

    if how:
        return met.mapInArrow(run, f"row_id {kind}, candidate_id {kind}")
    lists = met.mapInArrow(run, f"rows array<{kind}>, candidates array<{kind}>")
    return lists.select(F.explode("rows").alias("row_id"), "candidates").select("row_id", F.explode("candidates").alias("candidate_id")).filter("row_id <> candidate_id")


class Holders:
    """Samples by key; a sample that repeats has the keys of all its rows."""

    def __init__(self, ids: pa.Array, keys: pa.Array):
        names = ids.dictionary_encode()
        self.ids, self.n = names.dictionary, len(names.dictionary)
        self.keys = keys.flatten().unique()
        held = _members(names.indices, keys, self.keys)
        held = held[np.argsort(held[:, 1], kind="stable")]
        ends = np.searchsorted(held[:, 1], np.arange(len(self.keys) + 1))
        self.of = [held[a:b, 0] for a, b in zip(ends, ends[1:], strict=False)]

    def meet(self, ids: pa.Array, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        """(rows, candidates) lists of a block, whose products are its pairs: rows that hold the same keys are listed together. A row may be its own candidate."""
        names = ids.dictionary_encode()
        held = _members(names.indices, keys, self.keys)
        ends = np.flatnonzero(np.diff(held[:, 0], prepend=-1, append=-1)) if len(held) else []
        alike: dict = defaultdict(list)
        for a, b in zip(ends, ends[1:], strict=False):
            alike[held[a:b, 1].tobytes()].append(held[a, 0])
        marked, lists, size = np.zeros(self.n, bool), [], 0
        for some, own in alike.items():
            marked.fill(False)
            for key in np.frombuffer(some, np.int64):
                marked[self.of[key]] = True
            found = np.flatnonzero(marked)
            for a in range(0, len(found), WIDE):
                part = found[a : a + WIDE]
                step = max(1, EXPANDED // len(part))  # Spark holds what it makes of two lists at once
                for b in range(0, len(own), step):
                    lists.append((own[b : b + step], part))
                    size += len(lists[-1][0]) + len(part)
                if size >= LISTED:
                    yield self.batch(names.dictionary, lists)
                    lists, size = [], 0
        if lists:
            yield self.batch(names.dictionary, lists)

    def batch(self, names: pa.Array, lists: list) -> pa.RecordBatch:
        def packed(of: pa.Array, parts: list) -> pa.ListArray:
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), of.take(pa.array(np.concatenate(parts))))

        return pa.RecordBatch.from_arrays([packed(names, [own for own, _ in lists]), packed(self.ids, [found for _, found in lists])], names=["rows", "candidates"])


def _members(names: pa.Array, keys: pa.Array, known: pa.Array) -> np.ndarray:
    """The distinct (name, place of a key in known) of rows, in order; rows without a name are left out."""
    of = np.repeat(names.fill_null(-1).to_numpy().astype(np.int64), pc.list_value_length(keys).fill_null(0).to_numpy())
    at = pc.index_in(keys.flatten(), known).fill_null(-1).to_numpy().astype(np.int64)
    there = (of >= 0) & (at >= 0)
    both = np.unique(of[there] * len(known) + at[there])
    return np.stack(np.divmod(both, max(len(known), 1)), 1)


class Tile:
    """Samples by key and by what their texts are made of."""

    def __init__(self, ids: pa.Array, texts: pa.Array, keys: pa.Array, how: str, threshold: float, few: int):
        self.ids, self.how, self.threshold, self.few, self.n = ids, how, threshold, few, len(ids)
        self.places: dict = defaultdict(list)
        for at, name in enumerate(ids.to_pylist()):
            self.places[name].append(at)
        self.holders = _postings(keys.to_pylist())
        known = texts.to_pylist()
        own = [self.parts(t) for t in known]
        self.sizes = np.array([len(x) for x in own], np.int64)
        kind = np.uint16 if self.sizes.max(initial=0) < 1 << 16 else np.uint32
        self.rare, self.common = _postings(own), {}
        for part in [p for p, at in self.rare.items() if len(at) * 16 > self.n]:  # a whole array instead, 16 places for each of its samples at most
            self.common[part] = np.zeros(self.n, kind)
            self.common[part][self.rare.pop(part)] = 1
        self.none = np.zeros(self.n, kind)
        width = 32 if self.sizes.max(initial=0) <= 32 else 64
        self.word = np.uint32 if width == 32 else np.uint64
        self.codes, self.short = {}, self.sizes <= width
        signs = set() if how == "jaccard" else set("".join(t for t in known if len(t) <= width))
        if signs and len(signs) * self.n <= MASKS:
            self.codes = {sign: code for code, sign in enumerate(signs, 1)}
            self.masks = np.zeros((len(signs) + 1, self.n), self.word)  # the first for signs that no sample holds
            for at, t in enumerate(known):
                if len(t) <= width:
                    for k, sign in enumerate(t):
                        self.masks[self.codes[sign], at] |= self.word(1 << k)

    def parts(self, text) -> list:
        """What two texts must share: members of sets; of other texts the first, second and further occurrences of each sign."""
        if self.how == "jaccard":
            return text
        times: dict = defaultdict(int)
        out = []
        for sign in text:
            times[sign] += 1
            out.append((sign, times[sign]))
        return out

    def meet(self, ids: pa.Array, texts: pa.Array, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        """The pairs of a block of rows; those of a row number that repeats come up once, without bounds."""
        names, keys_of, rows = ids.to_pylist(), keys.to_pylist(), defaultdict(list)
        texts_of = texts.to_pylist()
        for at, name in enumerate(names):
            rows[name].append(at)
        marked, held, left = np.zeros(self.n, bool), [], []
        size = waiting = 0
        for name, at in rows.items():
            marked.fill(False)
            for key in (k for a in at for k in keys_of[a]):
                if (own := self.holders.get(key)) is not None:
                    marked[own] = True
            if name in self.places:
                marked[self.places[name]] = False
            found = np.flatnonzero(marked)
            if len(at) == 1 and len(found) > self.few:
                found = self.alike(texts_of[at[0]], found)
                if self.codes:
                    left.append((at[0], found))
                    waiting += len(found)
                    found = found[:0]
            if len(found):
                held.append((at[0], found))
                size += len(found)
            if waiting >= TOGETHER:
                held += (close := self.close(texts_of, left))
                size += sum(len(found) for _, found in close)
                left, waiting = [], 0
            if size >= PAIRS:
                yield self.batch(ids, held)
                held, size = [], 0
        if held := held + self.close(texts_of, left):
            yield self.batch(ids, held)

    def batch(self, ids: pa.Array, held: list) -> pa.RecordBatch:
        left = np.repeat([at for at, _ in held], [len(found) for _, found in held])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(left)), self.ids.take(pa.array(np.concatenate([found for _, found in held])))], names=["row_id", "candidate_id"])

    def near(self, text, found: np.ndarray) -> np.ndarray:
        """Those of the samples that may reach the threshold; for sets and edits of short texts, those that do."""
        found = self.alike(text, found)
        return np.concatenate([found[:0], *[f for _, f in self.close([text], [(0, found)])]]) if self.codes else found

    def alike(self, text, found: np.ndarray) -> np.ndarray:
        """Those of the samples that may reach the threshold by the number of parts they share with the text."""
        parts, shared = self.parts(text), self.none.copy()
        for part in parts:
            if (whole := self.common.get(part)) is not None:
                shared += whole
            elif (few := self.rare.get(part)) is not None:
                shared[few] += 1
        return found[self.most(shared[found].astype(np.int64), len(parts), self.sizes[found]) >= self.threshold]

    def close(self, texts: list, pairs: list) -> list:
        """Of (row, samples) those samples that may reach the threshold by common subsequences, and by edits: pairs of many rows in step."""
        of = np.repeat(np.arange(len(pairs)), [len(found) for _, found in pairs])
        if not len(of):
            return []
        at = np.concatenate([found for _, found in pairs])
        own = [texts[row] for row, _ in pairs]
        sizes = np.array([len(t) for t in own])
        codes = np.zeros((sizes.max(), len(own)), np.intp)
        for k, t in enumerate(own):
            codes[: len(t), k] = [self.codes.get(sign, 0) for sign in t]
        keep = (self.most(self.common_signs(codes, of, at), sizes[of], self.sizes[at]) >= self.threshold) | ~self.short[at]
        of, at = of[keep], at[keep]
        if self.how == "levenshtein":
            longest = np.maximum(np.maximum(sizes[of], self.sizes[at]), 1)
            keep = (1 - self.edits(codes, sizes, of, at) / longest >= self.threshold) | ~self.short[at] | (self.sizes[at] == 0)
            of, at = of[keep], at[keep]
        ends = np.searchsorted(of, np.arange(len(pairs) + 1))
        return [(row, at[a:b]) for (row, _), a, b in zip(pairs, ends, ends[1:], strict=False) if b > a]

    def common_signs(self, codes: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest common subsequence of each pair of a text (a column of codes) and a short sample."""
        left = np.full(len(at), ~self.word(0))  # zeros: signs of the subsequence
        flat, places = self.masks.ravel(), codes * self.n
        for row in places:
            mask = flat[row[of] + at]
            both = left & mask
            left = (left + both) | (left ^ both)
        return 8 * left.itemsize - np.bitwise_count(left).astype(np.int64)

    def edits(self, codes: np.ndarray, sizes: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Edits between text and sample, which is short and not empty, of each pair, by Myers' vectors of differences down a column."""
        one, fewer = self.word(1), np.zeros(len(at), self.word)
        last = np.left_shift(one, np.maximum(self.sizes[at] - 1, 0).astype(self.word))
        more, count = ~fewer, self.sizes[at].copy()
        for k, row in enumerate(codes):
            same = self.masks[row[of], at]
            down = same | fewer
            across = (((same & more) + more) ^ more) | same
            up, less = fewer | ~(across | more), more & across
            count += (((up & last) > 0).astype(np.int64) - ((less & last) > 0)) * (k < sizes[of])
            up, less = (up << one) | one, less << one
            more, fewer = less | ~(down | up), up & down
        return count

    def most(self, shared: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        """What the similarity of texts of these sizes is at most if they share so much."""
        if self.how == "jaccard":
            return shared / np.maximum(a + b - shared, 1)
        if self.how == "ratio":
            return np.where(a + b > 0, 2.0 * shared / np.maximum(a + b, 1), 1.0)
        longest = np.maximum(np.maximum(a, b), 1)
        return 1 - (np.maximum(a, b) - shared) / longest


def _postings(sets: list) -> dict:
    """The places of the sets that hold each member."""
    out: dict = defaultdict(list)
    for at, members in enumerate(sets):
        for member in members:
            out[member].append(at)
    return {member: np.array(at, np.int32) for member, at in out.items()}
