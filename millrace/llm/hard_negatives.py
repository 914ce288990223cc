"""Hard negatives from inverted lists with stored centroid radii.

K-means centres are fitted on a bounded sample; every row lies in the list of
its nearest centre, and each list stores how far its farthest row is from the
centre. By Cauchy and Schwarz no row of a list scores more for an anchor a than
a . c + |a| r, and none less than a . c - |a| r. An anchor visits lists by
falling upper bound, leaves out those whose bounds lie outside its window, and
stops when the bound falls strictly below its k-th best score (a tie may still
win by its id). The search is exact, whatever the sample.

Lists are cut into blocks of bounded size, anchors too; a block of anchors goes
to the blocks of the lists that some of its anchors want, so a tile of scores is
a matrix product and a hot list is many tiles. Visits go in rounds of FIRST
lists, then GROWTH times as many; after each, the k best so far of every anchor
tell which lists are still worth a visit. The index is written once, bucketed
by list and block, so that the rounds shuffle requests and never the index.

Defined cases: rows whose id, label or vector is null, or whose vector holds a
null or non-finite component, take no part; a shorter vector counts as if it
ended in zeros; rows that repeat an id are never each other's positive, and each
is a positive or negative of others by itself; equal anchors (id, label and
vector) are one anchor; a positive score below 0 has an empty window; ties go to
the smaller id; an empty table gives an empty result; further columns are
ignored. A score that no long holds is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import map_batches
from millrace.runtime import cut, scratch, table
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists at most (sqrt of the rows before), rows that centres are fitted on (on average), rounds of the fit.
LISTS, SAMPLE, ROUNDS = 4096, 20_000, 8
#: Bytes of an index block's vectors, anchors of a block, lists visited in the first round, and how visits grow.
BLOCK, ANCHORS, FIRST, GROWTH = 1 << 19, 128, 8, 8
#: Candidates that a task holds before it keeps the best of each anchor.
HELD = 200_000
#: Scores beyond all others.
FAR = (1 << 63) - 1


@dataclass
class Index:
    """blocks: a table (list, piece, rows) by name; centres, radii and blocks of each list."""

    name: str
    centres: np.ndarray
    radii: np.ndarray
    pieces: np.ndarray
    anchors: DataFrame


def components(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of each component; null if the vector or a component is null or not finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    doubles = vector.cast("array<double>")
    return F.when(~F.exists(doubles, odd), F.transform(doubles, lambda c: F.floor(c * steps)))


def build(rows: DataFrame, anchors: Column) -> Index | None:
    """The index of rows (id, label, x), and the blocks of those that are anchors; None without rows."""
    spark = rows.sparkSession
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = known["n"], max(1, known["d"] or 0)
    if not n:
        return None
    padded = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    centres = _centres(padded, n, d)
    placed = cut(_placed(padded, centres).withColumn("anchor", anchors))
    own = {r["list"]: r for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.count_if("anchor").alias("a")).collect()}  # a row a list
    rows_a_block = max(16, BLOCK // (8 * d))
    lists = sorted(own)
    of = lambda f: np.array([f(own[k]) if k in own else 0 for k in range(len(centres))])
    pieces, groups = of(lambda r: -(-r["n"] // rows_a_block)), _groups({k: own[k]["a"] for k in lists})
    sizes = spark.createDataFrame([(k, int(pieces[k]), *groups[k]) for k in lists], "list int, pieces int, group int, asked int")
    dealt = placed.join(F.broadcast(sizes), "list")  # LISTS rows at most
    piece = lambda over: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(over)).cast("int").alias("piece")  # noqa: E731  placed is cut: numbers stay
    gathered = lambda df, by, over: df.select(by, piece(over), F.struct("id", "label", "x").alias("row")).groupBy(by, "piece").agg(F.collect_list("row").alias("rows"))
    name, buckets = f"millrace_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered(dealt, "list", "pieces").write.bucketBy(buckets, "list", "piece").option("path", scratch(spark)).saveAsTable(name)
    who = dealt.filter("anchor").dropDuplicates(["list", "id", "label", "x"])
    blocks = gathered(cut(who), "group", "asked").select((F.col("group").cast("long") * (1 << 32) + F.col("piece")).alias("block"), "rows")
    return Index(name, centres, of(lambda r: r["far"]).astype(float), pieces, cut(blocks))


def _groups(anchors: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The group of each list and the blocks of its group: lists with few anchors share a block, those with many have several."""
    out, group, held = {}, 0, 0
    for k, n in anchors.items():
        if held and held + n > ANCHORS:
            group, held = group + 1, 0
        out[k] = group, max(1, -(-n // ANCHORS))
        held += n
    return out


def _centres(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """Centres of sqrt(n) clusters, LISTS at most, by MLlib's k-means on rows whose hash is low."""
    wanted = min(LISTS, max(1, round(n**0.5)))
    low = rows.filter(F.pmod(F.xxhash64("id", "label"), F.lit(n)) < SAMPLE) if n > SAMPLE else rows
    points = low.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    if wanted == 1 or points.limit(wanted).count() < wanted:
        first = rows.select("x").first()[0]
        return np.array([first], float)
    return np.array(KMeans(k=wanted, seed=1, maxIter=ROUNDS, initSteps=1).fit(points).clusterCenters())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Packed vectors as rows of whole numbers."""
    return np.array([np.frombuffer(v, np.int64) for v in column.to_pylist()], np.int64).reshape(-1, d)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, label, x, list, far): vectors packed, the list of the nearest centre, and how far that is."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        half = (own * own).sum(1) / 2
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            points = x.astype(float)
            near = (half - points @ own.T).argmin(1) if len(points) else np.zeros(0, int)
            far = np.sqrt(((points - own[near]) ** 2).sum(1))
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(near, pa.int32()), pa.array(far)], names=["id", "label", "x", "list", "far"])

    return map_batches(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x"), run, "id long, label long, x binary, list int, far double")


_HIT = "block long, at int, ask int, score long, id long"
_REQUEST = "list int, piece int, block long, at array<int>, ids array<long>, labels array<long>, x array<binary>, floors array<long>, highs array<long>"


def search(index: Index, asks: DataFrame | None, k: int, same: bool, window: tuple[int, int] | None = None) -> DataFrame:
    """(block, at, ask, rank, score, id): the k best rows for each anchor (its block and place there) and ask.

    asks: (block, asks), where asks has (at, ask, score) of positives, whose
    window in percent of that score holds what is looked for; without, an anchor
    asks once. same: whether rows of the anchor's label or of others are meant.
    """
    spark = index.anchors.sparkSession
    blocks = index.anchors.withColumn("asks", F.lit(None).cast("array<struct<at:int,ask:int,score:long>>")) if asks is None else index.anchors.join(asks, "block")
    blocks, best, seen = cut(blocks), None, 0
    hit = "array<struct<at:int,ask:int,score:long,id:long>>"
    while seen < len(index.centres):
        upto = max(FIRST, seen * GROWTH)
        if best is None:
            state = blocks.withColumn("found", F.lit(None).cast(hit))
        else:
            state = blocks.join(best.groupBy("block").agg(F.collect_list(F.struct("at", "ask", "score", "id")).alias("found")), "block", "left")
        requests = _requests(state.select("block", "rows", "asks", "found"), index, seen, upto, k, window)
        met = requests.join(spark.table(index.name), ["list", "piece"])
        hits = _hits(met.select(*[f.split()[0] for f in _REQUEST.split(", ")], "rows"), k, same, len(index.centres[0]))
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        order = Window.partitionBy("block", "at", "ask").orderBy(F.desc("score"), "id")
        best = cut(hits.repartition("block").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        seen = upto
    return best


def _windows(rows: list, asks: list | None, window: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor and ask; an empty window where there is no ask."""
    if asks is None:
        return np.full((len(rows), 1), -FAR), np.full((len(rows), 1), FAR)
    width = 1 + max((a["ask"] for a in asks), default=0)
    low, high = np.ones((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
    for a in asks:
        if a["score"] >= 0:
            low[a["at"], a["ask"]] = -(-window[0] * a["score"] // 100)
            high[a["at"], a["ask"]] = window[1] * a["score"] // 100
    return low, high


def _requests(state: DataFrame, index: Index, seen: int, upto: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """The lists, by falling bound those from seen to upto, that anchors still want, a row for each of the list's blocks."""
    sent = state.sparkSession.sparkContext.broadcast((index.centres, index.radii, index.pieces))

    def wanted(block: int, rows: list, asks: list | None, found: list | None) -> Iterator[tuple]:
        centres, radii, pieces = sent.value
        low, high = _windows(rows, asks, window)
        floor = low.copy()
        count, least = np.zeros(low.shape, int), np.full(low.shape, FAR)
        for f in found or ():
            count[f["at"], f["ask"]] += 1
            least[f["at"], f["ask"]] = min(least[f["at"], f["ask"]], f["score"])
        floor[count >= k] = least[count >= k]
        x = np.array([np.frombuffer(r["x"], np.int64) for r in rows]).astype(float)
        middle, reach = x @ centres.T, np.sqrt((x * x).sum(1))[:, None] * radii
        reach += 1e-9 * (reach + np.abs(middle)) + 1e-6  # rounding of doubles
        order = np.argsort(-(middle + reach), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
        some = np.zeros(middle.shape, bool)
        for j in range(low.shape[1]):
            open_ = low[:, j] <= high[:, j]
            some |= open_[:, None] & (middle + reach >= floor[:, j][:, None]) & (middle - reach <= high[:, j][:, None])
        some &= (place >= seen) & (place < upto) & (pieces > 0)
        for c in np.flatnonzero(some.any(0)).tolist():
            at = np.flatnonzero(some[:, c]).tolist()
            own = [[rows[i]["id"] for i in at], [rows[i]["label"] for i in at], [rows[i]["x"] for i in at]]
            for piece in range(pieces[c]):
                yield (c, piece, block, at, *own, floor[at].ravel(), high[at].ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in _REQUEST.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                some: list[tuple] = []
                for row in wanted(*[batch.column(j)[i].as_py() for j in range(4)]):
                    some.append(row)
                    if len(some) == 64:
                        yield _batch(some, kinds, names)
                        some = []
                if some:
                    yield _batch(some, kinds, names)

    return map_batches(state, run, _REQUEST)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)


def _hits(met: DataFrame, k: int, same: bool, d: int) -> DataFrame:
    """(block, at, ask, score, id): of every tile of anchors and rows what may be among the k best."""

    def tile(row: list) -> Iterator[list[np.ndarray]]:
        _, _, block, at, ids, labels, x, floors, highs, rows = row
        at, ids, labels = np.array(at.as_py(), np.int32), np.array(ids.as_py(), np.int64), np.array(labels.as_py(), np.int64)
        own = rows.values
        names, kinds = own.field("id").to_numpy(), own.field("label").to_numpy()
        scores = products(_matrix(x.values, d), _matrix(own.field("x"), d))
        fits = ((labels[:, None] == kinds) if same else (labels[:, None] != kinds)) & (ids[:, None] != names)
        low, high = (np.array(v.as_py(), np.int64).reshape(len(at), -1) for v in (floors, highs))
        for j in range(low.shape[1]):
            who, which = np.nonzero(fits & (scores >= low[:, j][:, None]) & (scores <= high[:, j][:, None]))
            if len(who):
                yield best([np.full(len(who), block.as_py(), np.int64), at[who], np.full(len(who), j, np.int32), scores[who, which].astype(np.int64), names[which]], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        total, fresh = 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                for hits in tile([batch.column(j)[i] for j in range(batch.num_columns)]):
                    held.append(hits)
                    total, fresh = total + len(hits[0]), fresh + len(hits[0])
                if fresh > HELD:
                    held = [best(_joined(held), k)]
                    total, fresh = len(held[0][0]), 0
                    if total > HELD:  # of very many anchors: let them go on
                        yield _hit(held[0])
                        held, total = [], 0
        if held:
            yield _hit(best(_joined(held), k))

    return map_batches(met, run, _HIT)


def _hit(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "at", "ask", "score", "id"])


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact: in doubles where these hold them."""
    largest = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * a.shape[1]
    if largest < 1 << 53:
        return a.astype(float) @ b.T.astype(float)
    return a.astype(object) @ b.T.astype(object)


def best(hits: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of the hits of each anchor and ask the k with the highest scores, of equals with the smaller ids."""
    block, at, ask, score, name = hits
    order = np.lexsort((name, -score, ask, at, block))
    keys = [c[order] for c in (block, at, ask)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return [c[order[place < k]] for c in hits]


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, x).

    An anchor's positives are the best rows of its label; for each, the negatives
    are the best rows of other labels whose score lies in the window, in percent
    of the positive's score.
    """
    whole = rows.filter("id is not null and label is not null and x is not null")
    index = build(whole, anchors)
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = search(index, None, positives, True).select("block", "at", (F.col("rank") - 1).alias("ask"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    asks = near.groupBy("block").agg(F.collect_list(F.struct("at", "ask", F.col("positive_score").alias("score"))).alias("asks"))
    hard = search(index, asks, negatives, False, window)
    rows.sparkSession.sql(f"DROP TABLE {index.name}")
    names = index.anchors.select("block", F.posexplode("rows").alias("at", "row")).select("block", "at", F.col("row.id").alias("anchor_id"))
    out = hard.join(near, ["block", "at", "ask"]).join(names, ["block", "at"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), components(F.col("embedding")).alias("x"))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
