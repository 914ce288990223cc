"""Nearest vectors by Euclidean distance: exact in one pass, or over a stored inverted file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from millrace.runtime import cut, scratch, share_code
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Queries and vectors of a block, and vectors that an approximate index is fitted on.
QUERIES, VECTORS, SAMPLE = 512, 2048, 20_000
#: Distances from vectors to centres that a task holds at once.
CELLS = 1 << 19


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): for each query its k nearest vectors, itself left out; of equals the smaller id.

    Exact, and vectors are scanned once whatever the number of queries: both
    sides are packed into blocks, every block of queries goes to each part of the
    vectors, and a task keeps k rows a query and part. Nothing passes through the
    driver. Null vectors take no part; ids are of any type that sorts.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut(_rows(queries, id_col, vector_col))
    blocks = max(1, -(-asked.count() // QUERIES))
    grid = _packed(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), ["block"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    stored = _in_blocks(_rows(vectors, id_col, vector_col).select(F.lit(0).alias("cell"), "id", "v"))
    dealt = stored.withColumn("cell", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(parts)).cast("int"))
    return _best(grid, dealt, k, id_col)


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row for each key with the ids and vectors (one after another) of its rows."""
    gathered = rows.groupBy(*by).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return gathered.select(*by, F.col("r.id").alias("ids"), F.flatten("r.v").alias("values"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """(cell, ids, values) of rows (cell, id, v): up to VECTORS rows of a cell that come one after another, packed without a shuffle."""
    share_code(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            borders = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                for at in range(a, b, VECTORS):
                    own = batch.slice(at, min(VECTORS, b - at))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (own.column(1), own.column(2).flatten())]
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(0, 1), *lists], names=["cell", "ids", "values"])

    return rows.mapInArrow(run, f"cell int, ids array<{kind}>, values array<double>")


def _best(asked: DataFrame, stored: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best for each query, from blocks (cell, block, ids, values) and (cell, ids, values) that meet by cell.

    Blocks of vectors that meet the same block of queries come one after another;
    a task keeps the k best so far and sends them on when the block changes.
    """
    kind = stored.schema["ids"].dataType.elementType.simpleString()
    left = asked.select("cell", "block", F.col("ids").alias("qids"), F.col("values").alias("qvalues"))
    met = left.hint("merge").join(stored, "cell").select("cell", "block", "qids", "qvalues", "ids", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, points, found = None, [], None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != now:
                    if found:
                        yield _found(names, found, batch.column(4).type.value_type, id_col)
                    now, names, found = key, batch.column(2)[i].as_py(), {}
                    points = _grid(batch.column(3)[i].values, len(names))
                ids = batch.column(4)[i].values
                _merge(found, names, points, ids, _grid(batch.column(5)[i].values, len(ids)), k)
                kind_ = ids.type
        if found:
            yield _found(names, found, kind_, id_col)

    hits = met.mapInArrow(run, f"query_id {kind}, {id_col} {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grid(values: pa.Array, n: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(n, -1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _lists(grid: np.ndarray, centres: np.ndarray, looks: int) -> np.ndarray:
    """The places of the nearest centres of each row of grid, nearest first, of equally near ones the smaller place; CELLS distances at once."""
    looks, step = min(looks, len(centres)), max(1, CELLS // max(1, len(centres)))
    out = np.zeros((len(grid), looks), np.int64)
    for at in range(0, len(grid), step):
        far = np.round(_far(grid[at : at + step], centres), 12)
        if looks == 1:
            out[at : at + step, 0] = far.argmin(1)
            continue
        bound = np.partition(far, looks - 1, 1)[:, looks - 1]
        for i, row in enumerate(far):
            few = np.flatnonzero(~(row > bound[i]))  # NaN last
            out[at + i] = few[np.argsort(row[few], kind="stable")[:looks]]
    return out


def _merge(found: dict, names: list, points: np.ndarray, ids: pa.Array, grid: np.ndarray, k: int) -> None:
    """Puts the k best of a block of vectors to those found so far: products choose few, differences measure them."""
    own = np.array(ids.to_pylist())
    rough = _far(points, grid)
    slack = 1e-9 * (1 + (points * points).sum(1) + (grid * grid).sum(1).max(initial=0))
    for q, name in enumerate(names):
        have, far = found.get(q, (own[:0], np.zeros(0)))
        rough[q, own == name] = np.inf
        bound = np.partition(rough[q], k - 1)[k - 1] if len(own) > k else np.inf
        if len(far) == k:
            bound = min(bound, far[-1] ** 2)
        few = np.flatnonzero((rough[q] <= bound + slack[q]) & (rough[q] < np.inf))
        have, far = np.concatenate([have, own[few]]), np.concatenate([far, np.sqrt(((grid[few] - points[q]) ** 2).sum(1))])
        order = np.lexsort((have, far))[:k]
        found[q] = have[order], far[order]


def _found(names: list, found: dict, kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    sizes = [len(found[q][0]) for q in found]
    who = [name for q, n in zip(found, sizes, strict=True) for name in [names[q]] * n]
    which = [v for q in found for v in found[q][0].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(which, kind), pa.array(np.concatenate([found[q][1] for q in found]))], names=["query_id", id_col, "distance"])


class VectorIndex:
    """A stored inverted file: vectors lie in the list of their nearest centre, in folders by job and list.

    A search looks into the lists of the centres nearest to each query and reads
    only their folders, and only those of one job if asked. Centres are fixed
    when the index is made; further vectors are appended at any time, and every
    one is indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, vectors: DataFrame, path: str, k: int = 10, lists: int = 128, recall: float = 0.95, looks: int | None = None, centres: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """An empty index whose centres are fitted on SAMPLE of the vectors at most (those with the smallest hashes), or given as (list, centre).

        looks: lists that a query looks into; by default the fewest in which
        queries of the sample find the share ``recall`` of their k nearest.
        """
        spark = vectors.sparkSession
        rows = _rows(vectors, id_col, vector_col)
        sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()] if centres is None or looks is None else []
        points = np.array(sample, np.float64) if sample else np.zeros((0, 0))
        if centres is None:
            own = _centres(points, min(lists, max(1, len(points) // 4))) if len(points) else np.zeros((1, 0))
            centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "list int, centre array<double>")
        centres.select(F.col("list").cast("int").alias("list"), F.col("centre").cast("array<double>").alias("centre")).coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path)
        looks = looks or (_looks(points, index.centres[1], k, recall) if len(points) else 1)
        spark.createDataFrame([(json.dumps({"looks": looks, "id": rows.schema["id"].dataType.simpleString()}),)], "value string").coalesce(1).write.text(f"{path}/settings")
        return index

    @cached_property
    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and centres of the lists, in the order of their numbers; as many as create was told."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())
        return np.array([r["list"] for r in rows]), np.array([r["centre"] for r in rows], np.float64)

    @cached_property
    def settings(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/settings").first()[0])

    def _listed(self, rows: DataFrame, looks: int) -> DataFrame:
        """(cell, id, v) for each of the lists whose centres are nearest; of equally near ones that of the smaller number."""
        kind = rows.schema["id"].dataType.simpleString()
        share_code(self.spark)
        sent = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, centres = sent.value
            for batch in batches:
                grid = _grid(batch.column(1).flatten(), batch.num_rows) if batch.num_rows else np.zeros((0, centres.shape[1]))
                near = _lists(grid, centres, looks)
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[near.ravel()], pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "id", "v"])

        return rows.mapInArrow(run, f"cell int, id {kind}, v array<double>")

    def append(self, vectors: DataFrame, job: str = "", id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Puts vectors into their lists, as a job's. A list that holds very many is written by several tasks."""
        placed = self._listed(_rows(vectors, id_col, vector_col), 1)
        blocks = _in_blocks(placed.hint("rebalance", "cell").sortWithinPartitions("cell"))
        blocks.select(F.lit(job).alias("job_id"), F.col("cell").alias("list"), "ids", "values").write.mode("append").partitionBy("job_id", "list").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        """(cell, job_id, ids, values): the stored blocks."""
        schema = f"ids array<{self.settings['id']}>, values array<double>, job_id string, list int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def search(self, queries: DataFrame, k: int = 10, job: str | None = None, looks: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, id, distance, rank): the k nearest in the lists that each query looks into; see nearest."""
        asked = cut(self._listed(_rows(queries, id_col, vector_col), looks or self.settings["looks"]))
        wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        stored = self.vectors()
        if job is not None:
            stored = stored.filter(F.col("job_id") == job)
        stored = stored.filter(F.col("list").isin(sorted(wanted))).select(F.col("list").alias("cell"), "ids", "values")
        sizes = self.spark.createDataFrame([(c, -(-n // QUERIES)) for c, n in wanted.items()], "cell int, blocks int")
        grid = _packed(asked.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), ["cell", "block"])
        return _best(grid, stored, k, id_col)


def nearest_approximate(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = 128, recall: float = 0.95) -> DataFrame:
    """(query_id, id, distance, rank) by an index made for this search; see VectorIndex and nearest."""
    index = VectorIndex.create(vectors, scratch(vectors.sparkSession), k, lists, recall, id_col=id_col, vector_col=vector_col)
    index.append(vectors, id_col=id_col, vector_col=vector_col)
    return index.search(queries, k, id_col=id_col, vector_col=vector_col)


def _centres(points: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spread points of the sample."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = _far(points, centres).argmin(1)
        for c in range(n):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
    return centres


def _looks(points: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists in which up to 200 of the points find the share of their nearest."""
    own, some = _far(points, centres).argmin(1), points[:: max(1, len(points) // 200)]
    near = np.argsort(_far(some, points), 1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(_far(some, centres), 1, kind="stable"), 1, kind="stable")  # of each list for each point
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(centres)
