"""Sharding as a minimum-cost flow from old shard sizes to new capacities.

Rows belong to blocks of their old shard; equal texts share a block. The only
figures that reach the driver are bytes and rows of each cell, at most
BLOCKS + 4 * HEAVY * SPLIT of them whatever the input. A successive shortest path
solver sends the old shards' bytes to the new capacities so that the fewest
bytes leave their place, the flow is rounded to whole blocks, and only files
of shards that gain or lose a block need to be rewritten.

A block with more than 1 / HEAVY of all bytes or rows (there are fewer than
2 * HEAVY of them) is dealt into SPLIT cells by its texts' hash, so that equal
texts still share a cell. A single text with more than that (there are fewer
than 2 * HEAVY of them too) gets SPLIT cells of its own, dealt by row id, so
that no task ranks a large group of copies. Equal texts stay in one shard unless
they alone exceed a whole shard.

Defined cases: a null text counts as empty and a row's size is its UTF-8 bytes
plus 8; null ids and repeated rows each get a slot of their own (rows of a hot
text whose ids are null share a cell); an empty table gives an empty result;
other columns are ignored by ``assign`` and written by ``rewrite``.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from millrace.sources import files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of all old shards together, heavy blocks looked for, cells of a heavy block.
BLOCKS, HEAVY, SPLIT = 16_384, 128, 64


def min_cost_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow that sends each supply to the rooms; sum(room) >= sum(supply).

    Successive shortest paths with Bellman-Ford on the residual graph of the
    complete bipartite network. cost(i, j) is the price of a unit from i to j.
    """
    m, n = len(supply), len(room)
    source, sink = m + n, m + n + 1
    to: list[int] = []
    left: list[int] = []
    price: list[int] = []
    edges: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(u: int, v: int, cap: int, c: int) -> None:
        for a, b, x, y in ((u, v, cap, c), (v, u, 0, -c)):
            edges[a].append(len(to))
            to.append(b)
            left.append(x)
            price.append(y)

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for i in range(m):
        for j in range(n):
            add(i, m + j, supply[i], cost(i, j))
    for j, r in enumerate(room):
        add(m + j, sink, r, 0)
    while True:
        dist, via = {source: 0}, {}
        queue = [source]
        while queue:
            nxt = []
            for u in queue:
                for e in edges[u]:
                    if left[e] > 0 and dist[u] + price[e] < dist.get(to[e], 1 << 62):
                        dist[to[e]], via[to[e]] = dist[u] + price[e], e
                        nxt.append(to[e])
            queue = list(dict.fromkeys(nxt))
        if sink not in dist:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
    return {(i, to[e] - m): left[e ^ 1] for i in range(m) for e in edges[i] if not e & 1 and left[e ^ 1] > 0}


def pack(units: list[tuple[int, int, tuple]], capacity: list[int], n_old: int) -> tuple[dict[tuple, int], int]:
    """New shard of each unit (old shard, bytes, key), which is the flow rounded to whole units and evened out; the bytes that the flow moves."""
    supply = [0] * n_old
    for old, size, _ in units:
        supply[old] += size
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    quota: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), x in flow.items():
        quota[i][j] = x
    shard: dict[tuple, int] = {}
    load = [0] * len(capacity)
    size_of = {key: size for _, size, key in units}
    for old, size, key in sorted(units, key=lambda u: (-u[1], u[2])):
        own = quota[old] or {old % len(capacity): 0}
        j = old if own.get(old, 0) >= size else max(own, key=lambda k: (own[k], k == old, -k))
        own[j] -= size
        load[j] += size
        shard[key] = j
    # units are whole: move the best fitting ones from the fullest to the emptiest shard, rather those that are away already
    home = {key: old for old, _, key in units}
    inside: list[list[tuple[int, tuple]]] = [[] for _ in capacity]
    for key, j in shard.items():
        inside[j].append((size_of[key], key))
    for _ in range(4 * len(capacity) + 200):
        over = [load[j] - capacity[j] for j in range(len(capacity))]
        a, b = over.index(max(over)), over.index(min(over))
        gap = over[a] - over[b]
        fits = [x for x in inside[a] if x[0] < gap]
        away = [x for x in fits if home[x[1]] != a and 4 * x[0] >= gap]
        fit = min(away or fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]), default=None)
        if gap <= 1 or fit is None:
            break
        inside[a].remove(fit)
        inside[b].append(fit)
        load[a], load[b] = load[a] - fit[0], load[b] + fit[0]
        shard[fit[1]] = b
    return shard, sum(x for (i, j), x in flow.items() if i != j)


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


class Plan:
    """Where each cell goes, and what a rewrite has to touch.

    moved_bytes: bytes that change their shard; fewest_bytes: what the flow moves,
    the least that any split of blocks could; affected: shards that gain or lose
    rows; emptied: old shards that keep none.
    """

    def __init__(self, cells: list[tuple[int, int, int, int]], n_old: int, weights: list[float]):
        """cells: (block, sub, bytes, rows), from sub SPLIT on those of hot texts; weights: the new shards' shares of all bytes."""
        total = sum(c[2] for c in cells)
        whole = [int(total * w / sum(weights)) for w in weights]
        capacity = [c + (k < total - sum(whole)) for k, c in enumerate(whole)]
        of_block, of_text = defaultdict(int), defaultdict(int)
        for block, sub, size, _ in cells:
            of_block[block] += size
            of_text[block, sub // SPLIT] += size
        least = min(capacity, default=0)

        def unit(c: tuple[int, int, int, int]) -> tuple[int, int]:
            """Cells that stay together: a block, or a hot text, that fits a shard; cells are what is left."""
            text = c[1] // SPLIT
            if of_block[c[0]] <= least:
                return c[0], -1
            return (c[0], -1 - text) if text and of_text[c[0], text] <= least else (c[0], c[1])

        sizes: dict[tuple, int] = defaultdict(int)
        for c in cells:
            sizes[unit(c)] += c[2]
        at, self.fewest_bytes = pack([(k[0] % n_old, s, k) for k, s in sizes.items()], capacity, n_old) if cells else ({}, 0)
        self.largest_unit = max(sizes.values(), default=0)
        self.rows, filled = [], defaultdict(int)
        self.moved_bytes, self.affected, self.emptied = 0, set(), {c[0] % n_old for c in cells} - set(at.values())
        for c in sorted(cells):
            j, old = at[unit(c)], c[0] % n_old
            self.rows.append((c[0], c[1], j, filled[j]))
            filled[j] += c[3]
            if j != old:
                self.moved_bytes += c[2]
                self.affected |= {j, old}


def assign(docs: DataFrame, n_new: int = 24, n_old: int = 16, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None, weights: list[float] | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, old_shard, moved.

    old: the number of the shard that holds a row now, from 0 to n_old - 1; by
    default the text's hash, the layout that this operator writes.
    """
    return _placed(docs, n_new, n_old, id_col, text_col, old, weights)[0]


def _cells(docs: DataFrame, n_old: int, text_col: str, id_col: str, old: Column | None):
    """The rows' block, the hash of their text, the sub expression over both and _id, and the figures of all cells."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = F.xxhash64(text)
    per = max(1, BLOCKS // n_old)
    place = F.pmod(mixed, F.lit(n_old)) if old is None else old.cast("long")
    block = (F.pmod(F.shiftright(mixed, 20), F.lit(per)) * n_old + place).cast("int")
    thin = docs.select(block.alias("block"), mixed.alias("_mixed"), F.col(id_col).alias("_id"), _size(F.col(text_col)).alias("size"))
    plain = thin.groupBy("block").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    size, rows = sum(r["b"] for r in plain), sum(r["n"] for r in plain)
    heavy = sorted(r["block"] for r in plain if (r["b"] * HEAVY > size or r["n"] * HEAVY > rows) and r["n"] > 1)
    sub = F.lit(0)
    if heavy:
        inside = thin.filter(F.col("block").isin(heavy))
        texts = inside.groupBy("block", "_mixed").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        hot = sorted({r["_mixed"] for r in texts.filter((F.col("b") * HEAVY > size) | (F.col("n") * HEAVY > rows)).filter("n > 1").collect()})
        deal = F.pmod(F.xxhash64("_mixed", F.lit(7)), F.lit(SPLIT))
        if hot:
            at = F.array_position(F.array(*map(F.lit, hot)), F.col("_mixed"))
            deal = F.when(F.col("_mixed").isin(hot), at * SPLIT + F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SPLIT))).otherwise(deal)
        sub = F.when(F.col("block").isin(heavy), deal).otherwise(0).cast("int")
    cells = [(r["block"], 0, r["b"], r["n"]) for r in plain if r["block"] not in set(heavy)]
    if heavy:
        fine = inside.groupBy("block", sub.alias("sub")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        cells += [(r["block"], r["sub"], r["b"], r["n"]) for r in fine]
    return block, mixed, sub, cells


def _placed(docs, n_new, n_old, id_col, text_col, old, weights):
    block, mixed, sub, cells = _cells(docs, n_old, text_col, id_col, old)
    plan = Plan(cells, n_old, weights or [1.0] * n_new)
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(plan.rows, "block int, sub int, shard int, start long"))  # bounded as cells are
    rows = docs.select(F.col(id_col).alias("_id"), _size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"), block.alias("block"), mixed.alias("_mixed")).withColumn("sub", sub)
    ranked = rows.withColumn("_r", F.expr("row_number() over (partition by block, sub order by text_crc32, _id)"))
    out = ranked.join(where, ["block", "sub"]).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("_r") - 1).alias("slot"), F.pmod("block", F.lit(n_old)).alias("old_shard")).withColumn("moved", F.col("old_shard") != F.col("shard"))
    return out, plan


class Unfinished(Exception):
    """A rewrite of a folder broke off while files were put in place: finish it with ``recover`` and read the folder again."""


def rewrite(docs: DataFrame, path: str, n_new: int = 24, n_old: int = 16, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None, weights: list[float] | None = None, place: str = "shard") -> Plan:
    """Write the files of the affected shards under path/shard=N, whole rows; gives the plan.

    All rows of affected shards are written to a hidden folder within path first.
    Then a journal names the folders to be replaced, and only now they are, one
    after another; all others keep the files they have, and folders of shards
    that keep no row go. docs may be what path holds. A failure before the
    journal leaves path as it was; after one during the replacements ``recover``
    goes on where they broke off, and until then a rewrite of path is an error.
    A column of docs named as place is the layout's own and written anew; name
    another place if it isn't.
    """
    spark, path = docs.sparkSession, path.rstrip("/")
    if files.exists(spark, f"{path}/{JOURNAL}"):
        raise Unfinished(path)
    block, mixed, sub, cells = _cells(docs, n_old, text_col, id_col, old)
    plan = Plan(cells, n_old, weights or [1.0] * n_new)
    to = [r[:3] for r in plan.rows if r[2] in plan.affected]
    where = F.broadcast(spark.createDataFrame(to, "block int, sub int, _shard int"))  # bounded as cells are
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != place]).alias("_row")
    rows = docs.select(whole, block.alias("block"), mixed.alias("_mixed"), F.col(id_col).alias("_id")).withColumn("sub", sub)
    kept = rows.join(where, ["block", "sub"]).repartition(F.col("_shard"), F.pmod(F.xxhash64("_id"), F.lit(8)))
    staging = f"_reshard-{uuid.uuid4().hex}"
    kept.select(F.col("_shard").alias(place), "_row.*").write.partitionBy(place).parquet(f"{path}/{staging}")
    written = [f.rstrip("/").rsplit("/", 1)[-1] for f in files.children(spark, f"{path}/{staging}")]
    files.replace_text(spark, f"{path}/{JOURNAL}", json.dumps({"staging": staging, "written": sorted(written), "emptied": [f"{place}={s}" for s in sorted(plan.emptied)]}))
    recover(spark, path)
    return plan


#: The file that tells which folders a rewrite puts in place.
JOURNAL = "_reshard.json"


def recover(spark: SparkSession, path: str) -> bool:
    """Put in place what a rewrite has written, whether it just has or broke off; False if there is nothing to do. May be run any number of times."""
    path = path.rstrip("/")
    found = files.read_text(spark, f"{path}/{JOURNAL}")
    if found is None:
        return False
    journal = json.loads(found)
    for name in journal["written"]:
        if files.exists(spark, staged := f"{path}/{journal['staging']}/{name}"):  # else it is in place
            files.delete(spark, f"{path}/{name}")
            files.move(spark, staged, f"{path}/{name}")
    for name in journal["emptied"]:
        files.delete(spark, f"{path}/{name}")
    files.delete(spark, f"{path}/{JOURNAL}")
    files.delete(spark, f"{path}/{journal['staging']}")
    return True


def op5_reshard(spark, sf_dir):
    from millrace.runtime import table

    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
