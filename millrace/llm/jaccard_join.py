"""Exact self-join on n-gram Jaccard similarity.

1. Pruning. All pairs of a corpus can't meet, so tiles are laid only where sets
   can link at all. Two sets of a size class that reach the threshold differ in
   at most d of their shingles, d following from the largest size of the class;
   dealt into more than d parts by a hash, at least one part is the same in both,
   and so is its signature. Shingles that very many texts share, a common
   passage's, are left out of the parts, as they would join all of these texts; a
   set with too few others deals all of its shingles besides. Sets joined by equal
   signatures, over any number of steps, are a field. This loses no link and
   decides none.
2. Tiles. What links is decided in tiles of bounded size within a field, banded
   by size: sets that can link are of one band or of neighbouring ones. In a tile
   every set is a hashed bitmap of its shingles, and the bits in which two bitmaps
   differ bound their overlap from above. Tiles of bitmaps alone come first: pairs
   that can still reach the threshold make up finer fields, and only their sets'
   texts are read again. In the tiles of these, wider bitmaps and then the sorted
   arrays' intersections decide.
3. Spanning links. Fields and groups need links that span them, not all of their
   links. A field of several blocks is read a block at a time first; then the heads of the
   groups found, one of each, are dealt into blocks and joined, again and again
   while that joins most of them. So a large group of near copies falls into one, each set
   having met few others. Only then do blocks meet crosswise, and only where
   their sets are not in one group yet: the sets outside the field's largest group
   with those in it and with one another. Pairs of one group are never compared.

Nothing is dropped or capped: a part that is empty has a signature too where a
set has so many that its full parts need not suffice. Copies count once with
their weight. Sets are identified by 128-bit digests and shingles by 64-bit
hashes of their words' 64-bit hashes; texts that differ only within such
collisions count as equal. ``links=True`` also counts each row's links, for which
all pairs within a group have to meet: its cost grows with the square of the
largest group of near copies.

Words are runs of anything but space and tab to carriage return, A-Z in lower
case. Defined cases: a text that is null, empty or without words has an empty
set and links with nothing; repeated rows are copies; a very long text is one
set, read whole; ties of the smallest id are one group's; a null id takes part
and never names its component unless all ids of it are null; an empty table gives
an empty result; other columns are ignored by ``join`` and carried by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash

from millrace.llm import words as W
from millrace.llm.arrow import map_batches, slices
from millrace.llm.components import components
from millrace.llm.sizes import small
from millrace.runtime import cut
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Growth of size classes; sets and shingles of a block in tiles of arrays, and in tiles of bitmaps.
GROWTH, BLOCK_SETS, BLOCK_SHINGLES, MAP_SETS, MAP_SHINGLES = Fraction(3, 2), 128, 1 << 18, 1024, 1 << 23
#: Bits of the table of common shingles, and how far above the mean a cell is common.
CELL_BITS, COMMON = 22, 8


class Classes:
    """Size classes, and how many parts a set is dealt into for each."""

    def __init__(self, least: Fraction):
        self.least = least
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        self.differ = np.array([int((1 - least) / (1 + least) * 2 * int(h)) for h in high], np.int64)
        self.parts = self.differ + 1 + self.differ // 4
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(int(bounds[-1] / least) + 1)
        self.bands = np.array(bounds, np.int64)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size; sets that can link are in one band or in neighbouring ones."""
        return np.searchsorted(self.bands, sizes, side="right") - 1

    def deals(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their class): the own class first, then each class of larger sets that can link."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        far = (sizes * self.least.denominator) // self.least.numerator
        last = np.searchsorted(self.low, far, side="right") - 1
        step = 0
        while True:
            which = np.flatnonzero((own + step <= last) & (sizes > 0))
            if not len(which):
                return
            yield which, own[which] + step
            step += 1


def signatures(sets: list[np.ndarray], classes: Classes, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each part, and the index of its set.

    Two linked sets have at least parts - differ parts in common. A set with
    fewer empty parts than that has a full one among them, and full parts always
    have signatures. Any other set tells all its shingles too, and of these the
    empty parts as well if they are as many again. common: marks of cells whose
    shingles are left out at first; any table gives the same links.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    rare = ~common[cells_of(flat)]
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for which, kind in classes.deals(sizes):
        lacking = _deal(flat, sizes, ends, which, kind, classes, rare, 0, False, keys, owners)
        if lacking.any():
            _deal(flat, sizes, ends, which[lacking], kind[lacking], classes, None, 1, True, keys, owners)
    return np.concatenate(keys), np.concatenate(owners)


def _deal(flat, sizes, ends, which, kind, classes, chosen, round_, tell_empty, keys, owners) -> np.ndarray:
    """Add the signatures of the sets' parts; gives which sets have too many empty parts."""
    n = sizes[which]
    at = np.repeat(ends[which] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
    parts = classes.parts[kind]
    base = np.cumsum(parts) - parts
    first, many = np.repeat(base, n), np.repeat(parts, n).astype(np.uint64)
    if chosen is not None:
        keep = chosen[at]
        at, first, many = at[keep], first[keep], many[keep]
    shingles = flat[at]
    cell = first + ((W.mix(shingles ^ W.salt(11 + 20 * round_)) >> np.uint64(20)) % many).astype(np.int64)
    value = W.mix(shingles ^ W.salt(12))
    total = int(parts.sum())
    filled = np.bincount(cell, minlength=total)
    low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    owner = np.repeat(np.arange(len(which)), parts)
    place = np.arange(total) - base[owner]
    key = W.mix(low + (high << np.uint64(32)) + filled.astype(np.uint64) * W.salt(13))
    key = W.mix(key + place.astype(np.uint64) * W.salt(14) + kind[owner].astype(np.uint64) * W.salt(15) + np.array([round_], np.uint64) * W.salt(17))
    lacking = np.bincount(owner, filled == 0, len(which)) >= parts - classes.differ[kind]
    told = filled > 0
    if tell_empty:
        told |= lacking[owner]
    keys.append(key[told])
    owners.append(which[owner[told]])
    return lacking


def cells_of(shingles: np.ndarray) -> np.ndarray:
    """The cell of each shingle in the table of common ones."""
    return (W.mix(shingles ^ W.salt(18)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def common_cells(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Marks of the cells that hold COMMON times the mean of all texts' shingles or more.

    Every task counts its cells and sends those above its own mean; at most
    2**CELL_BITS / COMMON cells come to the driver, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in slices(batches, 0):
            shingles = np.concatenate([np.zeros(0, np.uint64), *_sets(batch.column(0), n)])
            total += len(shingles)
            table += np.bincount(cells_of(shingles), minlength=len(table))
        high = np.flatnonzero(table >= 2 + COMMON / 2 * total / len(table))
        for k in range(0, len(high), 100_000):
            part = high[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table[part])], names=["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64())], names=["cell", "n"])

    sums = cut(map_batches(docs.select(docs[text_col].alias("_text")), count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = next((r["n"] for r in sums.filter("cell = -1").collect()), 0)
    high = sums.filter((F.col("cell") >= 0) & (F.col("n") >= F.lit(4 * COMMON + COMMON * total / (1 << CELL_BITS)))).select("cell").toPandas()
    marks = np.zeros(1 << CELL_BITS, bool)
    marks[high["cell"].to_numpy(np.int64)] = True
    return marks


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    return W.shingle_sets(*W.hashes(column, W.spaces()), n)


def _linked(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys once each, with their smallest id; (id, smallest id) pairs of the rest."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(fresh)
    low = np.repeat(ids[heads], np.diff(np.append(heads, len(keys))))
    differ = ids != low
    pairs = np.unique(np.stack([ids[differ], low[differ]], 1), axis=0)
    return heads, order, pairs


def candidates(docs: DataFrame, text_col: str, n: int, classes: Classes) -> DataFrame:
    """(a, b): 64-bit names of sets that share a part."""
    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(common_cells(docs, text_col, n)))  # 2**CELL_BITS bits
    buckets = max(32, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(marks.value).astype(bool)
        for batch in slices(batches, 0):
            own = {digest(s): s for s in _sets(batch.column(0), n) if len(s)}
            names = np.array([int.from_bytes(d[:8], "big", signed=True) for d in own], np.int64)
            keys, owners = signatures(list(own.values()), classes, common)
            heads, order, pairs = _linked(keys, names[owners])
            keys, ids = keys[order][heads], names[owners][order][heads]
            at = (keys >> np.uint64(40)).astype(np.int64) * buckets >> 24  # keys are sorted, so buckets are too
            cuts = np.searchsorted(at, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            rows = [(int(k), keys[cuts[k] : cuts[k + 1]].tobytes() + ids[cuts[k] : cuts[k + 1]].tobytes(), b"") for k in used]
            if len(pairs):
                rows.append((int(abs(pairs[0, 0]) % buckets), b"", pairs.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "keys", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for blob, linked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                half = len(blob) // 16
                keys.append(np.frombuffer(blob, np.uint64, half))
                ids.append(np.frombuffer(blob, np.int64, half, half * 8))
                pairs.append(np.frombuffer(linked, np.int64).reshape(-1, 2))
        found = _linked(np.concatenate(keys), np.concatenate(ids))[2]
        found = np.unique(np.concatenate([found, *pairs]), axis=0)
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    blocks = map_batches(docs.select(docs[text_col].alias("_text")), deal, "bucket int, keys binary, pairs binary")
    return map_batches(blocks.repartition(buckets, "bucket"), meet, "a long, b long")


class Tile:
    """The sets of one tile in order of size, their bitmaps, and which pairs of them reach the threshold."""

    def __init__(self, arrays: list[np.ndarray], sides: list[int], least: Fraction):
        """Sides of a pair differ unless both are 0, which marks a tile of one block."""
        self.num, self.den = least.numerator, least.denominator
        self.sizes, self.sides = np.array([len(a) for a in arrays], np.int64), np.array(sides)
        bits = 256
        while bits < min(4 * int(self.sizes.max()), 16_384) and bits * len(arrays) < 1 << 25:
            bits *= 2
        grid = np.zeros((len(arrays), bits), bool)
        for k, a in enumerate(arrays):
            grid[k, (W.mix(a ^ W.salt(16)) % np.uint64(bits)).astype(np.int64)] = True
        self.maps = np.packbits(grid, axis=1).view(np.uint64)
        del grid
        # shingles by their rank in the tile: arrays stay sorted, and a mark tells whether a rank is in the array at hand
        self.ranks, self.ends = np.unique(np.concatenate(arrays), return_inverse=True)[1], np.cumsum(self.sizes)
        self.held = np.zeros(int(self.ranks.max()) + 1, bool)

    def near(self, i: int) -> np.ndarray:
        """The sets behind i whose size and side allow a link."""
        last = int(np.searchsorted(self.sizes, self.sizes[i] * self.den // self.num, side="right"))
        near = np.arange(i + 1, last)
        return near[self.sides[near] != self.sides[i]] if self.sides[i] else near

    def linked(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of the sets that link with i: bitmaps bound the overlap, arrays decide."""
        num, den, n = self.num, self.den, self.sizes[i]
        apart = np.bitwise_count(self.maps[near] ^ self.maps[i]).sum(1, dtype=np.int64)
        both = self.sizes[near] + n
        near = near[((both - apart) // 2) * (den + num) >= num * both]
        if not len(near):
            return near
        m = self.sizes[near]
        others = self.ranks[np.repeat(self.ends[near] - m - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        own = self.ranks[self.ends[i] - n : self.ends[i]]
        self.held[own] = True
        shared = np.add.reduceat(self.held[others], np.cumsum(m) - m, dtype=np.int64)
        self.held[own] = False
        return near[den * shared >= num * (m + n - shared)]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each cell that a shingle falls in; the number of cells is a power of two, 256 or more, not below the set's size."""
    cells = 1 << max(8, (len(shingles) - 1).bit_length() if len(shingles) else 0)
    bits = np.zeros(cells, bool)
    bits[(W.mix(shingles ^ W.salt(19)) & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class MapTile(Tile):
    """A tile of which only sizes and bitmaps are at hand: pairs that they allow to reach the threshold."""

    def __init__(self, sizes: list[int], bitmaps: list[bytes], sides: list[int], least: Fraction):
        self.num, self.den = least.numerator, least.denominator
        self.sizes, self.sides = np.array(sizes, np.int64), np.array(sides)
        self.widths = np.array([len(b) for b in bitmaps])
        # bitmaps by their own number of cells and, folded, by every smaller number in the tile
        self.folded: dict[int, np.ndarray] = {}
        for width in sorted(set(self.widths.tolist())):
            self.folded[width] = np.zeros((len(bitmaps), width // 8), np.uint64)
            for wider in sorted(w for w in set(self.widths.tolist()) if w >= width):
                at = np.flatnonzero(self.widths == wider)
                raw = np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint8).reshape(len(at), wider // width, width)
                self.folded[width][at] = np.ascontiguousarray(np.bitwise_or.reduce(raw, 1)).view(np.uint64)

    def linked(self, i: int, near: np.ndarray) -> np.ndarray:
        own = self.folded[int(self.widths[i])]
        apart = np.bitwise_count(own[near] ^ own[i]).sum(1, dtype=np.int64)
        both = self.sizes[near] + self.sizes[i]
        return near[((both - apart) // 2) * (self.den + self.num) >= self.num * both]


def grouped(tile: Tile, labels: list) -> list:
    """The labels once links have joined them, each the smallest of its group. Pairs with one label are not compared."""
    names = sorted(set(labels))
    place = {name: k for k, name in enumerate(names)}
    now = np.array([place[x] for x in labels], np.int64)
    for i in range(len(labels)):
        near = tile.near(i)
        near = near[now[near] != now[i]]
        if len(near) and len(found := tile.linked(i, near)):
            joined = np.unique(np.append(now[found], now[i]))
            now[np.isin(now, joined)] = joined[0]
    return [names[k] for k in now.tolist()]


def counted(arrays: list[np.ndarray], sides: list[int], weights: list[int], least: Fraction) -> list[int]:
    """Links of each set by weight."""
    tile, links, weight = Tile(arrays, sides, least), np.zeros(len(arrays), np.int64), np.array(weights, np.int64)
    for i in range(len(arrays)):
        near = tile.near(i)
        if len(near) and len(found := tile.linked(i, near)):
            links[i] += weight[found].sum()
            links[found] += weight[i]
    return links.tolist()


def _tiles(sets: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """(set, part, tile, side): the tiles that each set of a candidate component goes to.

    sets: set, part (its component), band, n. A component that fits in a block
    is one tile; others are tiled by band and hash.
    """
    bands = sets.groupBy("part", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    here = F.greatest(F.ceil(F.col("c") / F.lit(block_sets)), F.ceil(F.col("s") / F.lit(block_shingles))).cast("int")
    w = "over (partition by part order by band)"
    bands = bands.withColumn("k", here).selectExpr(
        "part", "band", "k",
        f"case when lead(band) {w} = band + 1 then lead(k) {w} else 0 end as up",
        f"case when lag(band) {w} = band - 1 then lag(k) {w} else 0 end as down",
        f"sum(c) over (partition by part) <= {block_sets} and sum(s) over (partition by part) <= {block_shingles} as whole",
    )
    placed = sets.join(bands, ["part", "band"]).withColumn("i", F.expr("case when whole then 0 else pmod(xxhash64(set), k) end"))
    key = lambda b, i, c, j: f"concat_ws(':', part, {b}, {i}, {c}, {j})"
    tiles = F.expr(
        f"""case when whole then array(struct(concat_ws(':', part, 'all') as tile, 0 as side))
        else concat(
          transform(sequence(0, k - 1), j -> if(j < i, struct({key("band", "j", "band", "i")} as tile, 2 as side), struct({key("band", "i", "band", "j")} as tile, if(j = i, 0, 1) as side))),
          transform(if(up > 0, sequence(0, up - 1), cast(array() as array<int>)), j -> struct({key("band", "i", "band + 1", "j")} as tile, 1 as side)),
          transform(if(down > 0, sequence(0, down - 1), cast(array() as array<int>)), j -> struct({key("band - 1", "j", "band", "i")} as tile, 2 as side))) end"""
    )
    return placed.withColumn("t", F.explode(tiles)).select("set", "t.tile", "t.side")


def _names(docs: DataFrame, id_col: str, text_col: str, n: int, classes: Classes) -> DataFrame:
    """(id, text hash, set, n, band, bitmap) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sets = _sets(batch.column(2), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digest(s) for s in sets], pa.binary()), pa.array(sizes), pa.array(classes.band(sizes).astype(np.int32)), pa.array([bitmap(s) for s in sets], pa.binary())], names=["_id", "_hash", "set", "n", "band", "bitmap"])

    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_hash"), docs[text_col].alias("_text"))
    return map_batches(rows, run, f"_id {kind}, _hash long, set binary, n long, band int, bitmap binary")


def _tile_by_tile(dealt: DataFrame, columns: list[str], judge, schema: str) -> DataFrame:
    """judge(rows of one tile) for every tile; rows are (side, set, *columns), each (set, side) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        tile = None
        for batch in batches:
            for at, side, name, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != tile and held:
                    yield judge([(side_, name_, *r) for (name_, side_), r in held.items()])
                    held.clear()
                tile = at
                held[name, side] = tuple(rest)
        if held:
            yield judge([(side_, name_, *r) for (name_, side_), r in held.items()])

    dealt = dealt.select("tile", "side", "set", *columns)
    return map_batches(dealt.repartition("tile").sortWithinPartitions("tile"), run, schema)


class Fields:
    """The sets that may link, and what happens to them in tiles."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, least: Fraction):
        self.docs, self.id_col, self.text_col, self.n, self.least = docs, id_col, text_col, n, least

    def tiles(self, chosen: DataFrame, columns: str, judge, schema: str) -> DataFrame:
        """judge(rows) of each tile; rows are (side, set, *columns, sorted array).

        chosen: _id and _hash of a row that has the set, set, the columns, and
        tiles, an array of (tile, side).
        """
        names = [c.split()[0] for c in columns.split(", ")]
        own = self.docs.select(self.docs[self.id_col].alias("_id2"), F.xxhash64(self.docs[self.text_col]).alias("_hash2"), self.docs[self.text_col].alias("_text"))
        found = own.join(small(chosen), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).select("set", *names, "tiles", "_text")
        n, width = self.n, len(names)

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, width + 2):
                arrays = _sets(batch.column(width + 2), n)
                same = pa.array([digest(a) == d for a, d in zip(arrays, batch.column(0).to_pylist(), strict=True)], pa.bool_())
                columns = [*batch.columns[: width + 2], pa.array([a.tobytes() for a in arrays], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["set", *names, "tiles", "shingles"]).filter(same)

        loaded = map_batches(found, load, f"set binary, {columns}, tiles array<struct<tile:string,side:int>>, shingles binary")
        dealt = loaded.select("set", *names, "shingles", F.inline("tiles"))

        def run(tile: list[tuple]) -> pa.RecordBatch:
            tile = sorted(tile, key=lambda r: (len(r[-1]), r[1]))
            return judge([(*r[:-1], np.frombuffer(r[-1], np.uint64)) for r in tile])

        return _tile_by_tile(dealt, [*names, "shingles"], run, schema)

    def maps(self, chosen: DataFrame, judge, schema: str) -> DataFrame:
        """judge(rows) of each tile; rows are (side, set, label, n, bitmap). chosen: set, label, n, bitmap and tiles."""

        def run(tile: list[tuple]) -> pa.RecordBatch:
            return judge(sorted(tile, key=lambda r: (r[3], r[1])))

        return _tile_by_tile(chosen.select("set", "label", "n", "bitmap", F.inline("tiles")), ["label", "n", "bitmap"], run, schema)

    def finer(self, near: DataFrame) -> DataFrame:
        """set, label: the sets that bitmaps allow to link, over any number of steps. near: set, part, band, n, bitmap."""
        least = self.least

        def judge(tile: list[tuple]) -> pa.RecordBatch:
            return _told([r[2] for r in tile], grouped(MapTile([r[3] for r in tile], [r[4] for r in tile], [r[0] for r in tile], least), [r[2] for r in tile]))

        return self._spanned(near, lambda chosen: cut(self.maps(chosen, judge, "old binary, new binary")), MAP_SETS, MAP_SHINGLES)

    def groups(self, near: DataFrame) -> DataFrame:
        """set, label: the group of each set, by links that arrays decide. near: set, part, band, n, _id, _hash."""
        least = self.least

        def judge(tile: list[tuple]) -> pa.RecordBatch:
            return _told([r[2] for r in tile], grouped(Tile([r[-1] for r in tile], [r[0] for r in tile], least), [r[2] for r in tile]))

        return self._spanned(near, lambda chosen: cut(self.tiles(chosen, "label binary", judge, "old binary, new binary")), BLOCK_SETS, BLOCK_SHINGLES)

    def _spanned(self, near: DataFrame, joined, block_sets: int, block_shingles: int) -> DataFrame:
        """set, label by what joined(sets with their tiles) tells of each tile: old and new labels."""
        state = cut(near.withColumn("label", F.col("set")))
        split, tries = None, 0  # split: the fields of several blocks, in which not all sets have met
        while True:  # blocks of all sets, then of the heads of their groups, while that joins most of them
            heads = state.filter(F.col("set") == F.col("label"))
            if split is not None:
                heads = heads.join(split, "part")
            sizes = heads.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter("c > 1")
            sizes = cut(sizes.select("part", _blocks("c", "s", block_sets, block_shingles).alias("k")))
            if sizes.isEmpty():
                return state.select("set", "label")
            tile = F.struct(F.concat_ws(":", "part", F.pmod(F.xxhash64("set", F.lit(tries)), "k")).alias("tile"), F.lit(0).alias("side"))
            met = joined(heads.join(sizes, "part").withColumn("tiles", F.array(tile)))
            joins = met.filter("old <> new")
            state = cut(_relabelled(state, joins))
            several = sizes.filter("k > 1")
            if split is None:
                split = small(cut(several.select("part")))
            if several.isEmpty() or tries and 2 * joins.count() < met.count():
                break
            tries += 1
        open_ = state.join(split, "part").groupBy("part").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")
        open_ = cut(open_.select("part"))
        if open_.isEmpty():
            return state.select("set", "label")
        crossed = joined(self._crosswise(state.join(small(open_), "part"), block_sets, block_shingles))
        ends = components(crossed.select(F.col("old").alias("a"), F.col("new").alias("b")).distinct())
        return _relabelled(state, ends.select(F.col("node").alias("old"), F.col("label").alias("new"))).select("set", "label")

    def _crosswise(self, state: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
        """The sets that have still to meet, with their tiles: those outside a field's largest group with all others of their bands."""
        counts = state.groupBy("part", "label").agg(F.count(F.lit(1)).alias("c"))
        largest = counts.groupBy("part").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
        state = cut(state.join(largest, "part").withColumn("inner", F.col("label") == F.col("largest")).drop("largest"))
        inner, outer = (F.when(cond, x) for cond, x in ((F.col("inner"), F.lit(1)), (~F.col("inner"), F.lit(1))))
        bands = state.groupBy("part", "band").agg(F.count(inner).alias("ci"), F.sum(inner * F.col("n")).alias("si"), F.count(outer).alias("co"), F.sum(outer * F.col("n")).alias("so"))
        bands = bands.select("part", "band", F.when(F.col("ci") > 0, _blocks("ci", "si", block_sets, block_shingles)).otherwise(0).alias("ki"), F.when(F.col("co") > 0, _blocks("co", "so", block_sets, block_shingles)).otherwise(0).alias("ko"))
        w = "over (partition by part order by band)"
        step = lambda f, k, b: f"case when {f}(band) {w} = band {b} 1 then {f}({k}) {w} else 0 end"
        bands = bands.selectExpr("part", "band", "ki", "ko", f"{step('lead', 'ki', '+')} as ki_up", f"{step('lag', 'ki', '-')} as ki_down", f"{step('lead', 'ko', '+')} as ko_up", f"{step('lag', 'ko', '-')} as ko_down")
        placed = state.join(bands, ["part", "band"]).withColumn("i", F.expr("pmod(xxhash64(set), if(inner, ki, ko))"))
        block = lambda kind, band, i: f"concat('{kind}', {band}, '.', {i})"
        pair = lambda one, two, side: f"struct(concat_ws(':', part, {one}, {two}) as tile, {side} as side)"
        each = lambda k, f: f"transform(if({k} > 0, sequence(0, int({k} - 1)), cast(array() as array<int>)), j -> {f})"
        mine = block("o", "band", "i")
        with_outer = [each("ko", f"if(j < i, {pair(block('o', 'band', 'j'), mine, 2)}, {pair(mine, block('o', 'band', 'j'), 'if(j = i, 0, 1)')})"), each("ko_up", pair(mine, block("o", "band + 1", "j"), 1)), each("ko_down", pair(block("o", "band - 1", "j"), mine, 2))]
        with_inner = [each(k, pair(mine, block("i", band, "j"), 1)) for k, band in (("ki", "band"), ("ki_up", "band + 1"), ("ki_down", "band - 1"))]
        of_inner = [each(k, pair(block("o", band, "j"), block("i", "band", "i"), 2)) for k, band in (("ko", "band"), ("ko_up", "band + 1"), ("ko_down", "band - 1"))]
        return placed.withColumn("tiles", F.expr(f"if(inner, concat({', '.join(of_inner)}), concat({', '.join(with_outer + with_inner)}))")).filter("size(tiles) > 0")

    def links(self, near: DataFrame, labels: DataFrame) -> DataFrame:
        """set, links: rows that the set links with, itself left out; all pairs of a group meet. near: with weight."""
        groups = near.drop("part").join(labels.select("set", F.hex("label").alias("part")), "set")
        least = self.least

        def judge(tile: list[tuple]) -> pa.RecordBatch:
            n = counted([r[-1] for r in tile], [r[0] for r in tile], [r[2] for r in tile], least)
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in tile], pa.binary()), pa.array(n, pa.int64())], names=["set", "links"])

        tiled = _tiles(groups, BLOCK_SETS, BLOCK_SHINGLES).groupBy("set").agg(F.collect_list(F.struct("tile", "side")).alias("tiles"))
        return self.tiles(groups.join(tiled, "set"), "weight long", judge, "set binary, links long").groupBy("set").agg(F.sum("links").alias("links"))


def _told(old: list, new: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(old, pa.binary()), pa.array(new, pa.binary())], names=["old", "new"])


def _blocks(count: str, shingles: str, block_sets: int, block_shingles: int) -> Column:
    """How many blocks so many sets and shingles take."""
    return F.greatest(F.ceil(F.col(count) / F.lit(block_sets)), F.ceil(F.col(shingles) / F.lit(block_shingles))).cast("int")


def _relabelled(state: DataFrame, joins: DataFrame) -> DataFrame:
    """The sets with the new label of each old one."""
    return state.join(small(joins.select(F.col("old").alias("label"), "new").distinct()), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new").select(*state.columns)


def _judge(docs: DataFrame, id_col: str, text_col: str, n: int, least: Fraction, links: bool) -> tuple[DataFrame, DataFrame]:
    """Names of all rows, and (set, weight, component, head, links) of the sets that have copies or links."""
    classes, fields = Classes(least), Fields(docs, id_col, text_col, n, least)
    parts = components(candidates(docs, text_col, n, classes)).select("node", F.col("label").alias("part"))
    rows = cut(_names(docs, id_col, text_col, n, classes))
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")
    sets = cut(rows.filter("n > 0").groupBy("set", "n", "band").agg(F.count(F.lit(1)).alias("weight"), F.min(first).alias("first"), F.min("bitmap").alias("bitmap")))
    name = F.conv(F.substring(F.hex("set"), 1, 16), 16, -10).cast("long")
    near = cut(sets.withColumn("node", name).join(parts, "node").select("set", "part", "band", "n", "bitmap", "first._id", "first._hash", "weight"))
    field = fields.finer(near.select("set", "part", "band", "n", "bitmap"))
    near = cut(near.drop("part", "bitmap").join(field.select("set", F.hex("label").alias("part")), "set"))
    labels = cut(fields.groups(near.drop("weight")))
    told = sets.filter("weight > 1").select("set").union(labels.select("set")).distinct()
    known = sets.join(told, "set").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    if links:
        known = known.join(fields.links(near, labels), "set", "left")
    known = cut(known)
    heads = known.groupBy("label").agg(F.min("first._id").alias("component"), F.min("first").alias("head"))
    more = (F.coalesce("links", F.lit(0)) if links else F.lit(0)) + F.col("weight") - 1
    return rows, cut(known.join(cut(heads), "label").select("set", "weight", "component", "head", more.alias("links")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, least: Fraction = Fraction(9, 10), links: bool = False) -> DataFrame:
    """id, n_shingles, component_id, n_copies (rows with the same set, itself included) of every row; links: also n_links, the rows that it links with."""
    rows, sets = _judge(docs, id_col, text_col, n, least, links)
    out = rows.select("_id", "set", "n").join(sets, "set", "left")
    known = F.col("weight").isNotNull()
    columns = [F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(known, F.col("component")).otherwise(F.col("_id")).alias("component_id"), F.when(known, F.col("weight")).otherwise(F.when(F.col("n") > 0, 1).otherwise(0)).cast("long").alias("n_copies")]
    return out.select(*columns, *([F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest id."""
    rows, sets = _judge(docs, id_col, text_col, n, least, False)
    gone = rows.filter("n > 0").join(sets, "set").filter(~(F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("_hash") == F.col("head._hash")))).select("_id", "_hash").distinct()
    gone = small(cut(gone))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti")


def op2_jaccard_join(spark, sf_dir):
    from millrace.runtime import table

    return join(table(spark, sf_dir, "documents"))
