"""Mixing sources to target weights, in DataFrame operations only.

The words of each source's documents, in an order by hash, make one long line
that is packed into blocks of ``block`` words (the last one may be shorter). A
mix is a row of slots, each of which takes one block; about sqrt(slots) slots
make an output shard. Every slot of a shard draws its source with the odds of
the sources' quotas, so the counts of a shard are a multinomial draw. What a
source has drawn over its quota in all shards is handed to sources that drew too
little, so that quotas are met to the block. The j-th slot of a source takes
block P(j mod n) of its n blocks, where P is a permutation of 0 to n - 1 of its
own for every pass, computed and never stored: a Feistel network on a rectangle
that holds n cells, walked again from cells beyond n. Slots and blocks then meet
by (source, index).

Quotas: targets are ``weight`` shares of ``share`` times all words. A target
stops at ``most`` times its source's size and the excess goes to the others by
weight, until none is above. A quota is the target in blocks, rounded; no block
is taken more than ``most`` times, and so no document either.

A source may hold any share of the rows: documents lie in about sqrt(rows)
hash buckets of their source and slots in about sqrt(slots) shards, each of
which is ranked by itself; only bucket and shard totals are summed in order.

Defined cases: a null or blank text has size 0 and is taken 0 times; null is a
source of its own, the last one; a source without words has target 0; rows that
repeat an id are documents of their own; an empty table gives an empty result;
further columns are ignored, whatever their names. The result depends on ids,
sources, texts and the seed, not on partitions or on the session.
"""

from __future__ import annotations

from dataclasses import dataclass

from millrace.llm.sizes import ROWS, light
from millrace.runtime import cut, table
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, the weights that sources get in turn, what is taken of all words and of a source at most.
BLOCK, WEIGHTS, SHARE, MOST, SEED = 64, (5, 2, 1), 1.5, 2, 13
#: Keys that a hot source is dealt over where documents meet their source.
SALTS = 64


@dataclass
class Mix:
    """documents: a row each with what is taken. slots: (shard, slot, source, pass, block), the mix. pieces: (source, block, doc_id, word, words), of which documents blocks are made."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(id_col), size, F.col(text_col))
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), mark.alias("mark")))  # texts are read once
    sources = quotas(_targets(sized, weights, share, most), most, block)
    few = light(sources)
    rows = _with_source(sized, sources, few)
    lined = cut(_lined(rows.filter("size > 0")))
    slots = cut(_slots(sources, seed, few))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = lined.select("s", "id", "size", "start", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.withColumns({"word": begin - F.col("start"), "words": end - begin})
    times = slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    met = parts.join(times, ["s", "block"], "left")
    taken = met.groupBy("s", "start", "id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
    names = sources.select("s", "source", "source_size", "target")
    whole = taken.unionByName(rows.filter("size = 0").select("s", "id", "size", F.lit(0).cast("long").alias("taken")))
    names = F.broadcast(names) if few else names
    documents = whole.join(names, "s").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "source")
    mixed = slots.join(names, "s").select("shard", "slot", "source", "pass", "block")
    return Mix(documents, mixed, parts.join(names, "s").select("source", "block", F.col("id").alias(id_col), "word", "words"))


def _targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(s, source, source_size, n, weight, target) of each source, numbered by code point with null last."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    numbered = _running(ranged, F.lit(1), order, "s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = cut(numbered.select("s", "source", "source_size", "n", weight.alias("weight")))
    least, level = F.col("source_size") * float(most), _level(rows, share, most)
    return rows.withColumn("target", F.least(least, F.col("weight") * level) if level is not None else least)


def _level(rows: DataFrame, share: float, most: int) -> float | None:
    """Words a unit of weight, so that targets stopped at most times their source's size make up the share; None if all stop.

    Sources that stop leave more for the others, so that the level only rises
    and a round in which no further source stops is the last.
    """
    total, free, stopped = None, None, 0
    while True:
        if total is None:
            row = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
            total, weight = share * (row["size"] or 0), row["weight"] or 0
        else:
            row = rows.agg(F.sum(F.when(over, F.col("source_size") * most)).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
            stopped, weight = row["size"] or 0, row["weight"] or 0
        if not weight or total <= stopped:
            return None if total else 0.0
        if weight == free:
            return (total - stopped) / weight
        free, over = weight, F.col("source_size") * float(most) < F.col("weight") * F.lit((total - stopped) / weight)


def quotas(targets: DataFrame, most: int, block: int) -> DataFrame:
    """The targets with each source's blocks, its quota of them, and where its quota begins among all (``first``)."""
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    quota = F.least(blocks * most, F.round(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("long"))
    ranged = cut(targets.withColumn("blocks", blocks).withColumn("quota", quota).repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    return cut(_running(ranged, F.col("quota"), [F.col("s")], "first"))


def _running(ranged: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """The sum of value over all rows before, for rows that lie in ranges (part): summed in each range, and over the ranges' totals."""
    totals = ranged.groupBy("part").agg(F.sum(value).alias("_total"))
    before = totals.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_before"))  # a row a partition
    own = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - value
    return ranged.join(F.broadcast(before), "part").withColumn(name, (own + F.col("_before")).cast("long")).drop("part", "_before")


def _with_source(sized: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Documents with the number and rows of their source: by broadcast if the sources are few and short, else by keys dealt over SALTS."""
    known = sources.select("source", "s", "n")
    if few:
        return sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop("source")
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sized.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))
    return salted.join(dealt, salted["source"].eqNullSafe(dealt["source"]) & (salted["salt"] == dealt["salt"])).drop("source", "salt")


def _lined(rows: DataFrame) -> DataFrame:
    """(s, id, size, start): where each document begins in the line of its source."""
    bucket = F.pmod(F.col("mark"), F.ceil(F.sqrt("n")).cast("long"))
    dealt = rows.withColumn("bucket", bucket)
    totals = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("_total"))
    before = totals.select("s", "bucket", (F.sum("_total").over(Window.partitionBy("s").orderBy("bucket")) - F.col("_total")).alias("_before"))
    order = Window.partitionBy("s", "bucket").orderBy("mark", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("s", "bucket", "id", "size", (F.sum("size").over(order) - F.col("size")).alias("_own"))
    return own.join(before, ["s", "bucket"]).select("s", "id", "size", (F.col("_own") + F.col("_before")).alias("start"))


def _slots(sources: DataFrame, seed: int, few: bool) -> DataFrame:
    """(shard, slot, s, pass, block) of all slots. few: whether what has a row a source may be broadcast."""
    small = F.broadcast if few else lambda df: df
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    shard = max(1, round(total**0.5))
    drawn = spark.range(total).withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))))
    drawn = _found(drawn, sources.select("s", "first", F.col("quota").alias("length")), shard, few).select("id", "s", F.expr(f"id div {shard}").alias("shard"))
    counts = drawn.groupBy("s", "shard").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("s").orderBy("shard")
    before = counts.select("s", "shard", (F.sum("_n").over(by) - F.col("_n")).alias("_before"))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("s", "shard").orderBy("id")))
    nth = cut(ranked.join(before, ["s", "shard"]).select("id", "s", (F.col("_before") + F.col("_r") - 1).alias("j")))
    had = nth.groupBy("s").agg(F.count(F.lit(1)).alias("_had"))
    sums = sources.join(had, "s", "left").select("s", "quota", "blocks", F.coalesce("_had", F.lit(0)).alias("had"))
    sums = sums.withColumns({"over": F.greatest(F.col("had") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("had"), F.lit(0))})
    ranged = cut(sums.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    over = _running(ranged, F.col("over"), [F.col("s")], "at0").select("s", "quota", "blocks", "at0")
    under = _running(ranged.filter("under > 0"), F.col("under"), [F.col("s")], "first").select("s", "first", F.col("under").alias("length"), "had")
    known = nth.join(small(over), "s")
    kept = known.filter("j < quota").select("id", "s", "j", "blocks")
    spare = known.filter("j >= quota").select("id", (F.col("at0") + F.col("j") - F.col("quota")).alias("at"))
    given = _found(spare, under, shard, few).select("id", "s", (F.col("had") + F.col("at") - F.col("first")).alias("j"))
    given = given.join(small(over.select("s", "blocks")), "s").select("id", "s", "j", "blocks")
    placed = kept.unionByName(given).selectExpr("id", "s", "j div blocks as pass", "j % blocks as v", "blocks as n")
    return placed.select(F.expr(f"id div {shard}").alias("shard"), F.expr(f"id % {shard}").alias("slot"), "s", "pass", permuted(seed).alias("block"))


def _found(rows: DataFrame, spans: DataFrame, step: int, few: bool) -> DataFrame:
    """Rows with the one span, from first on for a length, that holds their number ``at``: an equi-join on the steps that a span touches.

    There are at most ``step`` steps, so with few spans their touched steps are few too.
    """
    tiles = spans.filter("length > 0").withColumn("_tile", F.explode(F.sequence(F.expr(f"first div {step}"), F.expr(f"(first + length - 1) div {step}"))))
    near = rows.withColumn("_tile", F.expr(f"at div {step}")).join(F.broadcast(tiles) if few and step <= ROWS else tiles, "_tile")
    return near.filter("at >= first and at < first + length").drop("_tile")


def permuted(seed: int) -> Column:
    """Where the permutation of source s and pass sends v, of n cells, from columns of these names.

    A cell (v mod a, v div a) of the rectangle of a times b >= n cells goes
    through eight half rounds that shift one side by a hash of the other. From a
    cell beyond n it goes on, at most as often as there are such cells; with
    n > 4096 one of 64 cells at most lies beyond, and 16 times in a row none will.
    """
    a, b = "cast(ceil(sqrt(n)) as bigint)", "cast(ceil(n / ceil(sqrt(n))) as bigint)"
    step = f"""aggregate(sequence(0, 7), named_struct('x', w % {a}, 'y', w div {a}), (t, r) -> if(r % 2 = 0,
      named_struct('x', (t.x + pmod(xxhash64({seed}, s, pass, r, t.y), {a})) % {a}, 'y', t.y),
      named_struct('x', t.x, 'y', (t.y + pmod(xxhash64({seed}, s, pass, r, t.x), {b})) % {b})), t -> t.y * {a} + t.x)"""
    walk = f"if(n > 4096, 16, {a} * {b} - n + 1)"
    return F.expr(f"aggregate(sequence(1, cast({walk} as int)), cast(v as bigint), (w, k) -> if(k > 1 and w < n, w, {step}))")


def op13_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken", "source")
