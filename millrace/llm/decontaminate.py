"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Short items hide inside long documents, where the Jaccard similarity of the
whole sets says little, so the search asks for containment. The items are
partitioned by the size of their shingle sets; an item's sketch is its
bottom-k MinHash, the k smallest hashes of its set, with k one more than the
number of shingles that a match may lack. By the pigeonhole principle a document
that holds the asked share of an item holds a hash of the sketch, so the search
loses nothing; documents probe each partition that they have enough shingles
for, with those of their hashes that lie below the partition's largest sketch
hash. Each pair found is then verified on the shingles themselves: the pairs go
to the documents, whose texts are not shuffled unless the pairs are too many to
be broadcast. Items of one text are searched for once, and a document's set is
made once for all items found.

Words are runs of letters, marks and digits in lower case. A set holds the
distinct ``words``-word shingles; of fewer words, the whole sequence as one. So
an item of fewer words is held only by a document of just these words, and is
not searched for inside longer ones.

Defined cases: null or wordless texts and items match nothing; rows that
repeat an id are judged each, and a pair is reported once with the largest
overlap; texts of any length are searched whole; a document row is known by its
id and a 64-bit hash of its text; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from millrace.llm.sizes import small
from millrace.runtime import cut
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, SHARE = 5, 0.8


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(text: Column, n: int = WORDS) -> Column:
    """The distinct shingles as strings."""
    return _bound(words_of(text), lambda w: F.array_distinct(F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))).when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.expr("cast(array() as array<string>)"))))


def hashes(text: Column, n: int = WORDS) -> Column:
    """A 64-bit hash for each shingle of the text, repeats included."""

    def of(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, window).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _bound(words_of(text), of)


def windows(rows: DataFrame, n: int = WORDS, least: float = 1.0) -> DataFrame:
    """_id, _hash, n (how many), hash: the hashes of each row's text as rows, none of texts with fewer than least.

    Slices of the words, zipped, are compiled with what follows; a lambda over windows is interpreted word by word.
    Texts of few windows get no words, as a filter would be pushed below and split every text twice.
    """
    split = rows.select("_id", "_hash", words_of(F.col("_text")).alias("w"))
    words = F.when(F.size("w") >= n, F.col("w")).when(F.size("w") > 0, F.array(F.concat_ws(" ", "w")))
    many = F.greatest(F.size("w") - (n - 1), F.lit(1))
    own = split.select("_id", "_hash", many.alias("n"), F.when(many >= least, words).alias("w"))
    each = own.select("_id", "_hash", "n", F.inline(F.arrays_zip(*[F.slice("w", k + 1, F.col("n")) for k in range(n)])).alias(*[f"w{k}" for k in range(n)]))
    return each.select("_id", "_hash", "n", F.xxhash64(*[f"w{k}" for k in range(n)]).alias("hash"))  # nulls leave a hash as it is


def sketches(items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """_key, part (its size partition), size, hash: the bottom-k sketch of each item's text."""
    sized = items.select("_key", hashes(F.col("_text"), n).alias("h")).withColumn("h", F.array_sort(F.array_distinct("h"))).withColumn("size", F.size("h")).filter("size > 0")
    k = F.col("size") - F.ceil(F.col("size") * F.lit(share)) + 1
    part = F.floor(F.log2("size")).cast("int")
    return sized.select("_key", part.alias("part"), "size", F.explode(F.slice("h", F.lit(1), k.cast("int"))).alias("hash"))


def probes(rows: DataFrame, parts: list[tuple[int, int, float]], n: int = WORDS) -> DataFrame:
    """_id, _hash, part, hash of the rows, within the bounds of each part. parts: (part, largest hash, fewest shingles)."""
    parts = parts or [(-1, -(2**63), 1.0)]
    each = windows(rows, n, min(p[2] for p in parts)).filter(F.col("hash") <= F.lit(max(p[1] for p in parts)))
    own = F.array(*[F.when((F.col("hash") <= F.lit(top)) & (F.col("n") >= F.lit(least)), F.lit(part)) for part, top, least in parts])
    return each.select("_id", "_hash", "hash", F.explode(own).alias("part")).filter("part is not null")


def _texts(items: DataFrame, item_text_col: str) -> DataFrame:
    """(_key, _text): each text of the items once, so that items that repeat a text don't multiply the matches."""
    return items.select(F.md5(F.coalesce(item_text_col, F.lit(""))).alias("_key"), F.coalesce(item_text_col, F.lit("")).alias("_text")).dropDuplicates(["_key"])


def _held(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_text_col: str, n: int, share: float) -> DataFrame:
    """(id, hash of the text, key of an item's text, n_shared, n_item_shingles) of verified matches; a document row is its id and text."""
    own = _texts(items, item_text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))
    sketch = small(cut(sketches(own, n, share)))
    # one row for each power of two of item sizes: the largest sketch hash and the fewest shingles a match has
    parts = sketch.groupBy("part").agg(F.max("hash").alias("top"), F.min("size").alias("least")).collect()
    pairs = probes(rows, [(p["part"], p["top"], p["least"] * share) for p in parts], n).join(sketch, ["part", "hash"]).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_key").distinct()
    pairs = cut(pairs)
    found = small(cut(pairs.select("_id2", "_hash2").distinct()))  # few beside the documents, whose texts then stay where they are; joined by shuffle if they are many
    sets = own.select(F.col("_key").alias("_key2"), shingles(F.col("_text"), n).alias("_own"))
    once = rows.join(found, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left_semi").select("_id", "_hash", shingles(F.col("_text"), n).alias("_set"))
    held = once.join(small(pairs), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).join(sets, F.col("_key") == F.col("_key2"))
    shared = held.select("_id", "_hash", "_key", F.size(F.array_intersect("_set", "_own")).cast("long").alias("n_shared"), F.size("_own").cast("long").alias("n_item_shingles"))
    return shared.filter(F.col("n_shared") >= F.ceil(F.col("n_item_shingles") * F.lit(share)))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, share: float = SHARE) -> DataFrame:
    """(id, item, n_shared, n_item_shingles, containment) for each item of which a document holds the share."""
    named = items.select(F.col(item_col).alias("_item"), F.md5(F.coalesce(item_text_col, F.lit(""))).alias("_key")).distinct()
    held = _held(docs, items, id_col, text_col, item_text_col, n, share).join(named, "_key")
    best = held.groupBy("_id", "_item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("c"), "n_shared", "n_item_shingles")).alias("b"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "b.n_shared", "b.n_item_shingles", F.col("b.c").alias("containment"))


def keep(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    gone = small(cut(_held(docs, items, id_col, text_col, item_text_col, n, share).select("_id", "_hash").distinct()))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti")


def op3_decontaminate(spark, sf_dir):
    from millrace.runtime import table

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SETS = """
{name} AS (
  SELECT {id} AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {table}
), {name}_s AS (
  SELECT DISTINCT id, s FROM (
    SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {name})
)"""
ORACLE = f"""
WITH {_SETS.format(name="d", id="doc_id", table="documents")}, {_SETS.format(name="b", id="item_id", table="benchmark")},
n AS (SELECT id, count(*) AS n FROM b_s GROUP BY id)
SELECT d_s.id AS doc_id, b_s.id AS item_id, count(*) AS n_shared, n.n AS n_item_shingles, count(*) / n.n AS containment
FROM d_s JOIN b_s ON d_s.s = b_s.s JOIN n ON n.id = b_s.id
GROUP BY d_s.id, b_s.id, n.n HAVING count(*) >= ceil(n.n * 0.8)
"""
