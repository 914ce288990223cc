"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined three times: inside each map task (Spark's partial
aggregation), over salted digest groups, and over the winners of all salts.
The grouping key of every stage holds the full text beside its digest, so two
texts with one digest never merge, and a group that holds a third of all rows
arrives at the last stage as at most one row per salt. Rows learn of their group
by digest and salt too, and rows without a copy need not learn anything.

Defined cases: a null text counts as empty; a null id loses to every other id
(a group of null ids keeps id null); rows that repeat one id and text are
copies of each other, of which exactly one stays; an empty table gives an
empty result; ids are of any type that has an order; texts of any length are
compared whole; further columns are ignored by ``decide`` and carried by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from millrace.runtime import cut
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of a group; a group that holds a third of all rows is dealt over so many keys.
SALTS = 256


def sha256(text: Column) -> Column:
    """Binary digest of a text's UTF-8 bytes."""
    return F.unhex(F.sha2(text, 256))


def _salt(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), digest(text).alias("_digest"), _salt(F.col(id_col)).alias("_s"))
    salted = rows.groupBy("_digest", "_s", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    texts = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.collect_set("_s").alias("_salts"))
    # groups of several rows, once for each salt that they have: all that the rows need to learn
    by_digest = [F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.first("_salts").alias("_salts")]
    found = cut(texts.groupBy("_digest").agg(*by_digest).filter("_n > 1"))
    if found.filter("_texts > 1").isEmpty():  # the stages above compared texts: each digest stands for one text
        thin = docs.select(F.col(id_col).alias("_id"), digest(text).alias("_digest"), _salt(F.col(id_col)).alias("_s"), F.sha2(text, 256).alias("text_sha256"))
        placed = thin.join(found.select("_digest", F.explode("_salts").alias("_s"), "_keep", "_n"), ["_digest", "_s"], "left")
    else:
        groups = texts.filter("_n > 1").select("_digest", F.explode("_salts").alias("_s"), "_text", "_keep", "_n")
        placed = rows.join(groups, ["_digest", "_s", "_text"], "left").withColumn("text_sha256", F.sha2("_text", 256))
    alone = F.col("_n").isNull()
    placed = placed.select("_id", "text_sha256", F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"))
    placed = placed.repartition("_id")  # by id, not by digest, and so no group meets in a task
    once = F.expr("row_number() over (partition by _id, text_sha256 order by _n)") == 1
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & once).alias("kept"),
        "text_sha256",
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id.

    Of rows that repeat an id and text, any one whole row stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    best = F.max_by("_rest", F.struct(F.col("_id").isNotNull(), "_id")).alias("_rest")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), digest(text).alias("_digest"), rest.alias("_rest"))
    salted = rows.groupBy("_digest", _salt(F.col("_id")).alias("_s"), "_text").agg(best, F.max("_id").alias("_id"))
    whole = salted.repartition("_digest").groupBy("_digest", "_text").agg(best)
    back = {c: F.col(f"_rest.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("_rest._null"), F.col("_text"))}
    return whole.select(*[back[c].alias(c) for c in docs.columns])


def op8_exact_dedup(spark, sf_dir):
    from millrace.runtime import table

    return decide(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
