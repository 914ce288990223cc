"""Whitening of embeddings by the covariance of their distinct vectors.

Entries become whole numbers first, floor(64 * entry) + 1000000, so that counts,
sums and deviations from the mean are exact. Rows centred with them go to
MLlib's RowMatrix, whose Gramian divided by their number is the covariance; its
eigenvectors are found on the driver (a matrix of dimensions, not of rows) and
sent to all tasks, which project the centred rows on them.

Copies of a vector count once in the fit: they meet by partial aggregation
before the shuffle, so a vector that a third of all rows share is one row.

Defined cases: rows whose vector is null or holds a null or non-finite entry
are let go; a shorter vector counts as if it ended in zeros; entries are held
within 2**40; a null id stays null, and rows that repeat an id are rows of their
own; a component without variance (beyond the rank, or of a single vector) has
whitened null, and explained null if there is no variance at all; a deviation
that no long holds is null; an empty table, or one of empty vectors, gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from millrace.runtime import cut, share_code, table
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of an entry's unit, what is added to make entries positive, components reported, and the bound of an entry.
STEPS, SHIFT, COMPONENTS, LARGEST = 64, 1_000_000, 16, 1 << 40


@dataclass
class Fit:
    """What the fit list tells: its length, sums by dimension, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whole(self) -> tuple[list[int], list[int]]:
        """Means rounded down, and what of the sums they leave."""
        means = [s // self.n for s in self.sums]
        return means, [s - self.n * m for s, m in zip(self.sums, means, strict=True)]

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first k components, NaN for those without variance."""
        e = self.values[:k]
        least = (self.values[0] if len(self.values) else 0.0) * len(self.values) * 1e-15
        return np.where(e > least, 1 / np.sqrt(np.where(e > least, e, 1)), np.nan)


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows that take part, with their entries as whole numbers."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", odd))
    held = lambda c: F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return rows.select("id", F.transform("v", lambda c: F.floor(held(c) * STEPS) + SHIFT).alias("x"))


def as_long(rows: DataFrame, d: int) -> DataFrame:
    """Rows whose x has d entries, shorter ones filled up with zeros."""
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("x"))))


def fit(rows: DataFrame) -> tuple[Fit | None, DataFrame]:
    """The fit to the distinct vectors of rows (x), and these; None if there are none."""
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    own = cut(as_long(rows.select("x"), d).distinct())
    if not d:
        return None, own
    n = own.count()
    sums = {r["pos"]: int(r["s"]) for r in own.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()}  # a row a dimension
    out = Fit(n, [sums[k] for k in range(d)], np.zeros(d), np.eye(d), 0.0)
    covariance = _gramian(own.select(_centred(F.col("x"), out).alias("v"))) / n
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, out.sums, np.maximum(values[::-1], 0), vectors[:, ::-1], float(np.trace(covariance))), own


def _centred(x: Column, f: Fit) -> Column:
    """x - S / n: the numerator n * x - S as an exact long, divided once."""
    means, rest = f.whole()
    shift = F.lit([int(m) for m in means]).cast("array<bigint>")
    left = F.zip_with(x, shift, lambda a, m: (a - m) * F.lit(f.n).cast("bigint"))
    return F.zip_with(left, F.lit([int(r) for r in rest]).cast("array<bigint>"), lambda a, r: (a - r).cast("double") / float(f.n))


def _gramian(rows: DataFrame) -> np.ndarray:
    """The sum of v v' over rows (v, an array), by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col("v")).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(rows: DataFrame, f: Fit, k: int = COMPONENTS) -> DataFrame:
    """(id, deviation, whitened) of rows (id, x): the first k components, NaN where there is no variance."""
    spark = rows.sparkSession
    share_code(spark)
    means, rest = f.whole()
    k = min(k, len(f.values))
    sent = spark.sparkContext.broadcast((np.array(means, np.int64), np.array(rest, np.int64), f.vectors[:, :k] * f.scales(k)))
    n, kind = f.n, rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, left, project = sent.value
        for frame in frames:
            if len(frame):
                from_mean = np.stack(frame["x"].to_numpy()) - mean
                yield pd.DataFrame({"id": frame["id"], "deviation": deviations(from_mean, left, n), "whitened": list(((from_mean * float(n) - left) / n) @ project if _exact(from_mean, n) else (from_mean - left / n) @ project)})

    named = as_long(rows, len(f.values)).select(F.col("id").cast("string").alias("id"), "x")  # as text, since pandas would make numbers with nulls floats
    return named.mapInPandas(run, "id string, deviation decimal(38,0), whitened array<double>").select(F.col("id").cast(kind).alias("id"), F.col("deviation").try_cast("bigint").alias("deviation"), "whitened")


def _exact(from_mean: np.ndarray, n: int) -> bool:
    """Whether n times these numbers are whole in doubles."""
    return (int(np.abs(from_mean).max(initial=0)) + 1) * n < 1 << 53


def deviations(from_mean: np.ndarray, left: np.ndarray, n: int) -> list:
    """The sums of (n * x - S) squared as exact decimals, null beyond 38 digits."""
    from decimal import Decimal

    largest = (int(np.abs(from_mean).max(initial=0)) + 1) * n
    kind = np.int64 if largest * largest * max(1, from_mean.shape[1]) < 1 << 63 else object
    off = from_mean.astype(kind) * n - left.astype(kind)
    return [Decimal(int(v)) if v < 10**38 else None for v in (off * off).sum(1)]


def identity_error(own: DataFrame, f: Fit, k: int = COMPONENTS) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured on its rows; 0 if no component has variance."""
    with_variance = int((~np.isnan(f.scales(k))).sum())
    if not with_variance:
        return 0.0
    white = cut(whiten(own.select(F.lit(None).cast("string").alias("id"), "x"), f, with_variance).select(F.col("whitened").alias("v")))
    means = {r["pos"]: r["m"] for r in white.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).collect()}
    mean = F.lit([float(means[j]) for j in range(with_variance)])
    covariance = _gramian(white.select(F.zip_with("v", mean, lambda a, m: a - m).alias("v"))) / f.n
    return float(np.abs(covariance - np.eye(with_variance)).max())


def whitened_rows(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row that takes part and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(df, id_col, vector_col)
    found, own = fit(rows)
    kind = df.schema[id_col].dataType.simpleString()
    if found is None:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(own, found, k)
    shares = [float(e / found.trace) if found.trace > 0 else None for e in found.values[:k]]
    out = whiten(rows, found, k).select("id", "deviation", F.posexplode("whitened").alias("pos", "w"))
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("pos") + 1)
    whitened = F.when(~F.isnan("w"), F.col("w"))
    return out.select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir):
    return whitened_rows(table(spark, sf_dir, "embeddings"))
