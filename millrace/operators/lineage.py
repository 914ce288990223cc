"""What cleaning did: changes, provenance, confidence, worker statistics, audit filters."""

from __future__ import annotations

from millrace.functions import quality
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side_by_side(df: DataFrame, cells: dict[str, Column], row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(row_id, o, n): original and cleaned cells of each row, for cleaning that is a projection of df; no join."""
    columns = columns or [c for c in df.columns if c != row_id and c in cells]
    return df.select(F.col(row_id).alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("o"), F.struct(*[cells[c].alias(c) for c in columns]).alias("n"))


def cell_pairs(both: DataFrame) -> DataFrame:
    """(row_id, column_name, original_value, cleaned_value, kind) of all cells of rows side by side."""
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"o.`{c}`").cast("string").alias("original_value"), F.col(f"n.`{c}`").cast("string").alias("cleaned_value"), quality.change_kind(F.col(f"o.`{c}`"), F.col(f"n.`{c}`")).alias("kind"))
    return both.select("row_id", F.inline(F.array(*[cell(c) for c in both.schema["o"].dataType.names])))


def paired(before: DataFrame, after: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """cell_pairs of two tables, rows paired by number with a join."""
    columns = columns or [c for c in before.columns if c != row_id and c in after.columns]
    old = before.select(F.col(row_id).alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("o"))
    new = after.select(F.col(row_id).alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("n"))
    return cell_pairs(old.join(new, "row_id"))


def changed(pairs: DataFrame) -> DataFrame:
    """The changed cells with their kind."""
    return pairs.filter("kind is not null")


def changes(before: DataFrame, after: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """The changed cells of two tables with their kind."""
    return changed(paired(before, after, row_id, columns))


def records(changes: DataFrame, job_id: str = "job", source: str = "clean") -> DataFrame:
    """A provenance record for each changed cell: values, transformation and confidence."""
    score = F.when(F.col("kind") == "imputation", 0.9).otherwise(1.0)
    return changes.select(F.lit(job_id).alias("job_id"), "row_id", "column_name", "original_value", "cleaned_value", F.lit("cleaned").alias("transformation_id"), score.alias("confidence_score"), F.lit(source).alias("source"))


def provenance(before: DataFrame, after: DataFrame, row_id: str, job_id: str = "job", source: str = "clean", columns: list[str] | None = None) -> DataFrame:
    """The records of two tables."""
    return records(changes(before, after, row_id, columns), job_id, source)


def duplicate_records(dropped: DataFrame, row_id: str, job_id: str = "job", source: str = "clean") -> DataFrame:
    """A record for each row that went as an exact duplicate: all of its columns, confidence 0."""
    none = F.lit(None).cast("string")
    return dropped.select(F.lit(job_id).alias("job_id"), F.col(row_id).alias("row_id"), F.lit("*").alias("column_name"), none.alias("original_value"), none.alias("cleaned_value"), F.lit("exact_duplicate").alias("transformation_id"), F.lit(0.0).alias("confidence_score"), F.lit(source).alias("source"))


def confidence_scores(rows: DataFrame, row_id: str, imputed: list[str], near: DataFrame | None = None) -> DataFrame:
    """(row_id, confidence) from the imputation flags and the near-duplicate pairs."""
    any_imputed = F.greatest(*[F.col(f"`{c}`").cast("int") for c in imputed], F.lit(0)) > 0
    if near is None:
        return rows.select(F.col(row_id).alias("row_id"), quality.confidence(any_imputed, F.lit(False)).alias("confidence"))
    risk = near.select(F.col("row_id").alias("_near")).distinct()
    return rows.join(risk, F.col(row_id) == F.col("_near"), "left").select(F.col(row_id).alias("row_id"), quality.confidence(any_imputed, F.col("_near").isNotNull()).alias("confidence"))


def worker_stats(total: DataFrame, kept: DataFrame, changed: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: rows kept and dropped, changes by kind, the share kept, the mean confidence."""
    n = total.agg(F.count(F.lit(1)).alias("rows_total"))
    k = kept.agg(F.count(F.lit(1)).alias("rows_kept"))
    c = changed.agg(F.count_if(F.col("kind") == "imputation").alias("imputations"), F.count_if(F.col("kind") == "normalization").alias("normalizations"))
    s = scores.agg(F.avg("confidence").alias("mean_confidence"))
    one = n.join(k, how="full", on=F.lit(True)).join(c, on=F.lit(True)).join(s, on=F.lit(True))  # one row each
    return one.select("rows_total", "rows_kept", (F.col("rows_total") - F.col("rows_kept")).alias("rows_dropped"), "imputations", "normalizations", (F.col("rows_kept") / F.col("rows_total")).alias("deduplication_rate"), "mean_confidence")


def needs_review(records: DataFrame, low: float = 0.0, high: float = 0.95) -> DataFrame:
    """Records whose confidence lies in the range, ends included."""
    return records.filter(F.col("confidence_score").between(low, high))


def audit_filter(log: DataFrame, action: str | None = None, job_id: str | None = None) -> DataFrame:
    """Audit records of an action and a job."""
    if action is not None:
        log = log.filter(F.col("action") == action)
    return log if job_id is None else log.filter(F.col("job_id") == job_id)
