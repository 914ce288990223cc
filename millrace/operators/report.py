"""Reports: cleaning summary and normalization accuracy."""

from __future__ import annotations

from millrace.functions import numeric
from millrace.operators.dedupe import ratio
from millrace.operators.lineage import paired
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(original: DataFrame, cleaned: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """One row of figures: row counts, near duplicates, imputed cells and outliers by column."""
    imputed = [c for c in cleaned.columns if c.endswith("_was_imputed")]
    outliers = [c for c in cleaned.columns if c.endswith("_is_outlier")]
    sums = [F.coalesce(F.sum(F.col(f"`{c}`").cast("long")), F.lit(0)).alias(c) for c in imputed + outliers]
    one = original.agg(F.count(F.lit(1)).alias("original_row_count")).join(cleaned.agg(F.count(F.lit(1)).alias("cleaned_row_count"), *sums), on=F.lit(True))
    flagged = F.lit(0).cast("long")
    if near is not None:
        one = one.join(near.agg(F.count(F.lit(1)).alias("_near")), on=F.lit(True))
        flagged = F.col("_near")
    return one.select("original_row_count", "cleaned_row_count", (F.col("original_row_count") - F.col("cleaned_row_count")).alias("rows_dropped_total"), flagged.alias("near_duplicates_flagged"), *[F.col(f"`{c}`") for c in imputed + outliers])


def document(figures: DataFrame, stats: dict[str, dict], before: list[dict], after: list[dict], schemas: tuple[dict, dict]) -> dict:
    """The report as a nested dict of collected figures."""
    row = figures.first().asDict()
    return {
        "summary": {k: row[k] for k in ("original_row_count", "cleaned_row_count", "rows_dropped_total", "near_duplicates_flagged")},
        "schema": {"original_schema_sample": schemas[0], "cleaned_schema_sample": schemas[1], "numeric_cols_detected": [c for c, s in stats.items() if s["is_numeric"]], "text_cols_detected": [c for c, s in stats.items() if not s["is_numeric"]]},
        "cleaning_details": {"imputed_counts": {k[: -len("_was_imputed")]: v for k, v in row.items() if k.endswith("_was_imputed")}, "outliers_flagged": {k[: -len("_is_outlier")]: v for k, v in row.items() if k.endswith("_is_outlier")}},
        "global_stats_used": {"medians": {c: s["median"] for c, s in stats.items() if s.get("median") is not None}, "modes": {c: s["mode"] for c, s in stats.items() if s.get("mode") is not None}},
        "samples": {"before_sample": before, "after_sample": after},
    }


def normalization_accuracy(before: DataFrame, after: DataFrame, row_id: str, columns: list[str], how: str = "ratio") -> DataFrame:
    """One row: cells, changed cells, their share in percent, mean similarity of text cells; rows paired by number."""
    cells = paired(before, after, row_id, columns).withColumns({"a": F.coalesce("original_value", F.lit("")), "b": F.coalesce("cleaned_value", F.lit(""))})
    words = ~numeric.looks_numeric(F.col("a")) & ~numeric.looks_numeric(F.col("b"))
    similar = ratio(F.col("a"), F.col("b")) if how == "ratio" else 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1))
    out = cells.agg(F.count(F.lit(1)).alias("total_cells"), F.count_if(F.col("a") != F.col("b")).alias("changed_cells"), F.avg(F.when(words, similar)).alias("mean_text_similarity"))
    return out.withColumn("percent_changed", 100 * F.col("changed_cells") / F.col("total_cells"))
