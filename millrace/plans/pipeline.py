"""The two-pass cleaning pipelines: profile, then clean with the profile's values.

``clean_table`` is the full pipeline: exact duplicates out, missing cells
imputed, outliers flagged, texts normalised, categories merged, near duplicates
flagged. ``clean_worker`` is the row-wise variant with changes, provenance and
confidence. Both take a DataFrame with a row number and return DataFrames; the
first pass is two small jobs, the second one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.functions import hashing, text
from millrace.operators import clean, dedupe, lineage, profile, report, shape
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampling moduli of the three intensities.
PRESETS = {
    "light": {"numeric_every": 50, "mode_every": 100, "lsh_every": 200, "sample_every": 50},
    "medium": {"numeric_every": 20, "mode_every": 40, "lsh_every": 100, "sample_every": 20},
    "intense": {"numeric_every": 10, "mode_every": 20, "lsh_every": 50, "sample_every": 10},
}


@dataclass
class Result:
    """What a pipeline gives: the clean rows and what was done."""

    cleaned: DataFrame
    stats: dict
    near: DataFrame | None = None
    before: DataFrame | None = None
    changes: DataFrame | None = None
    provenance: DataFrame | None = None
    scores: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def release(self) -> None:
        """Let go the rows without duplicates, which are kept on the executors' disks for the several actions of a run; lost ones are computed again."""
        self.extra["kept"].unpersist()


def clean_table(df: DataFrame, row_id: str = "row_id", intensity: str = "intense", near_threshold: float | None = 0.85, merge: bool = True, lower: bool = True, keep_punctuation: bool = True, drop_outliers: bool = False, family: str = "sha256") -> Result:
    """The full pipeline. Hashes cover all columns but the row number. family: the near duplicates' hashes, see minhash."""
    every = PRESETS[intensity]
    columns = [c for c in df.columns if c != row_id]
    stats = profile.as_dict(profile.profile(df, row_id, every["numeric_every"], every["mode_every"]))
    kept = dedupe.keep_first(df, hashing.row_hash([F.col(f"`{c}`") for c in columns]), row_id).persist(StorageLevel.DISK_ONLY)
    stats = profile.fallbacks(kept, stats, row_id)
    filled = clean.impute(kept, stats)
    numbers = [c for c in shape.columns_of(df, "int", "bigint", "smallint", "tinyint", "double", "float", "decimal") if c != row_id]
    flagged = clean.outlier_flags(filled, numbers) if numbers else filled
    words = shape.columns_of(df, "string")
    out = clean.strip_columns(flagged, words)
    if lower:
        out = clean.lower_columns(out, words, keep_punctuation)
    if merge:
        out = clean.merge_categories(out, words, row_id)
    near = None
    if near_threshold is not None and columns:
        line = text.snippet([F.lower(F.col(f"`{c}`").cast("string")) for c in columns])
        near = dedupe.near_duplicates(out, line, row_id, threshold=near_threshold, every=every["lsh_every"], family=family)
    if drop_outliers:
        out = clean.drop_outliers(out)
    return Result(out, stats, near, df, extra={"kept": kept})


def report_of(result: Result, row_id: str = "row_id", every: int = 10) -> dict:
    """The report of a full pipeline, with the first rows before and after."""
    figures = report.summary(result.before, result.cleaned, result.near)
    before = [r.asDict() for r in shape.head(result.before, row_id, 5, every).collect()]
    after = [r.asDict() for r in shape.head(result.cleaned, row_id, 5).collect()]
    return report.document(figures, result.stats, before, after, (dict(result.before.dtypes), dict(result.cleaned.dtypes)))


def clean_worker(df: DataFrame, row_id: str = "row_id", capacity: int | None = None, job_id: str = "job", near_threshold: float | None = None, exclude: tuple[str, ...] = ("id",), every: int = 1, lsh_every: int = 50, seen: DataFrame | None = None) -> Result:
    """The row-wise pipeline. Hashes leave out the row number and the excluded columns; modes fill before medians.

    Provenance has a record for each changed cell and one for each row that went
    as an exact duplicate. Changes are told from the same projection that cleans.
    every: rows that vote on types and give medians and modes, all of them unless
    capacity bounds the cells of a column; seen: row hashes of earlier jobs
    (row_hash), whose rows go as duplicates.
    """
    columns = [c for c in df.columns if c != row_id]
    stats = profile.worker_profile(df, columns, row_id, every, capacity)
    hashed = hashing.content_hash(df.drop(row_id), exclude)
    kept, repeats = dedupe.keep_first(df, hashed, row_id), dedupe.repeats(df, hashed, row_id)
    if seen is not None:
        known = seen.select(F.col("row_hash").alias("_seen")).distinct()
        repeats = repeats.union(kept.join(known, hashed == F.col("_seen"), "left_semi"))
        kept = kept.join(known, hashed == F.col("_seen"), "left_anti")
    kept = kept.persist(StorageLevel.DISK_ONLY)
    cells = clean.row_cells(kept, stats, skip=(row_id,))
    cleaned = kept.select(*[cell.alias(c) for c, cell in cells.items()])
    changed = lineage.changed(lineage.cell_pairs(lineage.side_by_side(kept, cells, row_id, columns)))
    near, extra = None, {"kept": kept}
    if near_threshold is not None:
        line = text.snippet([F.col(f"`{c}`") for c in columns])
        extra["samples"] = dedupe.lsh_samples(cleaned, line, row_id, lsh_every)
        near = dedupe.near_duplicates(cleaned, line, row_id, threshold=near_threshold, every=lsh_every)
    flags = clean.impute(kept, stats, ("mode", "median"), empty_is_missing=True)
    scores = lineage.confidence_scores(flags, row_id, [c for c in flags.columns if c.endswith("_was_imputed")], near)
    records = lineage.records(changed, job_id).unionByName(lineage.duplicate_records(repeats, row_id, job_id))
    extra["hashes"] = kept.select(hashed.alias("row_hash"), F.col(row_id).alias("first_seen_row"))
    return Result(cleaned, stats, near, df, changed, records, scores, extra)
