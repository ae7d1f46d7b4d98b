"""Decision tables as columns: table quality, trust, processing routes, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds of the table rules, and the extraction warnings that become issues
SPARSE_RATIO, SPARSE_CELLS, LONG_TEXT_RATIO, LOW_CONFIDENCE = 0.5, 4, 0.5, 0.65
WARNINGS = (
    "duplicate_column_names", "possible_multirow_header", "possible_title_row", "irregular_row_width", "possible_table_structure_loss",
    "possible_column_shift", "possible_header_loss", "possible_merged_cells", "image_table_extractor_error",
)


def review_source(source_format: Column, source_kind: Column, extractor: Column) -> Column:
    """Tables that a reader has drawn from pages or pictures need review whatever their cells say."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (low(source_format) == "pdf") | low(source_kind).isin("image", "page") | low(extractor).contains("ocr") | low(extractor).contains("img2table")


def table_issues(rows: Column, columns: Column, empty_ratio: Column, long_ratio: Column, review: Column, irregular: Column, confidence: Column, complete: Column | None = None, warnings: Column | None = None) -> Column:
    """The sorted distinct issues of a table; ``complete`` provenance and extraction ``warnings`` if they are known."""
    cells = rows * columns
    found = F.array_compact(
        F.array(
            F.when(~complete, "incomplete_table_provenance") if complete is not None else F.lit(None).cast("string"),
            F.when((empty_ratio >= SPARSE_RATIO) & (cells >= SPARSE_CELLS), F.when(review, "sparse_ocr").otherwise("sparse_table")),
            F.when(review & (long_ratio >= LONG_TEXT_RATIO), "possible_table_structure_loss"),
            F.when(irregular, "irregular_row_width"),
            F.when(review & (columns == 1), "suspicious_single_column"),
            F.when(review & (rows == 1), "suspicious_single_row"),
            F.when(confidence < LOW_CONFIDENCE, "low_ocr_confidence"),
        )
    )
    if warnings is not None:
        found = F.concat(found, F.array_intersect(F.coalesce(warnings, F.array().cast("array<string>")), F.array(*map(F.lit, WARNINGS))))
    return F.when((rows == 0) | (columns == 0), F.array(F.lit("empty_table"))).otherwise(F.array_sort(F.array_distinct(found)))


def text_issues(stripped_chars: Column, extractor: Column, confidence: Column, complete: Column) -> Column:
    """The sorted issues of a text: an empty one has only that."""
    found = F.array_compact(F.array(F.when(~complete, "incomplete_text_provenance"), F.when(stripped_chars < 20, "low_content"), F.when(confidence < LOW_CONFIDENCE, "low_ocr_confidence")))
    return F.when(stripped_chars == 0, F.array(F.lit("empty_text"))).otherwise(F.array_sort(found))


def text_issue_status(issues: Column, extractor: Column) -> Column:
    return F.when(F.array_contains(issues, "empty_text"), "unusable").when((F.size(issues) > 0) | F.lower(extractor).contains("ocr"), "needs_review").otherwise("ready")


def table_status(issues: Column, review: Column) -> Column:
    return F.when(F.array_contains(issues, "empty_table"), "unusable").when((F.size(issues) > 0) | review, "needs_review").otherwise("ready")


def candidate(source_kind: Column, extractor: Column) -> Column:
    """Tables that were only seen on pages or pictures."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(source_kind).isin("page", "image") | low(extractor).contains("img2table")


def trust(status: Column, candidate: Column) -> Column:
    """unusable, candidate_only, confirmed or best_effort."""
    return F.when(status.isin("unusable", "fail"), "unusable").when(candidate, "candidate_only").when(status.isin("ready", "pass"), "confirmed").otherwise("best_effort")


def overlap_share(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of box a that lies in box b."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    return F.try_divide(w * h, (ax1 - ax0) * (ay1 - ay0))


def iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0)
    return F.try_divide(w * h, area - w * h)
