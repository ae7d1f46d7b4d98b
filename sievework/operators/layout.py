"""Geometry of page blocks: reading order, line joining, suppression, table regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.rules import iou, overlap_share

# fixed values: thresholds of layout rules
LINE_GAP, ROW_GAP, COLUMN_GAP, SHORT_BLOCK, GRID_LINES = 3.0, 4.0, 12.0, 40, 4
LOW_TEXT, SCAN_SHARE, INSIDE_SHARE = 20, 0.35, 0.55
WIDE_CELL, TALL_CELL, LONG_CELL, LONG_SHARE, LOW_CONFIDENCE = 1.6, 1.8, 160, 0.6, 0.65


def reading_order(blocks: DataFrame, page: str, sequence: str) -> DataFrame:
    """Blocks (page, sequence, x0, y0, ...) with their zero-based place on the page; boxless ones come last."""
    w = Window.partitionBy(page).orderBy(F.col("y0").isNull(), F.round("y0", 3), F.round("x0", 3), sequence)
    return blocks.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


def mean_in_order(value: Column, *order: Column) -> Column:
    """The mean of a group's values that aren't null, added up in an order, so that it is the same however rows are dealt out."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("double").alias("v"))
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), row)))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["v"]), F.size(rows))


def sheet_order(tables: DataFrame, file: str) -> DataFrame:
    """Tables of workbooks with their place: by sheet, then by the region's first row and column, name and id."""
    w = Window.partitionBy(file).orderBy(F.col("sheet_index").asc_nulls_last(), F.col("row_start").asc_nulls_last(), F.col("column_start").asc_nulls_last(), F.col("name").asc_nulls_last(), "id")
    return tables.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


def document_order(parts: DataFrame, file: str) -> DataFrame:
    """Paragraphs and tables of a document with their place; at one place text comes before tables."""
    w = Window.partitionBy(file).orderBy(F.col("document_order").asc_nulls_last(), F.col("kind") == "table", "id")
    return parts.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


def join_lines(words: DataFrame, page: str, sequence: str, text: str = "text") -> DataFrame:
    """Neighbouring words of one line become one text: (page, line, line_text)."""
    w = Window.partitionBy(page).orderBy(sequence)
    tall = F.least(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(w))
    near = F.abs(F.col("y0") - F.lag("y0").over(w)) <= F.greatest(F.lit(LINE_GAP), tall / 2)
    right = F.col("x0") >= F.lag("x0").over(w) - 2
    flags = words.withColumn("__new", F.when(F.coalesce(near & right, F.lit(False)), 0).otherwise(1))
    lined = flags.withColumn("line", F.sum("__new").over(w).cast("bigint"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(sequence, text))), lambda x: x[text])
    return lined.groupBy(page, "line").agg(F.array_join(parts, " ").alias("line_text"))


def outside_tables(texts: DataFrame, tables: DataFrame, page: str, share: float = INSIDE_SHARE) -> DataFrame:
    """Texts of which less than ``share`` lies in any table box of their page."""
    box = [F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1")]
    other = [F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")]
    inside = (F.col(f"t.{page}") == F.col(f"b.{page}")) & (overlap_share(*box, *other) >= share)
    return texts.alias("t").join(tables.alias("b"), inside, "left_anti")


def overlapping_pairs(boxes: DataFrame, page: str, key: str, least: float = 0.9) -> DataFrame:
    """(page, a, b, iou) of boxes of one page with at least that intersection over union."""
    a = [F.col(f"a.{c}") for c in ("x0", "y0", "x1", "y1")]
    b = [F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")]
    near = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    pairs = boxes.alias("a").join(boxes.alias("b"), near)
    value = F.round(iou(*a, *b), 6)
    return pairs.select(F.col(f"a.{page}").alias(page), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), value.alias("iou")).where(F.col("iou") >= least)


def row_bands(cells: DataFrame, sheet: str, row: str, value: str) -> DataFrame:
    """Runs of rows that hold a value: (sheet, band, first_row, last_row)."""
    rows = cells.where(F.col(value).isNotNull() & (F.trim(value) != "")).select(sheet, row).distinct()
    w = Window.partitionBy(sheet).orderBy(row)
    island = rows.withColumn("__i", F.col(row) - F.row_number().over(w))
    bands = island.groupBy(sheet, "__i").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"))
    order = Window.partitionBy(sheet).orderBy("first_row")
    return bands.select(sheet, F.row_number().over(order).cast("bigint").alias("band"), "first_row", "last_row")


def regions(cells: DataFrame, sheet: str) -> DataFrame:
    """Table regions of sheets from filled cells (sheet, row, col, value, kind): bands of rows, in them bands of columns.

    (sheet, region, row_start, row_end, column_start, column_end, warnings, header), ends exclusive, places
    zero-based. A band ends at a row or column without any value. Cells are dealt out by sheet; a sheet's rows and columns, not its
    cells, are sorted in one task.
    """
    filled = cells.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    rows = filled.select(sheet, "row").distinct()
    rows = rows.withColumn("i", F.col("row") - F.row_number().over(Window.partitionBy(sheet).orderBy("row")))
    bands = rows.groupBy(sheet, "i").agg(F.min("row").alias("row_start"), (F.max("row") + 1).alias("row_end"))
    placed = filled.join(rows, [sheet, "row"]).join(bands, [sheet, "i"])
    cols = placed.select(sheet, "i", "col").distinct()
    cols = cols.withColumn("j", F.col("col") - F.row_number().over(Window.partitionBy(sheet, "i").orderBy("col")))
    placed = placed.join(cols, [sheet, "i", "col"])
    text = F.col("kind") == "string"
    # one row a line of the region first, so that no window holds its cells
    lines = placed.groupBy(sheet, "i", "j", "row_start", "row_end", "row").agg(F.count("*").alias("n"), F.bool_and(text).alias("text"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    first, second = F.col("row") == F.col("row_start"), F.col("row") == F.col("row_start") + 1
    found = lines.groupBy(sheet, "i", "j", "row_start", "row_end").agg(
        F.min("c0").alias("column_start"),
        F.max("c1").alias("column_end"),
        F.coalesce(F.max(F.when(first, F.col("n"))), F.lit(0)).alias("n_first"),
        F.coalesce(F.max(F.when(~first, F.col("n"))), F.lit(0)).alias("n_later"),
        F.coalesce(F.bool_and(F.when(first, F.col("text"))), F.lit(True)).alias("first_text"),
        F.coalesce(F.bool_and(F.when(first | second, F.col("text"))), F.lit(True)).alias("two_text"),
        F.coalesce(F.bool_or(F.when(~first & ~second, ~F.col("text"))), F.lit(False)).alias("later_other"),
    )
    title = (F.col("n_first") == 1) & (F.col("n_later") > 1)
    double = (F.col("row_end") - F.col("row_start") >= 3) & F.col("two_text") & F.col("later_other")
    several = F.col("__n") > 1
    order = Window.partitionBy(sheet).orderBy("row_start", "column_start")
    count = found.groupBy(sheet).agg(F.count("*").alias("__n"))
    warned = F.array_compact(F.array(F.when(title, "possible_title_row"), F.when(title, "ambiguous_table_boundary"), F.when(double, "possible_multirow_header"), F.when(several, "multiple_table_regions")))
    header = (F.col("n_first") >= 2) & F.col("first_text") & ~title & ~double
    out = found.join(count, sheet)
    return out.select(sheet, (F.row_number().over(order) - 1).cast("bigint").alias("region"), "row_start", "row_end", "column_start", "column_end", warned.alias("warnings"), header.alias("header"))


def page_profile(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages from rows (keys, kind, chars, effective, area, page_area[, width, height]): text, images, coverage, grid, scan.

    Kinds: text, image, drawing. A drawing counts as a grid line if its smaller side is up to 2 and its larger 4 or more.
    """
    image, text = F.col("kind") == "image", F.col("kind") == "text"
    share = lambda c: F.coalesce(F.least(F.lit(1.0), F.try_divide(F.sum(F.when(c, F.col("area")).otherwise(0.0)), F.max("page_area"))), F.lit(0.0))
    grid = F.lit(False)
    if "width" in blocks.columns:
        grid = (F.col("kind") == "drawing") & (F.least("width", "height") <= 2) & (F.greatest("width", "height") >= 4)
    effective = F.col("effective") if "effective" in blocks.columns else F.col("chars")
    g = blocks.groupBy(*keys).agg(
        F.sum(F.when(text, F.col("chars")).otherwise(0)).alias("chars"),
        F.sum(F.when(text, effective).otherwise(0)).alias("effective"),
        F.count_if(text).alias("blocks"),
        F.count_if(image).alias("images"),
        F.round(share(image), 6).alias("image_share"),
        F.round(share(text), 6).alias("text_share"),
        F.count_if(grid).alias("grid_lines"),
    )
    low = F.col("effective") < LOW_TEXT
    return g.withColumn("native_text", F.col("effective") > 0).withColumn("suspected_scan", (F.col("images") > 0) & low & (F.col("image_share") >= SCAN_SHARE))


def table_hints(blocks: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """(keys, aligned, many_short) of pages from text blocks (keys, sequence, x0, y0, effective).

    Blocks form a row if they are within 4 points below the row's first one; rows of three or more count. A page is
    aligned if three places of its first such row come again within 12 points in later rows.
    """
    listed = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", sequence))).alias("b"), F.count("*").alias("n"), F.count_if(F.col("effective") <= SHORT_BLOCK).alias("short"))
    # the rows of one page: a fold over its sorted blocks, a page's blocks being few
    start = F.array().cast("array<struct<y:double,xs:array<double>>>")

    def step(rows: Column, b: Column) -> Column:
        last = F.element_at(rows, -1)
        same = (F.size(rows) > 0) & (b["y0"] - last["y"] <= ROW_GAP)
        grown = F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["xs"], F.array(b["x0"])).alias("xs"))))
        return F.when(same, grown).otherwise(F.concat(rows, F.array(F.struct(b["y0"].alias("y"), F.array(b["x0"]).alias("xs")))))

    rows = F.filter(F.aggregate(F.transform("b", lambda b: F.struct(b["y0"].cast("double").alias("y0"), b["x0"].cast("double").alias("x0"))), start, step), lambda r: F.size(r["xs"]) >= 3)
    page = listed.select(*keys, "n", "short", rows.alias("rows"))
    later = F.flatten(F.transform(F.slice("rows", 2, F.greatest(F.lit(0), F.size("rows") - 1)), lambda r: r["xs"]))
    again = F.size(F.filter(F.col("rows")[0]["xs"], lambda x: F.exists(later, lambda y: F.abs(x - y) <= COLUMN_GAP)))
    aligned = (F.size("rows") >= 2) & (F.coalesce(again, F.lit(0)) >= 3)
    out = page.select(*keys, "n", "short", F.coalesce(aligned, F.lit(False)).alias("aligned"))
    return out.select(*keys, "aligned", (F.col("aligned") & (F.col("short") >= 8) & (F.col("short") / F.col("n") >= 0.7)).alias("many_short"))


def document_class(pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, scanned, native, class, reason) from page profiles with native_text and suspected_scan."""
    g = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if("suspected_scan").alias("scanned"), F.count_if("native_text").alias("native"))
    scanned, native, n = F.col("scanned"), F.col("native"), F.col("pages")
    rules = [
        ((scanned > 0) & (native > 0), "mixed", "native_and_suspected_scanned_pages"),
        ((scanned > 0) & (scanned * 2 >= n), "suspected_scanned", "most_pages_have_scanned_signal"),
        (native == n, "native_text", "all_pages_have_native_text"),
        (native > 0, "mixed", "text_and_blank_pages"),
    ]
    kind, reason = F.lit("unknown"), F.lit("no_native_text_and_no_scanned_consensus")
    for condition, k, r in reversed(rules):
        kind, reason = F.when(condition, k).otherwise(kind), F.when(condition, r).otherwise(reason)
    return g.select(key, "pages", "scanned", "native", kind.alias("class"), reason.alias("reason"))


def table_pages(pages: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Pages whose tables are looked for: hinted ones of native and mixed documents, all of unknown ones."""
    rows = pages.join(classes.select(key, "class"), key)
    return rows.where((F.col("class").isin("native_text", "mixed") & F.col("table_hint")) | (F.col("class") == "unknown"))


def ocr_pages(pages: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Pages without native text to recognise, with the reason."""
    rows = pages.join(classes.select(key, "class"), key).where(~F.col("native_text"))
    wanted = F.col("suspected_scan") | F.col("class").isin("mixed", "suspected_scanned", "unknown")
    return rows.where(wanted).withColumn("reason", F.when(F.col("suspected_scan"), "suspected_scanned_page").otherwise("mixed_page_without_native_text"))


def vision_pages(pages: DataFrame) -> DataFrame:
    """Pages for a vision model: suspected scans without any native text."""
    return pages.where(F.col("suspected_scan") & ~F.col("native_text"))


def layout_hint(tables: Column, chars: Column) -> Column:
    """webpage_like, table_dominant, document or other."""
    chars = F.coalesce(chars, F.lit(0))
    return F.when((tables > 0) & (chars >= 250), "webpage_like").when(tables > 0, "table_dominant").when(chars > 0, "document").otherwise("other")


def scaled(box: list[Column], image: tuple[Column, Column], page: tuple[Column, Column], rotation: Column) -> Column:
    """A box in pixels as page points; null on rotated pages or without the image's size."""
    known = (rotation == 0) & (image[0] > 0) & (image[1] > 0)
    fx, fy = F.try_divide(page[0], image[0]), F.try_divide(page[1], image[1])
    return F.when(known, F.struct(*[(v * f).alias(n) for v, f, n in zip(box, (fx, fy, fx, fy), ("x0", "y0", "x1", "y1"), strict=True)]))


def table_flags(cells: DataFrame, keys: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """(keys, flags) of recognised tables from cells (keys, row, col, value[, width, height]) and text blocks (keys, confidence[, place]).

    Confidences are added up in order of ``place``, if it is there. Cells are all places of the rows as read, filled or not. Medians are exact, over one table's cells.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    filled = F.length(value) > 0
    lines = cells.groupBy(*keys, "row").agg(F.count("*").alias("w"), F.count_if(filled).alias("f"), F.count_if(filled & (F.length("value") >= LONG_CELL)).alias("long"))
    g = lines.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.max("w").alias("widest"),
        F.min("w").alias("narrowest"),
        F.sum("w").alias("cells"),
        F.sum("f").alias("filled"),
        F.sum("long").alias("long"),
        F.coalesce(F.max(F.when(F.col("row") == 0, F.col("f"))), F.lit(0)).alias("head"),
    )
    merged = F.lit(False)
    if "width" in cells.columns:
        sizes = cells.where("width is not null").groupBy(*keys).agg(F.count("*").alias("boxes"), F.median("width").alias("mw"), F.max("width").alias("xw"), F.median("height").alias("mh"), F.max("height").alias("xh"))
        g = g.join(sizes, keys, "left")
        merged = (F.col("boxes") >= 4) & (((F.col("mw") > 0) & (F.col("xw") > F.col("mw") * WIDE_CELL)) | ((F.col("mh") > 0) & (F.col("xh") > F.col("mh") * TALL_CELL)))
    unsure, unread = F.lit(False), F.lit(False)
    if blocks is not None:
        mean = mean_in_order(F.col("confidence"), F.col("place")) if "place" in blocks.columns else F.avg("confidence")
        g = g.join(blocks.groupBy(*keys).agg(mean.alias("sure"), F.lit(True).alias("read")), keys, "left")
        unsure, unread = F.col("sure") < LOW_CONFIDENCE, F.col("read").isNull()
    flags = {
        "suspicious_single_column": F.col("widest") <= 1,
        "suspicious_single_row": F.col("rows") <= 1,
        "possible_column_shift": F.col("widest") != F.col("narrowest"),
        "severe_raggedness": (F.col("rows") >= 3) & (F.col("widest") >= 3) & (F.col("narrowest") <= F.greatest(F.lit(1), F.floor(F.col("widest") / 2))),
        "sparse_ocr": (F.col("filled") < F.greatest(F.lit(2), F.floor((F.col("cells") + 1) / 2))) | unread,
        "possible_table_structure_loss": (F.col("filled") > 0) & (F.col("long") >= LONG_SHARE * F.col("filled")),
        "possible_header_loss": (F.col("head") == 0) & (F.col("filled") > 0),
        "possible_merged_cells": merged,
        "low_ocr_confidence": unsure,
    }
    return g.select(*keys, F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()])).alias("flags"))


def native_table_flags(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flags) of tables of native pages: single column or row, rows of differing width, merged cells."""
    lines = cells.groupBy(*keys, "row").agg(F.count("*").alias("w"))
    g = lines.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("w").alias("widest"), F.min("w").alias("narrowest"))
    sizes = cells.where("width is not null").groupBy(*keys).agg(F.count("*").alias("boxes"), F.median("width").alias("mw"), F.max("width").alias("xw"))
    g = g.join(sizes, keys, "left")
    flags = {
        "suspicious_single_column": (F.col("widest") == 1) & (F.col("rows") >= 2),
        "suspicious_single_row": (F.col("rows") == 1) & (F.col("widest") >= 2),
        "possible_column_shift": F.col("widest") != F.col("narrowest"),
        "possible_merged_cells": (F.col("boxes") >= 4) & (F.col("mw") > 0) & (F.col("xw") > F.col("mw") * WIDE_CELL),
    }
    return g.select(*keys, F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()])).alias("flags"))


def vision_warnings(names: Column, rows: Column) -> Column:
    """Warnings of a table that a model has read: equal names, no rows, blank names."""
    low = F.transform(names, lambda n: F.lower(F.trim(F.coalesce(n, F.lit("")))))
    some = F.filter(low, lambda n: F.length(n) > 0)
    return F.array_compact(F.array(F.when(F.size(F.array_distinct(some)) < F.size(some), "duplicate_column_names"), F.when(rows == 0, "empty_table"), F.when(F.size(some) < F.size(low), "empty_column_header")))


def drop_repeats(candidates: DataFrame, image: str, order: str, least_iou: float = 0.9, least_similarity: float = 0.92) -> DataFrame:
    """Candidates (image, order, x0..y1, text) without those that repeat an earlier kept one of their image.

    Greedy by definition, so each image's candidates go through one function: some tens a picture, as a picture has few tables.
    """
    import pandas as pd

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        import difflib

        kept: list[int] = []
        frame = frame.sort_values(order).reset_index(drop=True)
        for i, a in frame.iterrows():
            repeated = False
            for j in kept if pd.notna(a["x0"]) else ():
                b = frame.loc[j]
                if pd.isna(b["x0"]):
                    continue
                w = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
                h = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
                union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
                if union > 0 and w * h / union >= least_iou and difflib.SequenceMatcher(None, a["text"] or "", b["text"] or "", autojunk=False).ratio() >= least_similarity:
                    repeated = True
                    break
            if not repeated:
                kept.append(i)
        return frame.loc[kept]

    return candidates.groupBy(image).applyInPandas(keep, candidates.schema)
