"""Readers of mixed files: inventory with types and routes, strict delimited text, workbooks."""

from __future__ import annotations

import csv
import fnmatch
import io
import os
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 64 * 1024
# fixed values: leading bytes of file types, what a container of parts holds, what is printable enough to be text
MAGIC = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "ole_compound": "D0CF11E0A1B11AE1"}
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
PARTS = {"xlsx": "xl/", "docx": "word/", "pptx": "ppt/"}
PRINTABLE = 0.85
MAX_CELLS = 100_000


def discover(root: str) -> Iterator[tuple[str, str, str | None]]:
    """(relative path, kind, issue) of what is below a local folder, as it is met: regular files, and what is left out and why.

    Kinds: file, skipped (links and odd files; no error), unreadable (a folder that can't be listed; the walk goes on).
    """
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield os.path.relpath(folder, root), "unreadable", e.__class__.__name__
            continue
        for e in entries:
            path = os.path.relpath(e.path, root)
            if e.is_symlink():
                yield path, "skipped", "symlink"
            elif e.is_dir(follow_symlinks=False):
                todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                yield path, "file", None
            else:
                yield path, "skipped", "not_regular"


def excluded(path: Column, patterns: list[str]) -> Column:
    """A relative path matches one of the patterns with *, ? and [..]."""
    own = [re.sub(r"\\[Zz]$", "", fnmatch.translate(p.strip("/"))) for p in patterns if p.strip()]
    return path.rlike(f"^(?:{'|'.join(own)})\\z") if own else F.lit(False)


def without_packages(files: DataFrame, path: str = "path") -> DataFrame:
    """Files without those inside of an unpacked office package: below a folder with its list of types and a part's folder."""
    folder = F.regexp_extract(path, r"^(.*?)/?\[Content_Types\]\.xml\z", 1)
    roots = files.where(F.col(path).endswith("[Content_Types].xml")).select(folder.alias("__root")).distinct()
    part = files.select(F.regexp_extract(path, r"^(?:(.*?)/)?(?:_rels|xl|word|ppt|docProps)/", 1).alias("__root"), F.regexp_like(F.col(path), F.lit(r"(?:^|/)(?:_rels|xl|word|ppt|docProps)/")).alias("__part")).where("__part")
    packages = roots.join(part.select("__root").distinct(), "__root", "left_semi")
    inside = (F.col("__root") == "") | F.expr(f"startswith({path}, concat(__root, '/'))")
    return files.join(F.broadcast(packages), inside, "left_anti")  # unpacked packages: few


def inventory(spark: SparkSession, root: str, exclude: str | list[str] | None = None) -> DataFrame:
    """(path, size, modified, sha256, detected, route and the whole policy) of every file below ``root``.

    ``exclude`` is a regular expression on the whole path, or a list of patterns on the path below ``root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if isinstance(exclude, str):
        files = files.where(~F.col("path").rlike(exclude))
    elif exclude:
        base = "/" + re.sub(r"^[a-z]+:/*", "", root.rstrip("/")).lstrip("/") + "/"
        files = files.where(~excluded(F.substring_index("path", base, -1), exclude))
    kind = detected_type(F.col("path"), F.col("content"))
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), kind.alias("detected"))
    plan = policy(F.col("detected"), extension(F.col("path")))
    return out.withColumn("plan", plan).select("*", "plan.*").drop("plan").withColumn("route", F.when(F.col("attempt_table"), "table").when(F.col("attempt_text"), "text").otherwise("unsupported"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\\\]+)\z", 1))


def _container(content: bytes | None) -> str | None:
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            names = {n.replace("\\", "/").casefold() for n in z.namelist()}
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return "corrupted_zip"
    if "[content_types].xml" in names:
        for kind, start in PARTS.items():
            if any(n.startswith(start) for n in names):
                return kind
    return "zip"


def detected_type(path: Column, content: Column) -> Column:
    """From the name, leading bytes, a container's directory, then the first text and the extension."""
    head = F.hex(F.substring(content, 1, 8))
    ext = extension(path)
    raw = F.try_validate_utf8(F.substring(content, 1, HEADER_BYTES).cast("string"))
    text = F.regexp_replace(raw, "^\ufeff", "")
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \r\n\t]]", ""))
    readable = text.isNotNull() & (F.length(raw) > 0) & ~F.contains(raw, F.lit("\0")) & ((F.length(text) == 0) | (F.length(text) - odd >= PRINTABLE * F.length(text)))
    start = F.regexp_replace(text, "^[\ufeff \t\r\n]+", "")
    low = F.lower(start)
    html = F.lit(False)
    for mark in ("<!doctype html", "<html", "<head", "<body"):
        html = html | low.startswith(mark)
    written = (
        F.when(html | F.contains(F.substring(low, 1, 4096), F.lit("<html")), "html")
        .when(low.startswith("<?xml") | ((ext == ".xml") & start.rlike(r"^<[A-Za-z_]")), "xml")
        .when((ext == ".css") & F.contains(start, F.lit("{")) & F.contains(start, F.lit("}")), "css")
        .when((ext == ".json") & (start.startswith("{") | start.startswith("[")), "json")
        .when(ext.isin(".csv", ".tsv"), "delimited_text")
        .when(ext.isin(".md", ".markdown"), "markdown")
        .otherwise("plain_text")
    )
    out = F.when(readable, written).otherwise("unknown")
    is_zip = F.lit(False)
    for magic in ZIP_MAGIC:
        is_zip = is_zip | head.startswith(magic)
    udf = F.pandas_udf(lambda v: v.map(_container), "string")
    # only archives are handed to Python
    out = F.when(is_zip, F.regexp_replace(udf(F.when(is_zip, content)), "^corrupted_zip$", "zip")).otherwise(out)
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return F.when(F.lower(path).endswith("zone.identifier"), "zone_identifier").otherwise(out)


# fixed values: what is tried for a format (table, text, recognition, vision), and why others are not
TRIED = {"pdf": "xxxx", "jpeg": "xxxx", "png": "xxxx", "xlsx": "x---", "docx": "xx--", "csv": "x---", "tsv": "x---", "xls": "x---", "txt": "-x--"}


def policy(detected: Column, ext: Column) -> Column:
    """Struct: support, source_format, attempt_table, attempt_text, may_ocr, may_vision, reason of a type and an extension."""
    d, e = F.lower(F.trim(detected)), F.lower(F.trim(ext))
    rules = [
        (d == "pdf", "pdf", None),
        (d.isin("jpeg", "jpg"), "jpeg", None),
        (d == "png", "png", None),
        ((e == ".xlsx") & d.isin("xlsx", "zip", "unknown"), "xlsx", None),
        ((e == ".docx") & d.isin("docx", "zip", "unknown", "plain_text"), "docx", None),
        (d == "pptx", None, "deferred_pptx"),
        ((e == ".tsv") & d.isin("delimited_text", "plain_text", "unknown"), "tsv", None),
        ((e == ".csv") & d.isin("delimited_text", "plain_text", "unknown"), "csv", None),
        ((d == "ole_compound") & (e == ".xls"), "xls", None),
        ((d == "ole_compound") & (e == ".doc"), None, "deferred_doc"),
        ((d == "ole_compound") & (e == ".ppt"), None, "deferred_ppt"),
        (d == "ole_compound", None, "unsupported_ambiguous_ole_container"),
        ((e == ".xls") & d.isin("unknown", "plain_text", "zip"), "xls", None),
        ((d == "plain_text") & e.isin(".css", ".htm", ".html", ".js", ".json", ".md", ".xml"), None, "unsupported_business_format"),
        ((d == "plain_text") & (e == ".txt"), "txt", None),
        (d == "plain_text", None, "unsupported_plain_text_extension"),
        (d.isin("css", "html", "json", "markdown", "unknown", "xml", "zip", "zone_identifier"), None, "unsupported_business_format"),
    ]
    names = ("attempt_table", "attempt_text", "may_ocr", "may_vision")

    def result(form: str | None, reason: str | None) -> Column:
        tried = TRIED[form] if form else "----"
        why = reason or f"supported_{form}_" + "_and_".join(n for n, t in zip(("table", "text"), tried, strict=False) if t == "x")
        flags = [F.lit(t == "x").alias(n) for n, t in zip(names, tried, strict=True)]
        return F.struct(F.lit("supported" if form else "unsupported").alias("support"), F.lit(form).cast("string").alias("source_format"), *flags, F.lit(why).alias("reason"))

    out = result(None, "unsupported_unknown_type")
    for condition, form, reason in reversed(rules):
        out = F.when(condition, result(form, reason)).otherwise(out)
    return out


def changed_while_read(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, size, modified) that differ between two listings around a scan, with their issue."""
    now = after.select("path", F.col("size").alias("__size"), F.col("modified").alias("__modified"))
    rows = before.join(now, "path")
    return rows.where(~F.col("size").eqNullSafe(F.col("__size")) | ~F.col("modified").eqNullSafe(F.col("__modified"))).select("path", F.lit("changed_during_scan").alias("issue"))


def content_health(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_values, chars, controls, unprintable, replacement, bad_ratio, valid) of cells' text: is an old workbook read right?"""
    v = F.col("value")
    n = lambda pattern: F.sum(F.length(v) - F.length(F.regexp_replace(v, pattern, "")))
    g = cells.where("value is not null").groupBy(*keys).agg(
        F.count("*").alias("n_values"),
        F.sum(F.length(v)).alias("chars"),
        n(r"[\x00-\x1F]").alias("controls"),
        n(r"[\p{C}\p{Z}&&[^ \t\r\n]]").alias("unprintable"),
        n("\ufffd").alias("replacement"),
    )
    bad = F.coalesce(F.try_divide(F.col("controls") + F.col("unprintable") + F.col("replacement"), F.col("chars")), F.lit(0.0))
    valid = (F.col("chars") == 0) | ((F.col("controls") < 0.01 * F.col("chars")) & (bad < 0.15))
    return g.select("*", F.round(bad, 4).alias("bad_ratio"), valid.alias("valid"))


def _decoded(raw: bytes) -> str | None:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def delimited(spark: SparkSession, root: str, delimiter: str = ",", glob: str = "*.csv") -> DataFrame:
    """(path, status, row, cells) of strict delimited files: UTF-8 or GB18030, every record as wide as the header.

    Row 0 is the header; a file of no bytes has no row. A file that breaks the rule is one row with its status and no cells; others are unhurt.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")

    def parse(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                text = _decoded(bytes(content))
                if text is None:
                    out.append((path, "undecodable", None, None))
                    continue
                try:
                    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))
                except csv.Error:
                    out.append((path, "malformed", None, None))
                    continue
                if not rows:
                    out.append((path, "empty_file", None, None))
                elif not rows[0]:
                    out.append((path, "no_header", None, None))
                elif any(len(r) != len(rows[0]) for r in rows):  # a blank line between is a record without fields
                    out.append((path, "ragged", None, None))
                else:
                    out += [(path, "ok", i, r) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "status", "row", "cells"]).astype({"row": "Int64"})

    return files.mapInPandas(parse, "path string, status string, row bigint, cells array<string>")


def as_table(rows: DataFrame, path: str) -> DataFrame:
    """One file of ``delimited`` as a table of strings; equal header names get __2, __3, ..."""
    header = rows.where((F.col("path") == path) & (F.col("row") == 0)).select("cells").first()
    if header is None:
        return rows.sparkSession.createDataFrame([], "empty string").drop("empty")
    names = clean_names(header.cells)
    body = rows.where((F.col("path") == path) & (F.col("row") > 0))
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def clean_names(header: list[str | None]) -> list[str]:
    """Column names: composed, stripped, white space to _, blanks numbered, repeats (of any case) marked."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(header):
        name = re.sub(r"\s+", "_", unicodedata.normalize("NFC", str(raw or "")).strip()).strip("_") or f"column_{i + 1:04d}"
        seen[name.casefold()] = k = seen.get(name.casefold(), 0) + 1
        out.append(name if k == 1 else f"{name}__{k}")
    return out


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for c in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}c"):
                m = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r", ""))
                v = c.find(f"{_MAIN}v")
                inline = c.find(f"{_MAIN}is")
                value = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else v.text if v is not None else None
                if m is None or value is None:
                    continue
                col = 0
                for ch in m[1]:
                    col = col * 26 + ord(ch) - 64
                out.append((sheet.rsplit("/", 1)[1][:-4], int(m[2]), col, shared[int(value)] if c.get("t") == "s" else value))
    return out


def workbook_cells(spark: SparkSession, root: str) -> DataFrame:
    """(path, status, sheet, row, col, value) of all filled cells of the workbooks below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root).select("path", "content")

    def parse(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(path, "ok", *c) for c in _sheet_cells(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
                    out.append((path, "corrupt", None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "status", "sheet", "row", "col", "value"]).astype({"row": "Int64", "col": "Int64"})

    return files.mapInPandas(parse, "path string, status string, sheet string, row bigint, col bigint, value string")


def _place(reference: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", reference)
    if not m:
        return None
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def _layout(content: bytes) -> list[tuple]:
    """(sheet, merged, hidden_rows, row_heights, column_widths, cells) of each sheet; cells: (row, col, format, align, formula)."""
    _rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        formats: list[tuple[str, str]] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            for xf in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf"):
                a = xf.find(f"{_MAIN}alignment")
                k = int(xf.get("numFmtId", 0))
                formats.append((own.get(k, "General" if k == 0 else f"builtin:{k}"), a.get("horizontal", "") if a is not None else ""))
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets.get(sheet.get(_rel), "")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if target not in names:
                continue
            root = ElementTree.fromstring(z.read(target))
            merged = [m.get("ref") for m in root.iter(f"{_MAIN}mergeCell") if m.get("ref")]
            hidden, heights, cells = [], {}, []
            for row in root.iter(f"{_MAIN}row"):
                r = int(row.get("r", 0))
                if row.get("ht"):
                    heights[r] = float(row.get("ht"))
                if row.get("hidden") in ("1", "true"):
                    hidden.append(r)
                for c in row.iter(f"{_MAIN}c"):
                    at, formula, style = _place(c.get("r", "")), c.find(f"{_MAIN}f"), int(c.get("s", 0))
                    if at and len(cells) < MAX_CELLS:
                        form, align = formats[style] if style < len(formats) else (None, None)
                        cells.append((*at, form, align or None, formula.text or "" if formula is not None else None))
            widths = {i: float(c.get("width")) for c in root.iter(f"{_MAIN}col") if c.get("width") for i in range(int(c.get("min", 0)), int(c.get("max", 0)) + 1) if i <= 16384}
            out.append((sheet.get("name"), merged, hidden, heights, widths, cells))
    return out


def workbook_layout(spark: SparkSession, root: str) -> DataFrame:
    """How the sheets of the workbooks below ``root`` are set: merged ranges, hidden rows, heights, widths, formats, formulas."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root).select("path", "content")
    cell = "array<struct<row:bigint,col:bigint,number_format:string,horizontal:string,formula:string>>"
    schema = f"path string, sheet string, merged array<string>, hidden_rows array<bigint>, row_heights map<bigint,double>, column_widths map<bigint,double>, cells {cell}"

    def parse(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(path, *x[:5], [dict(zip(("row", "col", "number_format", "horizontal", "formula"), c, strict=True)) for c in x[5]]) for x in _layout(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["path", "sheet", "merged", "hidden_rows", "row_heights", "column_widths", "cells"])

    return files.mapInPandas(parse, schema)
