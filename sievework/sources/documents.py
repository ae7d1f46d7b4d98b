"""Text documents: plain files and word-processor files as blocks with running offsets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as tx

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, status string, sequence bigint, kind string, text string"

#: A reader turns the bytes of a file into (kind, text) blocks; it raises ValueError for a broken file.
Reader = Callable[[bytes], Iterator[tuple[str, str]]]


def read_plain(content: bytes) -> Iterator[tuple[str, str]]:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            yield "text", content.decode(encoding)
            return
        except UnicodeDecodeError:
            continue
    raise ValueError("undecodable")


def read_word(content: bytes) -> Iterator[tuple[str, str]]:
    """Paragraphs and table rows in document order; merged cells repeat nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("corrupt") from e

    def words(node) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter())

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            yield "paragraph", words(node)
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                yield "row", "\t".join(" ".join(words(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc"))


def word_tables(content: bytes) -> list[list[tuple[int, int, int, int, str]]]:
    """Cells (row, column, row_span, column_span, text) of each table; merged cells are one, over the places that they take."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("corrupt") from e
    out = []
    for table in body.findall(f"{_W}tbl") if body is not None else ():
        cells: list[list] = []
        above: dict[int, list] = {}  # cells that go on downwards, by their first column
        for r, row in enumerate(table.findall(f"{_W}tr")):
            at, going = 0, {}
            for c in row.findall(f"{_W}tc"):
                span = c.find(f"{_W}tcPr/{_W}gridSpan")
                merge = c.find(f"{_W}tcPr/{_W}vMerge")
                width = max(1, int(span.get(f"{_W}val", "1") or 1)) if span is not None else 1
                kind = merge.get(f"{_W}val", "continue") if merge is not None else ""
                start = min((k for k in above if k >= at), default=None) if kind == "continue" else None
                if start is not None:
                    cell = above[start]
                    cell[2] += 1
                    going[start] = cell
                    at = start + cell[3]
                    continue
                text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p"))
                cell = [r, at, 1, width, text]
                cells.append(cell)
                if kind == "restart":
                    going[at] = cell
                at += width
            above = going
        out.append([tuple(c) for c in cells])
    return out


def word_table_cells(spark: SparkSession, root: str) -> DataFrame:
    """(path, table, row, col, row_span, column_span, value) of the tables in the word-processor files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(root).select("path", "content")

    def parse(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(path, k, *c) for k, cells in enumerate(word_tables(bytes(content))) for c in cells]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["path", "table", "row", "col", "row_span", "column_span", "value"])

    return files.mapInPandas(parse, "path string, table bigint, row bigint, col bigint, row_span bigint, column_span bigint, value string")


READERS: dict[str, Reader] = {"txt": read_plain, "md": read_plain, "docx": read_word}


def blocks(spark: SparkSession, root: str, suffix: str, reader: Reader | None = None) -> DataFrame:
    """(path, status, sequence, kind, text) of the files with a suffix; a broken file is one row, others are unhurt."""
    read = reader or READERS[suffix]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root).select("path", "content")

    def parse(frames):
        for frame in frames:
            out: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    own = [(path, "ok", i, k, t) for i, (k, t) in enumerate(read(bytes(content)))]
                    out += own or [(path, "empty", None, None, None)]
                except ValueError as e:
                    out.append((path, str(e), None, None, None))
            yield pd.DataFrame(out, columns=["path", "status", "sequence", "kind", "text"]).astype({"sequence": "Int64"})

    return files.mapInPandas(parse, BLOCKS)


def text_assets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole documents (path, text, status) in their extraction form, and issues (path, issue) of broken and empty files."""
    whole = joined_text(found.withColumn("text", tx.extracted(F.col("text"))))
    broken = found.where("status <> 'ok'").select("path", F.when(F.col("status") == "empty", "empty_text").otherwise(F.col("status")).alias("issue"))
    empty = whole.where(F.length(tx.strip(F.col("text"))) == 0).select("path", F.lit("empty_text").alias("issue"))
    return whole, broken.unionByName(empty).distinct()


def excerpt(text: Column, limit: int) -> Column:
    """A text of up to four times ``limit`` bytes from its start, a longer one as three windows of bytes with a boundary mark, all cut to ``limit``."""
    raw = F.encode(text, "UTF-8")
    size, window = F.octet_length(text), max(256, limit * 2 // 3)

    def piece(start: Column) -> Column:
        # half characters at the window's ends are left out
        some = F.substring(raw, start.cast("int") + 1, F.lit(window))
        return F.regexp_replace(F.make_valid_utf8(some.cast("string")), "^\ufffd+|\ufffd+$", "")

    starts = (F.lit(0), F.greatest(F.lit(0), F.floor((size - window) / 2)), F.greatest(F.lit(0), size - window))
    joined = F.concat_ws("\n...[deterministic excerpt boundary]...\n", *[piece(s) for s in starts])
    return F.substring(F.when(size <= max(1, limit * 4), text).otherwise(joined), 1, limit)


def with_offsets(found: DataFrame, key: str = "path", order: str = "sequence", gap: int = 1) -> DataFrame:
    """Blocks with the half-open place of each in the text joined with ``gap`` characters between."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(w), F.lit(0)).cast("bigint")
    return found.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def joined_text(found: DataFrame, key: str = "path", order: str = "sequence", separator: str = "\n") -> DataFrame:
    """(key, text, status) of whole documents."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return found.where("text is not null").groupBy(key).agg(F.array_join(parts, separator).alias("text")).withColumn("status", tx.text_status(F.col("text")))


def text_window(df: DataFrame, text: str, offset: int, limit: int) -> DataFrame:
    """A window of each text and whether more follows."""
    return df.withColumn("window", F.col(text).substr(offset + 1, limit)).withColumn("has_next", F.length(text) > offset + limit)
