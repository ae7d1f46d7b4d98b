"""Text chunks with code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 2000


def pattern(size: int) -> str:
    """One chunk: the rest if it fits, else up to the last newline of the window's second half, else the whole window."""
    half = size // 2
    return rf"(?s).{{1,{size}}}\z|.{{{half},{size - 1}}}\n|.{{{size}}}"


def chunk_parts(text: Column, size: int = SIZE) -> Column:
    """Array of (start, end, chunk_text): windows of ``size``, cut after the last newline of their second half; half-open, from 0."""
    parts = F.regexp_extract_all(text, F.lit(pattern(size)), F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,chunk_text:string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), p.alias("chunk_text")))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def chunks(df: DataFrame, key: str, text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, chunk, start, end, chunk_text) of every text; texts without characters have no chunk."""
    found = df.where(F.length(text) > 0).select(key, F.posexplode(chunk_parts(F.col(text), size)).alias("chunk", "part"))
    return found.select(key, F.col("chunk").cast("bigint").alias("chunk"), "part.start", "part.end", "part.chunk_text")
