"""Lexical search: matching, scores, snippets, one ranking of metadata and chunks, occurrences in files."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions.text import folded, nfc, unfolded
from sievework.operators.chunking import chunks

# fixed values: weight of a field, factor of a match kind, points off for quality, bounds of a request
WEIGHTS = {
    "effective_display_name": 120, "semantic_display_name": 118, "fallback_display_name": 110, "text_phrase": 105, "source_file": 92, "text_token": 82,
    "source_root": 80, "sheet_name": 78, "column_name": 76, "semantic_metadata": 70, "sample_value": 42, "source_format": 38,
}
FACTORS = {"exact": 1.0, "phrase": 0.88, "substring": 0.76, "tokens": 0.60}
PENALTY = {"ready": 0.0, "needs_review": -4.0, "unusable": -18.0}
PER_ASSET, SNIPPET, LEAD = 3, 500, 166
MAX_QUERY, MAX_LIMIT, MAX_OFFSET, MAX_FILE_ID, MAX_FORMAT, MAX_VALUE, MAX_ITEMS = 512, 100, 10_000_000, 160, 32, 2000, 100


class SearchRefused(ValueError):
    """A request outside the bounds."""


@dataclass(frozen=True)
class Request:
    """What is searched for; ``checked`` gives it in its normal form."""

    query: str
    file_id: str | None = None
    asset_type: str = "all"
    source_format: str | None = None
    quality: str | None = None
    mode: str = "all"
    limit: int = 30
    offset: int = 0

    def checked(self) -> Request:
        text = unicodedata.normalize("NFC", self.query).strip()
        file_id, form = self.file_id, (self.source_format or "").strip().casefold() or None
        wrong = {
            "query": len(text) > MAX_QUERY or "\0" in text,
            "asset_type": self.asset_type not in ("all", "table", "text"),
            "file_id": file_id is not None and not (isinstance(file_id, str) and file_id.strip() and len(file_id) <= MAX_FILE_ID),
            "quality": self.quality is not None and self.quality not in PENALTY,
            "source_format": form is not None and len(form) > MAX_FORMAT,
            "mode": self.mode not in ("all", "phrase"),
            "limit": not 1 <= self.limit <= MAX_LIMIT,
            "offset": not 0 <= self.offset <= MAX_OFFSET,
        }
        for name, bad in wrong.items():
            if bad:
                raise SearchRefused(name)
        return replace(self, query=text, file_id=file_id.strip() if file_id else None, source_format=form)


def _terms(query: str, mode: str) -> list[str]:
    fold = lambda t: unicodedata.normalize("NFC", t).casefold()
    return [fold(query)] if mode == "phrase" else [fold(t) for t in query.split()]


def match_kind(low: Column, query: str, mode: str = "all") -> Column:
    """exact, phrase, substring, tokens, or null without a match of a folded value: every term must occur."""
    terms = _terms(query, mode)
    if not terms or not terms[0]:
        return F.lit(None).cast("string")
    hit = reduce(lambda a, b: a & b, [low.contains(t) for t in dict.fromkeys(terms)])
    if mode == "phrase":
        return F.when(hit, "phrase")
    if len(terms) > 1:
        return F.when(hit, "tokens")
    return F.when(hit, F.when(low == _terms(query, "phrase")[0], "exact").otherwise("substring"))


def first_start(low: Column, query: str, mode: str = "all") -> Column:
    """Zero-based place of the earliest of the terms' first occurrences, in the folded value."""
    found = [F.instr(low, t) - 1 for t in dict.fromkeys(_terms(query, mode))]
    return (F.least(*found) if len(found) > 1 else found[0]).cast("bigint")


def snippet(value: Column, start: Column) -> Column:
    """Up to 500 characters around a place: whole values, or a window that starts 166 before and ends with the value."""
    n = F.length(value)
    stop = F.least(n, F.greatest(F.lit(0), start - LEAD) + SNIPPET)
    begin = F.greatest(F.lit(0), stop - SNIPPET).cast("int")
    cut = F.concat(F.when(begin > 0, "\u2026").otherwise(""), value.substr(begin + 1, F.lit(SNIPPET)), F.when(stop < n, "\u2026").otherwise(""))
    return F.when(n <= SNIPPET, value).otherwise(cut)


def penalty(quality: Column) -> Column:
    out = F.lit(PENALTY["needs_review"])
    for k, v in PENALTY.items():
        out = F.when(quality == k, v).otherwise(out)
    return out


def result_id(*parts: Column) -> Column:
    """An id of what was found: asset, chunk, kind and snippet."""
    return F.concat(F.lit("sres_"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256), 1, 32))


def eligible(assets: DataFrame, request: Request) -> DataFrame:
    """Assets that a request may find: tables are ready ones unless a quality is asked for; a usable candidate never is."""
    out = assets
    table = F.col("asset_type") == "table"
    for column, wanted in (("asset_type", None if request.asset_type == "all" else request.asset_type), ("file_id", request.file_id), ("quality_status", request.quality)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    if request.source_format:
        out = out.where(F.lower("source_format") == request.source_format)
    if request.quality is None:
        out = out.where(~table | (F.col("quality_status") == "ready"))
    return out.where(~table | (F.col("quality_status") == "unusable") | ~rules.candidate(F.col("source_kind"), F.col("extractor")))


def metadata_fields(assets: DataFrame) -> DataFrame:
    """(asset_id, field, label, value) of what is known of assets: names, places, columns, samples, semantic words.

    Optional array columns ``columns``, ``samples``, ``keywords`` and ``semantic_fields`` are taken if they are there.
    """
    one = {
        "effective_display_name": "name", "semantic_display_name": "semantic name", "fallback_display_name": "fallback name", "source_file": "source file",
        "source_root": "source path", "sheet_name": "sheet", "source_format": "format", "category": "category",
    }
    many = {"columns": ("column_name", "column"), "samples": ("sample_value", "sample"), "keywords": ("semantic_metadata", "keyword"), "semantic_fields": ("semantic_metadata", "semantic field")}
    entry = lambda field, label, v: F.struct(F.lit(field).alias("field"), F.lit(label).alias("label"), F.substring(v.cast("string"), 1, MAX_VALUE).alias("value"))
    entries = lambda field, label: lambda v: entry(field, label, v)
    parts = [F.array(*[entry(f, label, F.col(f)) for f, label in one.items() if f in assets.columns])]
    for c, (field, label) in many.items():
        if c in assets.columns:
            parts.append(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, MAX_ITEMS), entries(field, label)))
    rows = assets.select("asset_id", F.explode(F.concat(*parts)).alias("f")).select("asset_id", "f.*")
    return rows.where(F.length("value") > 0)


def search_fields(fields: DataFrame, asset: str, query: str, mode: str = "all") -> DataFrame:
    """The best field of each asset from (asset, field, value[, weight, label]): (asset, field, kind, score, value, label)."""
    low = fields.withColumn("__low", folded(F.col("value")))
    hits = low.withColumn("kind", match_kind(F.col("__low"), query, mode)).where("kind is not null")
    factor = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])[F.col("kind")]
    known = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("field")]
    weight = F.col("weight") if "weight" in fields.columns else F.coalesce(known, F.lit(float(WEIGHTS["semantic_metadata"])))
    label = F.col("label") if "label" in fields.columns else F.col("field")
    hits = hits.select(asset, "field", "kind", F.round(weight * factor, 4).alias("score"), "value", label.alias("label"))
    w = Window.partitionBy(asset).orderBy(F.desc("score"), "field", "label", "value")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def search_chunks(cut: DataFrame, asset: str, query: str, mode: str = "all", per_asset: int = PER_ASSET) -> DataFrame:
    """The best ``per_asset`` chunks of each asset: (asset, chunk, kind, score, start, snippet, place)."""
    hits = _chunk_hits(cut, asset, query, mode).withColumn("score", F.lit(float(WEIGHTS["text_phrase" if mode == "phrase" else "text_token"])))
    w = Window.partitionBy(asset).orderBy(F.desc("score"), "chunk")
    placed = hits.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= per_asset)
    return with_snippets(placed, "chunk_text", query, mode).drop("chunk_text")


def chunks_of(docs: DataFrame, key: str, query: str, mode: str = "all") -> DataFrame:
    """Chunks of the texts that hold all terms: a text without one has no hit, so it isn't cut."""
    terms = [t for t in dict.fromkeys(_terms(query, mode)) if t]
    if not terms:
        return chunks(docs.limit(0), key)
    low = folded(F.col("text"))
    return chunks(docs.where(reduce(lambda a, b: a & b, [low.contains(t) for t in terms])), key)


def _chunk_hits(cut: DataFrame, asset: str, query: str, mode: str) -> DataFrame:
    low = cut.withColumn("__low", folded(F.col("chunk_text")))
    return low.withColumn("kind", match_kind(F.col("__low"), query, mode)).where("kind is not null").drop("__low")


def with_snippets(hits: DataFrame, value: str, query: str, mode: str) -> DataFrame:
    """Hits with ``start``, a place in the composed value, and ``snippet``; taken after the limit of an asset or a page, since they are long."""
    low = hits.withColumn("__low", folded(F.col(value)))
    low = low.withColumn("__nfc", nfc(F.col(value))).withColumn("start", unfolded(F.col("__nfc"), first_start(F.col("__low"), query, mode)))
    return low.withColumn("snippet", snippet(F.col("__nfc"), F.col("start"))).drop("__low", "__nfc")


def ranked(assets: DataFrame, cut: DataFrame | None, request: Request) -> DataFrame:
    """All hits of a request in the best three of each asset: the best field of an asset, and its chunks.

    (asset_id, asset_type, chunk, match_kind, score, start, snippet, result_id, place). Chunks are (asset_id, chunk,
    chunk_text); an empty query finds nothing. The order within an asset is that of the whole result:
    score, chunk, id.
    """
    request = request.checked()
    spark = assets.sparkSession
    shape = "asset_id string, asset_type string, chunk string, match_kind string, score double, start bigint, snippet string, result_id string, place bigint"
    if not request.query:
        return spark.createDataFrame([], shape)
    q, mode = request.query, request.mode
    found = eligible(assets, request)
    light = found.select("asset_id", "asset_type", penalty(F.col("quality_status")).alias("points"))
    suffix = F.when(F.col("kind") == "exact", "exact").otherwise(F.lit("phrase" if mode == "phrase" else "contains"))
    meta = search_fields(metadata_fields(found), "asset_id", q, mode)
    meta = meta.select("asset_id", F.lit(None).cast("string").alias("chunk"), F.concat_ws("_", "field", suffix).alias("match_kind"), "score", F.concat(F.col("label"), F.lit(": "), F.col("value")).alias("body"))
    hits = meta.join(light, "asset_id")
    if cut is not None and request.asset_type != "table":
        kind = F.lit("text_phrase") if mode == "phrase" else F.lit("text_token") if len(q.split()) != 1 else F.concat(F.lit("text_"), F.col("kind"))
        own = _chunk_hits(cut, "asset_id", q, mode)
        base = F.lit(float(WEIGHTS["text_phrase" if mode == "phrase" else "text_token"]))
        own = own.select("asset_id", F.col("chunk").cast("string").alias("chunk"), kind.alias("match_kind"), base.alias("score"), F.col("chunk_text").alias("body"))
        hits = hits.unionByName(own.join(light.where("asset_type = 'text'"), "asset_id"))
    hits = hits.withColumn("score", F.round(F.col("score") + F.col("points"), 4)).drop("points")
    w = Window.partitionBy("asset_id").orderBy(F.desc("score"), F.coalesce("chunk", F.lit("")), "match_kind")
    best = hits.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= PER_ASSET)
    out = with_snippets(best, "body", q, mode)
    ident = result_id(F.col("asset_id"), F.col("chunk"), F.col("match_kind"), F.col("snippet"))
    return out.select("asset_id", "asset_type", "chunk", "match_kind", "score", "start", "snippet", ident.alias("result_id"), "place")


def result_page(hits: DataFrame, request: Request, details: DataFrame | None = None) -> DataFrame:
    """One page of ranked hits with the total of all; details of assets are joined to the page only."""
    order = [F.desc("score"), F.col("asset_id"), F.coalesce("chunk", F.lit("")), F.col("result_id")]
    total = hits.agg(F.count("*").alias("total"))
    rows = hits.orderBy(*order).offset(request.offset).limit(request.limit)
    if details is not None:
        rows = rows.join(details, "asset_id", "left")
    return rows.crossJoin(F.broadcast(total))


def page(hits: DataFrame, asset: str, limit: int, offset: int = 0) -> DataFrame:
    """One page in rank order; the order is total."""
    return hits.orderBy(F.desc("score"), asset, "chunk").offset(offset).limit(limit)


def starts_of(text: Column, needle: str) -> Column:
    """Zero-based starts of the occurrences that don't overlap, case-sensitive."""
    n = len(needle)
    parts = F.split(text, F.lit("\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)
    lengths = F.transform(parts, F.length)
    step = lambda s, x: F.struct((s["at"] + x + n).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    all_but_last = F.slice(lengths, 1, F.greatest(F.lit(0), F.size(lengths) - 1))
    return F.aggregate(all_but_last, start, step, lambda s: s["out"])


def text_occurrences(blocks: DataFrame, needle: str) -> DataFrame:
    """Every occurrence in (asset_id, page, section, block, text), with its index in the asset.

    Order: pages (none last), start, asset, block. Columns: those of the block but the text, start, end, snippet, occurrence.
    """
    wanted = unicodedata.normalize("NFC", needle).strip()
    rows = blocks.withColumn("__nfc", nfc(F.col("text"))).where(F.col("__nfc").contains(wanted))
    rows = rows.withColumn("start", F.explode(starts_of(F.col("__nfc"), wanted))).withColumn("end", F.col("start") + len(wanted))
    rows = rows.withColumn("snippet", snippet(F.col("__nfc"), F.col("start"))).drop("__nfc", "text")
    order = [F.col("page").isNull(), F.coalesce("page", F.lit(0)), F.col("start"), F.col("block")]
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy("asset_id").orderBy(*order)) - 1).cast("bigint"))


def cell_occurrences(table: DataFrame, row: str, needle: str, names: list[str] | None = None) -> DataFrame:
    """(row, column, column_name, cell, start, end, snippet): every occurrence in the cells of a trusted table."""
    wanted = unicodedata.normalize("NFC", needle).strip()
    names = names or [c for c in table.columns if c != row]
    cell = F.array(*[F.struct(F.lit(i).cast("bigint").alias("column"), F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(names)])
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").cast("string").contains(wanted) for c in names])
    ascii_only = wanted.isascii()
    rows = (table.where(some) if ascii_only else table).select(F.col(row).alias("row"), F.explode(cell).alias("c")).select("row", "c.*")
    rows = rows.withColumn("cell", nfc(F.col("cell"))).where(F.col("cell").contains(wanted))
    rows = rows.withColumn("start", F.explode(starts_of(F.col("cell"), wanted))).withColumn("end", F.col("start") + len(wanted))
    return rows.withColumn("snippet", F.concat("column_name", F.lit(": "), "cell"))


def matched(occurrences: DataFrame) -> DataFrame:
    """One row: occurrences, the pages and sections that they are on, sorted."""
    return occurrences.agg(F.count("*").alias("total"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("section")).alias("sections"))
