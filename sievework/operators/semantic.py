"""Descriptions of assets by a model: bounded input, checked output, reuse by identity. Models are plain objects with a method."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.profiling import head_middle_tail, table_profile
from sievework.sources.documents import excerpt
from sievework.sources.sinks import canonical_json

# fixed values: bounds of a request and of a model's answer
REFERENCE_BYTES, PROMPT_BYTES, SAMPLE_ROWS, CELL_CHARS, TEXT_CHARS, MOST_ITEMS = 48 * 1024, 64 * 1024, 18, 240, 12_000, 24
TEXT_FIELDS = {"display_name", "category", "description", "keywords", "summary", "confidence"}
COLUMN_FIELDS = {"source_column", "semantic_name", "description", "semantic_type", "unit", "aliases", "confidence"}
SUGGESTION_FIELDS, SEVERITIES = {"issue_type", "explanation", "suggested_action"}, ("info", "warning", "error", "critical")
PAGE_TYPES, ROLES = ("text", "table", "mixed", "other"), ("title", "body", "caption", "note", "other")
MAX_TITLE, MAX_TEXT, MAX_TEXTS, MAX_ALL_TEXT, MAX_TABLES, MAX_COLUMNS, MAX_ROWS, MAX_CELL, MAX_CELLS = 2_000, 20_000, 200, 100_000, 32, 128, 10_000, 8_000, 500_000


class Model(Protocol):
    """Answers a request (a JSON object) with a JSON object or its text."""

    name: str

    def describe(self, request: Mapping[str, Any]) -> Any: ...


class Retriever(Protocol):
    """Finds assets for a query."""

    def retrieve(self, query: str, limit: int) -> DataFrame: ...


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reader(Protocol):
    """Reads a picture or page: blocks of (text, box, confidence), or tables. PDF, recognition and vision libraries go behind it."""

    def read(self, content: bytes) -> Mapping[str, Any]: ...


class StaticModel:
    """A model for tests: it answers from the request alone, always the same."""

    name = "static"

    def describe(self, request: Mapping[str, Any]) -> dict:
        ref = request["reference"]
        out = {"display_name": ref.get("name", "asset"), "category": "data", "description": "A described asset.", "keywords": ["data"], "summary": "A summary.", "confidence": 0.5, "quality_suggestions": []}
        if request["asset_type"] == "table":
            out["semantic_fields"] = [{"source_column": c, "semantic_name": c.lower(), "description": c, "semantic_type": "text", "unit": None, "aliases": [], "confidence": 0.5} for c in ref.get("columns", [])]
        return out


def _size(value: object) -> int:
    return len(canonical_json(value).encode())


def cut(text: str, most: int) -> str:
    mark = "...[truncated]"
    return text if len(text) <= most else mark[:most] if most <= len(mark) else text[: most - len(mark)] + mark


def compact(value: Any, chars: int = CELL_CHARS, items: int = MOST_ITEMS) -> Any:
    """Strings and lists cut, at any depth."""
    if isinstance(value, str):
        return cut(value, chars)
    if isinstance(value, Mapping):
        return {str(k): compact(v, chars, items) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [compact(v, chars, items) for v in value[:items]]
    return value if value is None or isinstance(value, bool | int | float) else str(value)


def fitted(reference: Mapping[str, Any], most: int = REFERENCE_BYTES) -> tuple[dict, bool]:
    """A reference within its bytes, and whether something had to go: cells, then rows and issues, then all but names, then all."""
    whole = dict(reference)
    if _size(whole) <= most:
        return whole, False
    a = compact(whole) | {"input_truncation": "cells and lists cut"}
    b = a | {"rows": list(a.get("rows") or [])[:6], "issues": list(a.get("issues") or [])[:8], "profile": list(a.get("profile") or [])[:24]}
    c = {k: a[k] for k in ("asset_id", "name", "source_file", "asset_type") if k in a} | {"columns": list(a.get("columns") or [])[:32], "rows": list(a.get("rows") or [])[:4], "input_truncation": "reduced to names and four rows"}
    for smaller in (a, b, c, {"input_truncation": "reduced to nothing"}, {}):
        if _size(smaller) <= most:
            return smaller, True
    raise ValueError("the bound on the reference is below two bytes")


def table_reference(asset: Mapping[str, Any], table: DataFrame, order: str, issues: Sequence[Mapping[str, Any]] = ()) -> dict:
    """What a model may know of a table: names, profile, rows of its start, middle and end, issues that no model has raised."""
    names = [c for c in table.columns if c != order]
    rows, seen = [], set()
    for r in head_middle_tail(table, order, SAMPLE_ROWS).orderBy(order).collect():
        row = {c: compact(r[c]) for c in names}
        if canonical_json(row) not in seen:
            seen.add(canonical_json(row))
            rows.append(row)
    p = table_profile(table, names).first()
    own = [i for i in issues if str(i.get("detected_by", "")).casefold() != "semantic"]
    return {**asset, "asset_type": "table", "columns": names, "row_count": p.row_count, "profile": [{"null_count": p.null_count, "chars": p.chars}], "issues": own, "rows": rows[:SAMPLE_ROWS]}


def text_references(texts: DataFrame, key: str, limit: int = TEXT_CHARS) -> DataFrame:
    """(key, excerpt, sampled) of texts for requests."""
    return texts.select(key, excerpt(F.col("text"), limit).alias("excerpt"), (F.length(excerpt(F.col("text"), limit)) < F.length("text")).alias("sampled"))


def request_for(asset_type: str, reference: Mapping[str, Any], artifact: str, instructions: str, version: str = "1") -> dict:
    """A request within its bytes, with its identity's parts."""
    ref, less = fitted(reference)
    out = {"asset_type": asset_type, "instructions": instructions, "version": version, "artifact": artifact, "reference": ref, "truncated": less}
    for smaller in ({"rows": list(ref.get("rows") or [])[:2], "issues": list(ref.get("issues") or [])[:2]}, None):
        if _size(out) <= PROMPT_BYTES:
            return out
        out = out | {"reference": ref | smaller if smaller else {}, "truncated": True}
    if _size(out) > PROMPT_BYTES:
        raise ValueError("the instructions alone are larger than a request")
    return out


def identity(request: Mapping[str, Any], model: str) -> str:
    """The same request to the same model has the same identity."""
    return hashlib.sha256(canonical_json({"request": request, "model": model}).encode()).hexdigest()


@dataclass
class Answer:
    """A checked description, or why it is refused; warnings don't refuse it."""

    value: dict | None = None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _object(value: Any, errors: list[str]) -> dict | None:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            errors.append("not JSON")
            return None
    if not isinstance(value, Mapping):
        errors.append("not an object")
        return None
    return dict(value)


def _keys(value: Mapping, allowed: set[str], needed: set[str], where: str, errors: list[str]) -> None:
    errors += [f"{where}: unknown {k}" for k in sorted(map(str, set(value) - allowed))]
    errors += [f"{where}: missing {k}" for k in sorted(needed - set(value))]


def _text(value: Any, where: str, errors: list[str]) -> str | None:
    if isinstance(value, str) and value.strip():
        return value.strip()
    errors.append(f"{where}: not a filled string")
    return None


def _share(value: Any, where: str, errors: list[str]) -> float | None:
    if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value <= 1:
        return float(value)
    errors.append(f"{where}: not a number from 0 to 1")
    return None


def _texts(value: Any, where: str, errors: list[str]) -> list[str]:
    if isinstance(value, list) and all(isinstance(v, str) and v.strip() for v in value):
        return [v.strip() for v in value]
    errors.append(f"{where}: not a list of filled strings")
    return []


def checked_description(value: Any, asset_type: str, columns: Sequence[str] = ()) -> Answer:
    """A model's answer with exactly its fields; columns must exist, columns and names that come twice are warned of."""
    out = Answer()
    found = _object(value, out.errors)
    if found is None:
        return out
    needed = TEXT_FIELDS | ({"semantic_fields"} if asset_type == "table" else set())
    _keys(found, needed | {"quality_suggestions"}, needed, "answer", out.errors)
    for k in ("display_name", "category", "description", "summary"):
        found[k] = _text(found.get(k), k, out.errors)
    found["keywords"] = _texts(found.get("keywords"), "keywords", out.errors)
    found["confidence"] = _share(found.get("confidence"), "confidence", out.errors)
    suggestions = found.setdefault("quality_suggestions", [])
    for i, s in enumerate(suggestions if isinstance(suggestions, list) else [None]):
        where = f"quality_suggestions[{i}]"
        if not isinstance(s, Mapping):
            out.errors.append(f"{where}: not an object")
            continue
        _keys(s, SUGGESTION_FIELDS | {"severity"}, SUGGESTION_FIELDS, where, out.errors)
        for k in SUGGESTION_FIELDS:
            _text(s.get(k), f"{where}.{k}", out.errors)
        if s.get("severity", "warning") not in SEVERITIES:
            out.errors.append(f"{where}.severity")
    if asset_type == "table":
        fields = found.get("semantic_fields")
        seen: dict[str, set] = {"source_column": set(), "semantic_name": set()}
        for i, f in enumerate(fields if isinstance(fields, list) else [None]):
            where = f"semantic_fields[{i}]"
            if not isinstance(f, Mapping):
                out.errors.append(f"{where}: not an object")
                continue
            _keys(f, COLUMN_FIELDS, COLUMN_FIELDS, where, out.errors)
            for k in ("source_column", "semantic_name", "description", "semantic_type"):
                name = _text(f.get(k), f"{where}.{k}", out.errors)
                if name and k in seen:
                    if name in seen[k]:
                        out.warnings.append(f"{where}.{k}: {name} again")
                    seen[k].add(name)
            _texts(f.get("aliases"), f"{where}.aliases", out.errors)
            _share(f.get("confidence"), f"{where}.confidence", out.errors)
            if f.get("unit") is not None and not isinstance(f.get("unit"), str):
                out.errors.append(f"{where}.unit")
            if f.get("source_column") not in columns:
                out.errors.append(f"{where}: no column {f.get('source_column')}")
    out.value = None if out.errors else found
    return out


def describe(request: Mapping[str, Any], model: Model, columns: Sequence[str] = (), known: Callable[[str], dict | None] = lambda _: None) -> tuple[Answer, bool]:
    """The answer to a request, and whether it was known already under the request's identity."""
    before = known(identity(request, model.name))
    if before is not None:
        return Answer(dict(before)), True
    try:
        return checked_description(model.describe(request), request["asset_type"], columns), False
    except Exception as e:  # a model is outside: whatever it raises is its failure
        return Answer(errors=[f"model: {e.__class__.__name__}"]), False


def checked_page(value: Any) -> Answer:
    """What a vision model has read of a page: kinds, texts with roles, rectangular tables of scalars, all within bounds."""
    out = Answer()
    errors = out.errors
    found = _object(value, errors)
    if found is None:
        return out
    _keys(found, {"page_type", "title", "useful_text", "tables", "confidence"}, {"page_type", "title", "useful_text", "tables"}, "page", errors)
    if found.get("page_type") not in PAGE_TYPES:
        errors.append("page_type")
    title = found.get("title")
    if not isinstance(title, str) or len(title) > MAX_TITLE:
        errors.append("title")
    texts = found.get("useful_text")
    if not isinstance(texts, list) or len(texts) > MAX_TEXTS:
        errors.append("useful_text")
        texts = []
    total = len(title) if isinstance(title, str) else 0
    for i, t in enumerate(texts):
        if not isinstance(t, Mapping) or set(t) != {"text", "role"} or not isinstance(t["text"], str) or len(t["text"]) > MAX_TEXT or t["role"] not in ROLES:
            errors.append(f"useful_text[{i}]")
            continue
        total += len(t["text"])
    if total > MAX_ALL_TEXT:
        errors.append("useful_text: too long together")
    tables, cells = found.get("tables"), 0
    if not isinstance(tables, list) or len(tables) > MAX_TABLES:
        errors.append("tables")
        tables = []
    for i, t in enumerate(tables):
        where = f"tables[{i}]"
        if not isinstance(t, Mapping):
            errors.append(where)
            continue
        _keys(t, {"title", "columns", "rows", "confidence"}, {"title", "columns", "rows"}, where, errors)
        names, rows = t.get("columns"), t.get("rows")
        if not isinstance(names, list) or not 0 < len(names) <= MAX_COLUMNS or not all(isinstance(n, str) for n in names):
            errors.append(f"{where}.columns")
            continue
        if not isinstance(rows, list) or len(rows) > MAX_ROWS or any(not isinstance(r, list) or len(r) != len(names) for r in rows):
            errors.append(f"{where}.rows")
            continue
        cells += len(rows) * len(names)
        for r in rows:
            if any(not (v is None or isinstance(v, str | bool | int) or (isinstance(v, float) and math.isfinite(v))) or (isinstance(v, str) and len(v) > MAX_CELL) for v in r):
                errors.append(f"{where}: a cell is no scalar")
                break
        if t.get("confidence") is not None:
            _share(t["confidence"], f"{where}.confidence", errors)
    if cells > MAX_CELLS:
        errors.append("tables: too many cells")
    if found.get("confidence") is not None:
        _share(found["confidence"], "confidence", errors)
    out.value = None if errors else found
    return out


def read_pages(files: DataFrame, reader: Reader) -> DataFrame:
    """(path, page, block, text, x0, y0, x1, y1, confidence, status) of what a reader finds in (path, page, content).

    A page that fails is one row with the reader's error; other pages are unhurt. The reader travels with the task.
    """
    import pandas as pd

    names = ["path", "page", "block", "text", "x0", "y0", "x1", "y1", "confidence", "status"]

    def run(frames):
        for frame in frames:
            out = []
            for path, page, content in zip(frame["path"], frame["page"], frame["content"], strict=True):
                try:
                    found = reader.read(bytes(content))["blocks"]
                    out += [(path, page, i, t, *(box or (None,) * 4), c, "ok") for i, (t, box, c) in enumerate(found)] or [(path, page, *(None,) * 7, "empty")]
                except Exception as e:  # isolation by page: whatever a library raises
                    out.append((path, page, *(None,) * 7, f"failed: {e.__class__.__name__}"))
            yield pd.DataFrame(out, columns=names).astype({"block": "Int64"})

    return files.select("path", "page", "content").mapInPandas(run, "path string, page bigint, block bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double, status string")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(path, page, text, chars, confidence, quality) of read pages: blocks in reading order, the mean of known confidences.

    Confidences are added up in order of ``block`` and rounded half up as binary numbers.
    """
    from sievework.operators.layout import mean_in_order, reading_order

    rows = blocks.where("status = 'ok' and text is not null").withColumn("__key", F.struct("path", "page"))
    placed = reading_order(rows, "__key", "block")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    out = placed.groupBy("path", "page").agg(F.array_join(parts, "\n\n").alias("text"), (F.round(mean_in_order(F.col("confidence"), F.col("block")) * 1e6) / 1e6).alias("confidence"))
    quality = F.when(F.length(F.trim("text")) == 0, "unusable").otherwise("needs_review")
    return out.withColumn("chars", F.length("text").cast("bigint")).withColumn("quality", quality)
