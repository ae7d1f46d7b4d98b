"""Cleaning of one table: cells, names, empty rows and columns, duplicates, types, with a log of what was done."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import inference
from sievework.functions import text as tx
from sievework.sources.files import clean_names

MOST_LISTED = 100


@dataclass
class Cleaned:
    """A cleaned table, the logged actions (type, count), the columns' mapping and the counts before cleaning."""

    table: DataFrame
    actions: list[dict] = field(default_factory=list)
    columns: list[dict] = field(default_factory=list)
    empty_rows_before: int = 0
    empty_columns_before: list[str] = field(default_factory=list)
    duplicate_rows: int = 0


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def blank(value: Column) -> Column:
    return value.isNull() | (F.length(tx.strip(value.cast("string"))) == 0)


def normalised(df: DataFrame, names: list[str]) -> DataFrame:
    """The table with normalised cells, and in ``__changed`` how many filled cells of a row came out different."""
    cells = {c: tx.cell(F.col(f"`{c}`").cast("string")) for c in names}
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(f"__new_{i}") for i, v in enumerate(cells.values())])
    changed = reduce(lambda a, b: a + b, [(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"__new_{i}"))).cast("bigint") for i, c in enumerate(names)], F.lit(0))
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return rows.select(*others, *[F.col(f"__new_{i}").alias(c) for i, c in enumerate(names)], changed.alias("__changed"))


def clean_table(df: DataFrame, header: list[str | None] | None = None, order: str | None = None, drop_duplicates: bool = False) -> Cleaned:
    """Clean a table of text columns.

    ``header`` holds the original names (those of the columns if it is not given); ``order`` names a unique
    column of row order that is kept and isn't part of the table. Two passes read the table: one for all
    counts and types, one for duplicates; with ``drop_duplicates`` the first of equal rows in row order stays.
    Empty tables, tables without columns and columns without values come out as such.
    """
    names = [c for c in df.columns if c != order]
    if not names:
        return Cleaned(df)
    final = clean_names(header or names)
    renamed = sum(a != b or (o is not None and o != b) for a, b, o in zip(names, final, header or names, strict=True))
    empty = _all([blank(F.col(f"`{c}`")) for c in names])
    raw_empty = df.agg(F.count_if(empty).alias("n")).first().n
    rows = normalised(df, names)
    null_row = _all([F.col(f"`{c}`").isNull() for c in names])
    kinds = [F.struct(inference.inferred(F.col(f"`{c}`")).alias("kind"), inference.risks(F.col(f"`{c}`")).alias("risks"), F.count(F.col(f"`{c}`")).alias("filled")).alias(f"c{i}") for i, c in enumerate(names)]
    seen = rows.agg(F.coalesce(F.sum("__changed"), F.lit(0)).alias("changed"), F.count_if(null_row).alias("empty"), *kinds).first()
    kept = [i for i in range(len(names)) if seen[f"c{i}"].filled]
    dropped = [final[i] for i in range(len(names)) if i not in kept]
    keep = [F.col(f"`{names[i]}`").alias(final[i]) for i in kept]
    body = rows.where(~null_row).select(*([F.col(order)] if order else []), *keep)
    own = [final[i] for i in kept]
    duplicates = surplus = 0
    if own:
        d = body.groupBy(*[F.col(f"`{c}`") for c in own]).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).first()
        duplicates, surplus = d.n or 0, (d.n or 0) - d.groups
    if drop_duplicates and duplicates:
        body = first_of_equals(body, own, order)
    kind = {final[i]: seen[f"c{i}"].kind for i in range(len(names))}
    typed = body.select(*([F.col(order)] if order else []), *[inference.cast_to(F.col(f"`{c}`"), kind[c]).alias(c) for c in own])
    log = [
        ("normalize_unicode_whitespace_newlines_nulls", seen.changed, {}),
        ("mechanical_column_name_normalization", renamed, {}),
        ("trim_empty_rows", seen.empty, {}),
        ("trim_empty_columns", len(dropped), {"columns": dropped[:MOST_LISTED]}),
        ("mark_exact_duplicate_rows", duplicates, {}),
        ("drop_exact_duplicate_rows", surplus if drop_duplicates else 0, {}),
        ("conservative_type_inference", sum(kind[c] != "string" for c in own), {}),
    ]
    mapping = [
        {"source_column_offset": i, "raw": names[i], "original": (header or names)[i], "normalized": final[i], "inferred_type": kind[final[i]].split(":")[0], "risk_reasons": list(seen[f"c{i}"].risks)}
        for i in range(len(names))
    ]
    return Cleaned(typed, [{"type": t, "count": int(n), **more} for t, n, more in log if n > 0], mapping, raw_empty, dropped, duplicates)


def first_of_equals(df: DataFrame, names: list[str], order: str | None = None) -> DataFrame:
    """The first of equal rows in row order. Only the least place of each row is gathered, not its copies."""
    if order is None:
        return df.dropDuplicates(names)
    return df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.min(order).alias(order)).select(*df.columns)


def cleaning_failed(asset: str, category: str, message: str) -> dict:
    """The issue of an asset whose cleaning raised an error."""
    return {"asset_id": asset, "issue_type": "cleaning_failed", "severity": "error", "status": "needs_review", "evidence": {"error_category": category, "error_message": message}}


def clean_each(tables: dict[str, DataFrame], **options) -> tuple[dict[str, Cleaned], list[dict]]:
    """Clean several tables; one that fails becomes an issue and stops no other."""
    done, issues = {}, []
    for name, df in tables.items():
        try:
            done[name] = clean_table(df, **options)
        except Exception as e:  # isolation by table: whatever a reader has left in it
            issues.append(cleaning_failed(name, "table_cleaning_error", str(e)[:200]))
    return done, issues


def bounded(df: DataFrame, order: str, columns: int = 32, rows: int = 20, chars: int = 2048) -> DataFrame:
    """A preview: the first columns and rows, long cells cut with an ellipsis."""
    cut = lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("\u2026"))).otherwise(c)
    return df.orderBy(order).limit(rows).select(*[cut(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns[:columns]])


def slice_rows(df: DataFrame, order: str, columns: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of a column, 32 columns at most."""
    return df.select(order, *columns[:32]).orderBy(order).offset(offset).limit(limit)


def typed_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, kind) of matrix columns from the types of their cells (value, kind): one type, mixed numbers, or text."""
    kinds = cells.where("value is not null").groupBy(*keys, "col").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    of = lambda *names: F.col("k") == F.array(*map(F.lit, names))
    kind = F.when(F.size("k") == 1, F.col("k")[0]).when(of("float", "integer"), "float").otherwise("string")
    return kinds.select(*keys, "col", kind.alias("kind"))


def numbered_names(names: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Names of columns with __2, __3 for repeats in any case of letters: (.., name_out, duplicate_ordinal)."""
    w = Window.partitionBy(*keys, "__low").orderBy(place)
    base = F.coalesce(F.when(F.length(tx.strip(F.col(name))) > 0, tx.strip(tx.nfc(F.col(name)))), F.format_string("column_%04d", F.col(place) + 1))
    rows = names.withColumn("__base", base).withColumn("__low", tx.folded(F.col("__base"))).withColumn("duplicate_ordinal", F.row_number().over(w).cast("bigint"))
    out = F.when(F.col("duplicate_ordinal") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("__"), F.col("duplicate_ordinal").cast("string")))
    return rows.withColumn("name_out", out).drop("__base", "__low")


def with_headers(df: DataFrame, columns: list[dict]) -> DataFrame:
    """A preview under the original headers of a cleaning's mapping; equal ones are numbered."""
    from collections import Counter

    original = {c["normalized"]: str(c["original"] or c["normalized"]) for c in columns}
    seen: Counter[str] = Counter()
    names = []
    for c in df.columns:
        name = original.get(c, c)
        seen[name.lower()] += 1
        names.append(name if seen[name.lower()] == 1 else f"{name} ({seen[name.lower()]})")
    return df.toDF(*names)
