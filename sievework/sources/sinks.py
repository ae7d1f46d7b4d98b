"""Writers: compressed artifacts, line logs and report files."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifact(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """A Parquet dataset with zstd; it appears whole or not at all (Spark's commit)."""
    out = df.write.mode("errorifexists").option("compression", "zstd")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def append_history(df: DataFrame, path: str, run: str) -> None:
    """Append rows of a run; running it again replaces that run's rows only."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/run={run}")


def write_log(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("errorifexists").json(path)


def markdown(title: str, facts: list[dict]) -> str:
    """A report of facts {"text", "evidence"} in Markdown."""
    lines = [f"# {title}", ""]
    for f in facts:
        cited = f" ({', '.join(f['evidence'])})" if f.get("evidence") else ""
        lines.append(f"- {f['text']}{cited}")
    return "\n".join(lines) + "\n"


def html_page(title: str, facts: list[dict]) -> str:
    """The same as a page; all values are escaped."""
    items = "".join(f"<li>{html.escape(f['text'])}" + "".join(f" <code>{html.escape(e)}</code>" for e in f.get("evidence", ())) + "</li>" for f in facts)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{items}</ul>"


def bounded_json(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in the order of a unique column whose JSON adds up to ``most`` characters."""
    from pyspark.sql import Window

    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    top = rows.withColumn("__json", body).orderBy(order).limit(most // 2)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("__used", F.sum(F.length("__json") + 1).over(w)).where(F.col("__used") <= most).drop("__json", "__used")


def stable_id(prefix: str, *columns: str):
    """A column of ids from provenance columns."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def upgraded(df: DataFrame, version: int, defaults: dict[str, tuple[int, str, object]], newest: int) -> DataFrame:
    """Rows of an older layout with the columns that came later: name to (version, type, value). A newer layout is refused."""
    if version > newest:
        raise ValueError(f"layout {version} is newer than {newest}")
    out = df
    for name, (since, kind, value) in defaults.items():
        if name not in df.columns and since <= newest:
            out = out.withColumn(name, F.lit(value).cast(kind))
    return out


def publish_region(cells: DataFrame, region: dict, path: str) -> dict:
    """Write one region of a sheet (row, col, value): as it is, as a table under its header, and what the places mean.

    Returns the metadata: the region, the header, the mapping of columns and the status, ``review`` if there are warnings.
    """
    from sievework.sources.files import clean_names

    inside = cells.where(F.col("row").between(region["row_start"], region["row_end"] - 1) & F.col("col").between(region["column_start"], region["column_end"] - 1))
    columns = list(range(region["column_start"], region["column_end"]))
    wide = inside.groupBy("row").pivot("col", columns).agg(F.first("value"))
    raw = wide.select("row", *[F.col(f"`{c}`").alias(f"source_col_{i + 1:04d}") for i, c in enumerate(columns)])
    write_artifact(raw, f"{path}/raw")
    header = None
    if region["header"]:
        first = raw.where(F.col("row") == region["row_start"]).first()
        header = [first[f"source_col_{i + 1:04d}"] for i in range(len(columns))] if first else None
    names = clean_names(header or [None] * len(columns))
    body = raw.where(F.col("row") > region["row_start"]) if header else raw
    write_artifact(body.select("row", *[F.col(f"source_col_{i + 1:04d}").alias(n) for i, n in enumerate(names)]), f"{path}/normalized")
    mapping = [{"source_column": c, "original": (header or [None] * len(columns))[i], "normalized": n} for i, (c, n) in enumerate(zip(columns, names, strict=True))]
    warnings = list(region["warnings"])
    return {"region": {k: region[k] for k in ("row_start", "row_end", "column_start", "column_end")}, "first_data_row": region["row_start"] + bool(header), "columns": mapping, "warnings": warnings, "status": "review" if warnings else "pass"}


def write_result(parts: dict[str, DataFrame], path: str, run: str) -> None:
    """The frames of one extraction (run, assets, chunks, issues): each appended under its name; the run's row last, so that what it names is there."""
    for name in sorted(parts, key=lambda n: n == "runs"):
        append_history(parts[name], f"{path}/{name}", run)
