"""A registry made of the driver's tables: files, assets, runs, issues and descriptions.

Each frame is a projection of one table. Its expressions are valid in Spark and in DuckDB, so that the queries
and their oracles start from the same rows; nothing else is shared between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FORMAT = "case s_suppkey % 8 when 0 then 'csv' when 1 then 'xlsx' when 2 then 'pdf' when 3 then 'jpeg' when 4 then 'txt' when 5 then 'docx' when 6 then 'tsv' else 'png' end"
_CONTENT = "case when {0} % 19 = 0 then 'old' else 'c' end || cast({1} as varchar(20))"

#: Frame: table, condition, columns.
FRAMES: dict[str, tuple[str, str, dict[str, str]]] = {
    "files": (
        "supplier",
        "true",
        {
            "file_id": "cast(s_suppkey as varchar(20))",
            "source_root": "'root' || cast(s_nationkey % 3 as varchar(5))",
            "filename": f"s_name || '.' || {_FORMAT}",
            "relative_path": f"'dir' || cast(s_suppkey % 5 as varchar(5)) || '/' || s_name || '.' || {_FORMAT}",
            "source_format": _FORMAT,
            "support": "case when s_suppkey % 13 = 0 then 'ignored' else 'supported' end",
            "state": "case when s_suppkey % 17 = 0 then 'missing' else 'present' end",
            "sha256": "case when s_suppkey % 11 = 0 then null else 'c' || cast(s_suppkey as varchar(20)) end",
        },
    ),
    "tables": (
        "part",
        "true",
        {
            "asset_id": "'t' || cast(p_partkey as varchar(20))",
            "file_id": "cast(p_partkey % 120 as varchar(20))",
            "content": _CONTENT.format("p_partkey", "p_partkey % 120"),
            "extractor": "case when p_partkey % 9 = 0 then 'img2table' else 'native' end",
            "source_kind": "case p_partkey % 7 when 0 then 'page' when 1 then 'image' when 2 then null else 'sheet' end",
            "sheet_name": "case when p_partkey % 4 = 1 then 'Sheet' || cast(p_size as varchar(5)) end",
            "page_number": "case when p_partkey % 7 = 0 then cast(p_size as bigint) end",
            "rows": "cast(p_size as bigint)",
            "columns": "cast(p_size % 9 as bigint)",
            "quality": "case when p_size % 5 = 0 then 'fail' when p_size % 3 = 0 then 'review' else 'pass' end",
            "is_current": "p_size <> 7",
        },
    ),
    "texts": (
        "documents",
        "true",
        {
            "asset_id": "'x' || cast(doc_id as varchar(20))",
            "file_id": "cast(doc_id % 120 as varchar(20))",
            "content": _CONTENT.format("doc_id", "doc_id % 120"),
            "extractor": "case when doc_id % 6 = 0 then 'rapidocr' else 'plain' end",
            "source_kind": "case when doc_id % 6 = 0 then 'page' else 'file' end",
            "sheet_name": "case when doc_id % 10 = 0 then 'part ' || lang end",
            "page_number": "case when doc_id % 3 = 0 then doc_id % 50 end",
            "text": "text",
            "is_current": "doc_id % 23 <> 0",
        },
    ),
    "cleaning": (
        "orders",
        "o_orderkey % 3 <> 0",
        {
            "run_id": "'r' || cast(o_orderkey as varchar(20))",
            "asset_id": "case when o_custkey % 2 = 0 then 't' else 'x' end || cast(o_custkey % 400 as varchar(20))",
            "content": _CONTENT.format("(o_custkey % 400)", "o_custkey % 400 % 120"),
            "status": "case o_orderstatus when 'F' then 'successful' when 'O' then 'failed' else 'partial' end",
            "quality": "case o_orderstatus when 'O' then null when 'F' then 'ready' else 'needs_review' end",
            "started": "o_orderdate",
            "finished": "case when o_orderkey % 5 <> 0 then o_orderdate end",
        },
    ),
    "profiles": (
        "orders",
        "o_orderkey % 3 <> 0 and o_orderstatus = 'F'",
        {
            "run_id": "'r' || cast(o_orderkey as varchar(20))",
            "asset_id": "case when o_custkey % 2 = 0 then 't' else 'x' end || cast(o_custkey % 400 as varchar(20))",
            "rows": "case when o_custkey % 2 = 0 then o_orderkey % 1000 end",
            "columns": "case when o_custkey % 2 = 0 then o_orderkey % 7 end",
            "chars": "case when o_custkey % 2 = 1 then o_orderkey % 5000 end",
            "chunks": "case when o_custkey % 2 = 1 then o_orderkey % 4 end",
        },
    ),
    "issues": (
        "events",
        "true",
        {
            "issue_id": "'i' || cast(event_id as varchar(20))",
            "asset_id": "case when event_id % 2 = 0 then 't' else 'x' end || cast(user_id % 500 as varchar(20))",
            "run_id": "case when event_id % 4 < 2 then null else 'r' || cast(event_id % 15000 as varchar(20)) end",
            "issue_type": "case event_type when 'view' then 'possible_table_candidate' else event_type end",
            "severity": "case when value > 50 then 'warning' else 'info' end",
            "status": "case event_id % 5 when 0 then 'dismissed' when 1 then 'accepted' when 2 then 'resolved' else 'open' end",
            "created": "ts",
        },
    ),
    "semantic": (
        "customer",
        "true",
        {
            "run_id": "'s' || cast(c_custkey as varchar(20))",
            "asset_id": "case when c_custkey % 3 = 0 then 't' else 'x' end || cast(c_custkey % 300 as varchar(20))",
            "asset_type": "case when c_custkey % 3 = 0 then 'table' else 'text' end",
            "current": "c_acctbal > 0",
            "generated": "c_custkey % 40",
            "display_name": "'About ' || c_name",
            "category": "c_mktsegment",
        },
    ),
    "runs": (
        "events",
        "event_id % 3 <> 0",
        {
            "run_id": "'e' || cast(event_id as varchar(20))",
            "file_id": "cast(user_id % 120 as varchar(20))",
            "content": "case when event_id % 6 = 1 then 'old' else 'c' end || cast(user_id % 120 as varchar(20))",
            "route": "case event_type when 'view' then 'structured_native' when 'click' then 'pdf_native_text' when 'purchase' then 'ocr_rapidocr' when 'signup' then 'text_plain' else case when event_id % 2 = 0 then 'docx_native' else 'vision_llm' end end",
            "status": "case when value < 15 then 'failed' when value < 25 then 'running' when value < 60 then 'partial' else 'successful' end",
            "started": "ts",
            "finished": "case when event_id % 7 <> 0 then ts end",
        },
    ),
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for name in names or FRAMES:
        table, condition, columns = FRAMES[name]
        out[name] = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition).selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()])
    return out


def statements(*names: str) -> str:
    """The same frames as common table expressions of DuckDB."""
    parts = []
    for name in names or FRAMES:
        table, condition, columns = FRAMES[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {table} WHERE {condition})")
    return "WITH " + ", ".join(parts)
