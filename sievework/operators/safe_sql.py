"""Read-only SQL over selected relations: the parsed plan is checked, time and rows are bounded."""

from __future__ import annotations

import datetime
import json
import math
import threading
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession

# fixed values: limits of a request
MAX_BYTES, MAX_RELATIONS, MAX_INPUT_ROWS, MAX_ROWS, TIMEOUT_S = 32 * 1024, 8, 50_000, 500, 10.0
MAX_ID, MAX_CELL, MAX_RESPONSE = 160, 10_000, 2 * 1024 * 1024

#: Parsed nodes that only read; everything else is refused.
PLANS = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases Union SetOperation Except Intersect OneRowRelation UnresolvedInlineTable "
    "LocalRelation WithWindowDefinition Window Generate Pivot Unpivot LateralJoin GroupingSets UnresolvedPivot BaseGroupingSets".split()
)
FORBIDDEN_FUNCTIONS = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_catalog current_database "
    "current_schema current_user session_user user version spark_partition_id monotonically_increasing_id assert_true raise_error "
    "read_files from_protobuf to_protobuf getvariable".split()
)


class SqlRefused(Exception):
    """A refusal with a stable code."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(text or code)
        self.code = code


def _children(node):
    for name in ("children", "innerChildren"):
        it = getattr(node, name)().iterator()
        while it.hasNext():
            yield it.next()


def _subplans(node):
    """Plans inside the expressions of a node, and the names of the functions there."""
    todo = []
    it = node.expressions().iterator()
    while it.hasNext():
        todo.append(it.next())
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = e.nameParts().mkString(".").lower()
            if name.split(".")[-1] in FORBIDDEN_FUNCTIONS:
                raise SqlRefused("forbidden_sql", f"function {name}")
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            yield e.plan()
        it = e.children().iterator()
        while it.hasNext():
            todo.append(it.next())


def validate(spark: SparkSession, sql: str, relations: set[str]) -> str:
    """The statement without its final semicolon, or SqlRefused."""
    text = (sql or "").strip()
    if not text:
        raise SqlRefused("empty_sql")
    if len(text.encode()) > MAX_BYTES:
        raise SqlRefused("sql_too_large")
    if text.endswith(";"):
        text = text[:-1].rstrip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        code = "multiple_statements" if ";" in text else "invalid_sql"
        raise SqlRefused(code, str(e)[:200]) from None
    if text.split(None, 1)[0].lower().strip("(") not in ("select", "with"):
        raise SqlRefused("read_only_required")
    todo, names, used = [plan], {r.lower() for r in relations}, []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier().mkString("\0").lower().split("\0")
            if len(parts) > 1:
                raise SqlRefused("external_access_denied", ".".join(parts))
            used.append(parts[0])
        elif kind == "UnresolvedTableValuedFunction":
            raise SqlRefused("external_access_denied", "table function")
        elif kind not in PLANS:
            raise SqlRefused("forbidden_sql", kind)
        if kind == "UnresolvedWith":
            it = node.cteRelations().iterator()
            while it.hasNext():
                pair = it.next()
                names.add(pair.productElement(0).lower())
                todo.append(pair.productElement(1))
        todo += list(_children(node))
        todo += list(_subplans(node))
    for name in used:
        if name not in names:
            raise SqlRefused("unknown_relation", name)
    return text


def selected(ids: list[str], assets: DataFrame) -> list:
    """Rows (asset_id, trust, ...) of the requested tables in the order of the request: one to eight, known, confirmed."""
    if not isinstance(ids, list) or not ids:
        raise SqlRefused("assets_required")
    if len(ids) > MAX_RELATIONS:
        raise SqlRefused("too_many_assets")
    wanted = [i.strip() if isinstance(i, str) else "" for i in ids]
    if any(not i or len(i) > MAX_ID for i in wanted):
        raise SqlRefused("invalid_asset_id")
    if len(set(wanted)) < len(wanted):
        raise SqlRefused("duplicate_asset_id")
    found = {r.asset_id: r for r in assets.where(assets.asset_id.isin(wanted)).collect()}
    if any(i not in found for i in wanted):
        raise SqlRefused("table_asset_not_found")
    if any(found[i].trust != "confirmed" for i in wanted):
        raise SqlRefused("table_asset_not_trusted")
    return [found[i] for i in wanted]


def schema(relations: dict[str, DataFrame]) -> dict:
    """Names and types of the relations, and the limits of a request."""
    return {
        "relations": [{"alias": a, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]} for a, df in relations.items()],
        "limits": {"relations": MAX_RELATIONS, "input_rows": MAX_INPUT_ROWS, "rows": MAX_ROWS, "sql_bytes": MAX_BYTES, "response_bytes": MAX_RESPONSE, "timeout_s": TIMEOUT_S},
    }


def query(relations: dict[str, DataFrame], sql: str) -> DataFrame:
    """The checked statement over named frames; it can name no other relation.

    The names live in a session of their own: views of the caller are neither seen nor replaced, and statements of
    two callers don't meet. Files can't be named as relations there.
    """
    if not 1 <= len(relations) <= MAX_RELATIONS:
        raise SqlRefused("invalid_selection")
    caller = next(iter(relations.values())).sparkSession
    text = validate(caller, sql, set(relations))
    own = caller.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(key, caller.conf.get(key))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in relations.items():
        plan = own._jsparkSession  # a frame's plan is bound to no session's names
        jdf = caller._jvm.org.apache.spark.sql.classic.Dataset.ofRows(plan, df._jdf.queryExecution().analyzed())
        jdf.createOrReplaceTempView(name)
    return own.sql(text)


def json_safe(value, depth: int = 0):
    """A cell as JSON has it: long strings cut, dates in ISO form, decimals as text, bytes as hexadecimals, no NaN."""
    if depth > 4:
        return "[nested value omitted]"
    if isinstance(value, str):
        return value if len(value) <= MAX_CELL else value[:MAX_CELL] + "\u2026"
    if value is None or isinstance(value, bool | int):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        return bytes(value[:MAX_CELL]).hex()
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): json_safe(v, depth + 1) for k, v in list(value.items())[:100]}
    if isinstance(value, list | tuple):
        return [json_safe(v, depth + 1) for v in value[:100]]
    return str(value)


def response(rows: list, more: bool, most: int = MAX_RESPONSE) -> dict:
    """Rows for a caller within a number of bytes; the last ones go first, and a single row that is too large is refused."""
    shown = [json_safe(r) for r in rows]
    sizes = [len(json.dumps(r, ensure_ascii=False).encode()) + 1 for r in shown]
    total, keep = 2, 0
    for size in sizes:
        if total + size > most:
            break
        total += size
        keep += 1
    if shown and not keep:
        raise SqlRefused("query_response_too_large")
    return {"rows": shown[:keep], "truncated": more or keep < len(shown)}


def within(relations: dict[str, DataFrame], most: int, counts: dict[str, int | None] | None = None) -> bool:
    """The relations hold ``most`` rows at most together. Known counts are taken; other relations are read only until it is decided."""
    left = most
    for name, df in relations.items():
        n = (counts or {}).get(name)
        left -= n if n is not None else df.limit(left + 1).count()
        if left < 0:
            return False
    return True


def execute(relations: dict[str, DataFrame], sql: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S, max_input_rows: int | None = MAX_INPUT_ROWS, counts: dict[str, int | None] | None = None) -> tuple[list, bool]:
    """Rows and whether more were cut off; input rows and seconds are bounded."""
    if max_input_rows is not None and not within(relations, max_input_rows, counts):
        raise SqlRefused("input_rows_too_large")
    df = query(relations, sql)
    sc = df.sparkSession.sparkContext
    tag = f"safe-sql-{uuid.uuid4().hex}"
    sc.setInterruptOnCancel(True)
    sc.addJobTag(tag)
    fired = threading.Event()

    def stop():
        fired.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    timer.start()
    try:
        rows = df.limit(max_rows + 1).collect()
    except Exception as e:  # py4j wraps a cancelled job
        raise SqlRefused("query_timeout" if fired.is_set() else "query_failed", str(e)[:200]) from None
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return rows[:max_rows], len(rows) > max_rows
