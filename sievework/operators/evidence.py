"""Evidence: actions of an analysis, grounding of findings, facts of a report, context within a budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.sinks import canonical_json

# fixed values: fields of each action and its bounds
ACTIONS = {"search": {"query"}, "context": {"asset_ids"}, "sql": {"asset_ids", "sql"}, "final": {"findings"}}
MAX_ASSETS, MAX_QUERY, MAX_STEPS, MAX_BLOCKS = 8, 512, 6, 500


MAX_EVIDENCE, MAX_SNAPSHOT, MAX_OBSERVATIONS, MAX_SQL_ROWS, MAX_SQL_COLUMNS, MAX_FINDINGS, MAX_TEXT, MAX_FILES = 128, 256 * 1024, 96, 100, 32, 64, 4000, 1024
SECRET = ("api_key", "apikey", "secret", "password", "token")
PATHS = ("root", "path", "absolutepath", "absolute_path", "registrypath", "registry_path", "workspaceroot", "workspace_root", "artifactpath", "artifact_path")
#: Fields of evidence that a report may show.
SHOWN = ("kind", "asset_id", "asset_type", "display_name", "source", "row_count", "truncated", "text", "snippet", "columns", "rows", "profile")


class ActionRefused(ValueError):
    pass


def checked_action(action: dict) -> dict:
    """An action with exactly its fields, within bounds."""
    kind = action.get("action")
    if kind not in ACTIONS:
        raise ActionRefused("unknown action")
    if set(action) != ACTIONS[kind] | {"action"}:
        raise ActionRefused("fields")
    if "query" in action and not 0 < len(str(action["query"]).strip()) <= MAX_QUERY:
        raise ActionRefused("query")
    if "asset_ids" in action and not (0 < len(action["asset_ids"]) <= MAX_ASSETS and len(set(action["asset_ids"])) == len(action["asset_ids"])):
        raise ActionRefused("asset_ids")
    return action


def run_analysis(provider, tools: dict, most: int = MAX_STEPS) -> tuple[list[dict], str]:
    """Let a provider act until it is final: (findings, status). Tools map an action to (observation, evidence ids)."""
    manifest: set[str] = set()
    seen: list = []
    for _ in range(most):
        action = checked_action(provider(list(seen)))
        if action["action"] == "final":
            return grounded(action["findings"], manifest)
        observation, ids = tools[action["action"]](action)
        manifest |= set(ids)
        seen.append(observation)
    return [], "insufficient_evidence"


def grounded(findings: list[dict], manifest: set[str]) -> tuple[list[dict], str]:
    """Findings with ids, all of them seen, and not marked unconfirmed."""
    good = [f for f in findings if f.get("evidence") and set(f["evidence"]) <= manifest and f.get("status") != "unconfirmed"]
    return good, "completed" if good else "insufficient_evidence"


def ground_findings(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(finding, n_cited, grounded) of rows (finding, evidence array, status) against a frame of evidence ids."""
    cited = findings.select("finding", "status", F.explode_outer("evidence").alias("id"))
    known = manifest.select(F.col("id"), F.lit(True).alias("known")).distinct()
    g = cited.join(known, "id", "left").groupBy("finding").agg(F.count("id").alias("n_cited"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"), F.first("status").alias("status"))
    return g.select("finding", "n_cited", (F.col("all_known") & (F.col("n_cited") > 0) & ~F.col("status").eqNullSafe(F.lit("unconfirmed"))).alias("grounded"))


def context_blocks(blocks: DataFrame, key: str, order: list[str], text: str, budget: int, most: int = MAX_BLOCKS) -> DataFrame:
    """The first ``most`` blocks of each key within a budget of characters; the block that crosses it is cut."""
    first = Window.partitionBy(key).orderBy(*order)
    some = blocks.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most).drop("__r")
    used = F.coalesce(F.sum(F.length(text)).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = some.withColumn("__left", F.lit(budget) - used).where("__left > 0")
    return rows.withColumn(text, F.col(text).substr(F.lit(1), F.col("__left").cast("int"))).drop("__left")


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int, most: int = MAX_BLOCKS) -> DataFrame:
    """The first ``most`` rows of each key whose running sum of sizes in the order of a unique column stays within a budget, with ``used``.

    Only ``most`` rows of a key and task are shuffled, however many rows a key has.
    """
    first = Window.partitionBy(key).orderBy(order)
    some = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most).drop("__r")
    used = F.sum(size).over(first.rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("used", used.cast("bigint")).where(F.col("used") <= budget)


def table_facts(profile: DataFrame, asset: str) -> DataFrame:
    """(fact, text) from a column profile: shape, missing values, first numeric column."""
    shape = profile.agg(F.max("n").alias("rows"), F.count("*").alias("cols"), F.sum("n_null").alias("missing"), F.min(F.when(F.col("mean_value").isNotNull(), F.struct("column_name", "min_value", "max_value", "mean_value"))).alias("num"))
    rows = F.array(
        F.struct(F.lit("shape").alias("fact"), F.format_string("%s has %s rows and %s columns", F.lit(asset), "rows", "cols").alias("text")),
        F.struct(F.lit("missing").alias("fact"), F.format_string("%s has %s missing values", F.lit(asset), "missing").alias("text")),
        F.struct(
            F.lit("numeric").alias("fact"),
            F.when(F.col("num").isNotNull(), F.concat_ws("", F.col("num.column_name"), F.lit(" from "), F.round("num.min_value", 2).cast("decimal(30,2)").cast("string"), F.lit(" to "), F.round("num.max_value", 2).cast("decimal(30,2)").cast("string"))).alias("text"),
        ),
    )
    return shape.select(F.inline(rows)).where("text is not null")


def shared_columns(schemas: DataFrame) -> DataFrame:
    """(a, b, column_name) of pairs of tables with a column in common, from rows (table_name, column_name)."""
    a, b = schemas.alias("a"), schemas.alias("b")
    on = (F.lower("a.column_name") == F.lower("b.column_name")) & (F.col("a.table_name") < F.col("b.table_name"))
    return a.join(b, on).select(F.col("a.table_name").alias("a"), F.col("b.table_name").alias("b"), F.lower("a.column_name").alias("column_name"))


def bounded(value: Any, depth: int = 0, items: int = 128, chars: int = MAX_TEXT) -> Any:
    """A value fit for a model: six levels deep, lists, maps and strings cut, keys of secrets and places left out."""
    if depth > 6:
        return "[nested value omitted]"
    if isinstance(value, str):
        return value[:chars]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if value is None or isinstance(value, bool | int | float):
        return value
    if isinstance(value, bytes):
        return value[:chars].hex()
    if isinstance(value, Mapping):
        out = {}
        for k, v in list(value.items())[:items]:
            low = str(k).casefold().replace("-", "_")
            if low not in PATHS and not any(s in low for s in SECRET):
                out[str(k)] = bounded(v, depth + 1, items, chars)
        return out
    if isinstance(value, list | tuple | set):
        return [bounded(v, depth + 1, items, chars) for v in list(value)[:items]]
    return str(value)[:chars]


def safe_path(path: Column) -> Column:
    """A relative path of up to 512 characters; null for one from a root or drive."""
    clean = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.when(~clean.rlike(r"^(?:/|[A-Za-z]:/)") & (F.length(clean) > 0), F.substring(clean, 1, 512))


def without_secrets(values: Column) -> Column:
    """A map of strings without the keys that hold secrets or places."""
    low = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_"))
    return F.map_filter(values, lambda k, v: ~low(k).rlike("|".join(SECRET)) & ~low(k).isin(*PATHS))


def snapshot(findings: DataFrame, manifest: DataFrame, most: int = MAX_EVIDENCE) -> DataFrame:
    """(evidence_id, value, place): evidence that findings (run, place, evidence_ids) cite, in their order, then the rest of (run, place, evidence_id, value); each once."""
    order = F.struct("run", "place")
    cited = findings.select(F.lit(0).alias("tier"), order.alias("at"), F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    listed = manifest.select(F.lit(1).alias("tier"), order.alias("at"), F.lit(0).alias("pos"), "evidence_id")
    first = cited.unionByName(listed).groupBy("evidence_id").agg(F.min(F.struct("tier", "at", "pos")).alias("k"))
    value = manifest.groupBy("evidence_id").agg(F.min(F.struct(order.alias("at"), "value")).alias("v")).select("evidence_id", F.col("v.value").alias("value"))
    top = first.join(value, "evidence_id").orderBy("k", "evidence_id").limit(most)
    return top.select("evidence_id", "value", F.row_number().over(Window.orderBy("k", "evidence_id")).cast("bigint").alias("place"))  # ``most`` rows


def projected(evidence: Mapping[str, Mapping]) -> list[dict]:
    """Evidence as a report shows it: known fields, 100 rows of 32 columns; only names and snippets if it is large."""
    out = []
    for key, value in list(evidence.items())[:MAX_EVIDENCE]:
        item = {"evidence_id": key} | {k: bounded(value[k]) for k in SHOWN if value.get(k) is not None}
        if isinstance(item.get("rows"), list):
            item["rows"] = [dict(list(r.items())[:MAX_SQL_COLUMNS]) if isinstance(r, Mapping) else r for r in item["rows"][:MAX_SQL_ROWS]]
        if isinstance(item.get("columns"), list):
            item["columns"] = item["columns"][:MAX_SQL_COLUMNS]
        out.append(item)
    if len(canonical_json(out).encode()) > MAX_SNAPSHOT:
        keep = ("evidence_id", "kind", "asset_id", "display_name", "source")
        out = [{k: i[k] for k in keep if k in i} | {"snippet": str(i.get("snippet") or i.get("text") or "")[:500]} for i in out]
    return out


def without_repeats(evidence: Sequence[Mapping]) -> list[dict]:
    """Evidence for a model without what is there already: sources shortened, equal rows and snippets once."""
    seen, out = set(), []
    for item in evidence:
        item = dict(item)
        if isinstance(item.get("source"), Mapping):
            key = canonical_json(item["source"])
            if key in seen:
                item["source"] = {k: item["source"][k] for k in ("fileId", "pageNumber", "sheetName") if k in item["source"]}
            seen.add(key)
        if item.get("text") is not None and item.get("snippet") == item["text"]:
            del item["snippet"]
        if isinstance(item.get("rows"), list):
            item["rows"] = list({canonical_json(r): r for r in reversed(item["rows"])}.values())[::-1]
        out.append(item)
    return out


def model_reference(observations: Sequence[Mapping], most: int = MAX_SNAPSHOT) -> list[dict]:
    """The last observations, or only their heads if they are too large together."""
    last = [bounded(o) for o in observations[-MAX_OBSERVATIONS:]]
    if len(canonical_json(last).encode()) <= most:
        return last
    return [{k: o[k] for k in ("action", "asset_id", "display_name", "evidence_id") if k in o} | {"truncated": True} for o in last]


def checked_citations(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations (asset_id, page_number, sheet_name) that aren't among the allowed ones: there must be none."""
    a, b = cited.alias("a"), allowed.alias("b")
    same = (F.col("a.asset_id") == F.col("b.asset_id")) & F.col("a.page_number").eqNullSafe(F.col("b.page_number")) & (F.coalesce("a.sheet_name", F.lit("")) == F.coalesce("b.sheet_name", F.lit("")))
    return a.join(b, same, "left_anti")


def insight_context(sections: DataFrame, tables: DataFrame, budget: int = 96 * 1024) -> DataFrame:
    """What a model may read of a file: text blocks (file_id, place, text) and tables (file_id, place, text, candidate) within a budget.

    Of candidate tables only a note is shown.
    """
    note = F.lit("[a candidate table; its cells are not confirmed]")
    shown = tables.select("file_id", "place", F.when(F.col("candidate"), note).otherwise(F.col("text")).alias("text"))
    return context_blocks(sections.select("file_id", "place", "text").unionByName(shown), "file_id", ["place"], "text", budget)


def selected_files(files: DataFrame, ids: Sequence[str] | None = None, condition: Column | None = None) -> DataFrame:
    """Present files by their ids (10,000 at most), by a condition, or the first 1,024 by path."""
    here = files.where("state = 'present'")
    if ids is not None:
        if not 0 < len(ids) <= 10_000:
            raise ValueError("ids")
        wanted = files.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "file_id string")
        return here.join(F.broadcast(wanted), "file_id", "left_semi")  # 10,000 ids at most
    return (here.where(condition) if condition is not None else here).orderBy("relative_path", "file_id").limit(MAX_FILES)


def collected_evidence(insights: DataFrame, texts: DataFrame, tables: DataFrame, most: int = MAX_EVIDENCE) -> DataFrame:
    """(file_id, kind, asset_id, text, place): file summaries, then texts, then trusted tables, then candidates without their rows."""
    tier = lambda df, n, kind, text: df.select(F.lit(n).alias("tier"), "file_id", F.lit(kind).alias("kind"), F.col("asset_id") if "asset_id" in df.columns else F.lit(None).cast("string").alias("asset_id"), text.alias("text"))
    rows = tier(insights, 0, "file_insight", F.col("text")).unionByName(tier(texts, 1, "text", F.col("text")))
    rows = rows.unionByName(tier(tables.where("trusted"), 2, "table", F.col("text"))).unionByName(tier(tables.where("not trusted"), 3, "table_candidate", F.lit(None).cast("string")))
    order = ["tier", "file_id", F.coalesce("asset_id", F.lit(""))]
    top = rows.orderBy(*order).limit(most)
    return top.select("file_id", "kind", "asset_id", "text", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))  # ``most`` rows


def all_facts(asset: str, shape: Mapping, columns: Sequence[Mapping], top: Mapping | None = None) -> list[str]:
    """The sentences of a table that need no model: shape, missing values, repeated rows, first numeric column, most frequent value."""
    out = [f"{asset} has {shape['row_count']} rows and {shape['column_count']} columns"]
    if shape.get("null_count"):
        out.append(f"{asset} has {shape['null_count']} missing values ({shape['empty_cell_ratio']:.1%})")
    if shape.get("duplicate_rows"):
        out.append(f"{asset} has {shape['duplicate_rows']} rows that are repeated")
    number = next((c for c in columns if c.get("mean_value") is not None), None)
    if number:
        out.append(f"{number['column_name']} is {number['min_value']} to {number['max_value']}, {number['mean_value']} on average")
    if top:
        out.append(f"the most frequent value is {top['value']}, {top['frequency']} times")
    return out


def statistics_text(results: Mapping[str, Mapping | None]) -> tuple[list[str], list[str]]:
    """(findings, limitations) of the statistics that were taken: one sentence each, and what could not be."""
    found, lacking = [], []
    if (n := results.get("rows")) is None:
        return found, ["no table to count"]
    found.append(f"{n['n']} rows")
    if s := results.get("numeric"):
        found.append(f"{s['column']}: {s['lowest']} to {s['highest']}, mean {s['mean']}, deviation {s['deviation']}")
    else:
        lacking.append("no numeric column")
    if (o := results.get("outliers")) is not None:
        found.append(f"{o['outliers']} values beyond three deviations")
    if c := results.get("category"):
        found.append(f"most frequent: {c['value']} ({c['frequency']})")
    else:
        lacking.append("no category column")
    if t := results.get("trend"):
        found.append(f"{t['periods']} periods from {t['first']} to {t['last']}")
    else:
        lacking.append("no column of time")
    return found, lacking


REPORT_FIELDS = {"title", "executive_summary", "sections", "key_findings", "limitations"}


def checked_report(value: Any, evidence: set[str]) -> dict:
    """A report with exactly its fields whose findings cite known evidence; anything else is refused."""
    if not isinstance(value, Mapping) or set(value) != REPORT_FIELDS:
        raise ValueError("fields")
    if not all(isinstance(value[k], str) and value[k].strip() for k in ("title", "executive_summary")):
        raise ValueError("title or summary")
    if not isinstance(value["sections"], list) or any(set(s) != {"heading", "content"} for s in value["sections"]):
        raise ValueError("sections")
    for f in value["key_findings"]:
        if set(f) != {"statement", "evidence_ids"} or not f["evidence_ids"] or not set(f["evidence_ids"]) <= evidence:
            raise ValueError("a finding without known evidence")
    return dict(value)


def report(title: str, answers: Sequence[str], findings: Sequence[Mapping], facts: Sequence[str], evidence: Mapping[str, Mapping], model: Callable[[dict], Any] | None = None) -> tuple[dict, str]:
    """(report, origin): a model's report if it keeps to the rules, else the one put together here (``deterministic``)."""
    shown = projected(evidence)
    ids = {e["evidence_id"] for e in shown}
    good = [{"statement": f["statement"], "evidence_ids": [i for i in f["evidence_ids"] if i in ids]} for f in findings]
    own = {
        "title": title,
        "executive_summary": "; ".join([*answers, *facts[:8]])[:MAX_TEXT] or "The data at hand do not support a conclusion.",
        "sections": [{"heading": "Statistics", "content": "\n".join(facts)}, {"heading": "Sources", "content": "\n".join(str(e.get("display_name") or e["evidence_id"]) for e in shown)}],
        "key_findings": [f for f in good if f["evidence_ids"]][:MAX_FINDINGS],
        "limitations": [f"unconfirmed: {f['statement']}" for f in good if not f["evidence_ids"]][:MAX_FINDINGS],
    }
    if model is not None:
        try:
            return checked_report(model({"title": title, "evidence": without_repeats(shown), "findings": list(findings)}), ids), "model"
        except Exception:  # a model is outside: its failures end in the report made here
            return own, "deterministic"
    return own, "deterministic"


def stored_name(name: str) -> str:
    """An id that may be part of a stored record's path."""
    if not re.fullmatch(r"[a-z]+_[0-9a-f]{8,64}", name):
        raise ValueError(f"id {name!r}")
    return name


def newest(records: DataFrame, created: str, key: str, n: int = 50) -> DataFrame:
    """Stored records, newest first, 50 at most."""
    return records.orderBy(F.desc(created), F.desc(key)).limit(n)
