"""Files, assets, runs, issues and what they add up to: the catalog's joins, counts and lists.

Frames hold one row for each fact and are only appended to; what is current is a view. Columns:

files     file_id, source_root, filename, relative_path, source_format, support, state, sha256
tables    asset_id, file_id, content, extractor, source_kind, sheet_name, page_number, rows, columns, quality, is_current
texts     asset_id, file_id, content, extractor, source_kind, sheet_name, page_number, text, is_current
cleaning  run_id, asset_id, content, status, quality, started, finished
profiles  run_id, asset_id, rows, columns, chars, chunks
issues    issue_id, asset_id, run_id, issue_type, severity, status, created
semantic  run_id, asset_id, asset_type, current, generated, display_name, category
chunks    asset_id, chunk
runs      run_id, file_id, content, route, status, started, finished
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions import text as tx
from sievework.operators.history import latest_by

# fixed values: the issue type that only routes, open states, formats by kind, routes by format
HINT = "possible_table_candidate"
VISIBLE = ("open", "accepted")
ISSUE_STATES = ("open", "accepted", "dismissed", "resolved")
DOCUMENTS, PICTURES, SHEETS = ("pdf", "docx", "txt", "doc", "ppt", "pptx"), ("jpeg", "png"), ("csv", "tsv", "xls", "xlsx")
DONE = ("successful", "partial")
IMAGE_ROUTES = ("ocr_rapidocr", "vision_llm")
MAX_PAGE = 100_000


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("finished"), F.desc("started"), F.desc("run_id")]


def latest_cleaning(cleaning: DataFrame) -> DataFrame:
    return latest_by(cleaning, ["asset_id", "content"], newest_first())


def current_semantic(semantic: DataFrame) -> DataFrame:
    return latest_by(semantic.where("current"), ["asset_id", "asset_type"], [F.desc("generated"), F.desc_nulls_last("run_id")])


def visible_issues(issues: DataFrame) -> DataFrame:
    """The newest issue of each asset and type, without routing hints."""
    rows = issues.where(F.col("issue_type") != HINT)
    return latest_by(rows, ["asset_id", "issue_type"], [F.desc_nulls_last("created"), F.asc("issue_id")])


def issue_counts(issues: DataFrame, latest: DataFrame) -> DataFrame:
    """(asset_id, issues): open and accepted ones of the latest cleaning runs or of none; types count as often as they occur."""
    known = latest.select(F.col("run_id"), F.lit(True).alias("known"))
    rows = issues.where(F.col("issue_type") != HINT).join(known, "run_id", "left").where("run_id is null or known")
    return rows.groupBy("asset_id").agg(F.count_if(F.col("status").isin(*VISIBLE)).alias("issues"))


def _quality_of_table(quality: Column, review: Column) -> Column:
    return F.when(review, "needs_review").when(quality == "pass", "ready").when(quality == "fail", "unusable").otherwise("needs_review")


def _quality_of_text(text: Column, extractor: Column) -> Column:
    return F.when(F.length(F.trim(text)) == 0, "unusable").when(F.lower(extractor).contains("ocr"), "needs_review").otherwise("ready")


def current_assets(tables: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """Current tables and texts of present files in one frame, with what the file and the reader say of their quality."""
    here = files.where("state = 'present'").select("file_id", "source_root", "filename", "source_format", F.col("relative_path").alias("source_file"))
    t = tables.where("is_current").join(here, "file_id")
    review = (F.col("source_format") == "pdf") | rules.candidate(F.col("source_kind"), F.col("extractor"))
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("asset_id")).cast("string")
    name = (
        F.when(F.col("sheet_name").isNotNull(), F.concat("filename", F.lit(" / "), "sheet_name"))
        .when(F.col("page_number").isNotNull(), F.concat("filename", F.lit(" / Page "), F.col("page_number").cast("string"), F.lit(" / Table "), number("file_id", "page_number")))
        .when(F.col("source_kind") == "image", F.concat("filename", F.lit(" / Table "), number("file_id")))
        .otherwise(F.col("filename"))
    )
    common = ["asset_id", "file_id", "source_root", "source_file", "source_format", "content", "extractor", "source_kind", "sheet_name", "page_number"]
    null = lambda kind: F.lit(None).cast(kind)
    t = t.select(F.lit("table").alias("asset_type"), *common, name.alias("fallback_name"), F.col("rows").cast("bigint").alias("rows"), F.col("columns").cast("bigint").alias("columns"), null("bigint").alias("chars"), _quality_of_table(F.col("quality"), review).alias("base_quality"))
    x = texts.where("is_current").join(here, "file_id")
    page = F.when(F.col("page_number").isNotNull(), F.concat("filename", F.lit(" / Page "), F.col("page_number").cast("string"))).otherwise(F.col("filename"))
    x = x.select(F.lit("text").alias("asset_type"), *common, page.alias("fallback_name"), null("bigint").alias("rows"), null("bigint").alias("columns"), tx.char_count(F.col("text")).alias("chars"), _quality_of_text(F.col("text"), F.col("extractor")).alias("base_quality"))
    return t.unionByName(x)


def view(assets: DataFrame, cleaning: DataFrame, profiles: DataFrame, issues: DataFrame, semantic: DataFrame, chunks: DataFrame) -> DataFrame:
    """The catalog: current assets with their latest cleaning, its profile, counts of issues and chunks, the current description."""
    latest = latest_cleaning(cleaning)
    run = latest.select("asset_id", "content", F.col("run_id").alias("cleaning_run"), F.col("status").alias("cleaning_status"), F.col("quality").alias("cleaned_quality"))
    profile = profiles.select(F.col("run_id").alias("cleaning_run"), "asset_id", F.col("rows").alias("p_rows"), F.col("columns").alias("p_columns"), F.col("chars").alias("p_chars"), F.col("chunks").alias("p_chunks"))
    counted = chunks.groupBy("asset_id").agg(F.count("*").alias("n_chunks"))
    described = current_semantic(semantic).select("asset_id", "asset_type", F.col("display_name").alias("semantic_name"), "category", F.lit(True).alias("described"))
    rows = assets.join(run, ["asset_id", "content"], "left").join(profile, ["cleaning_run", "asset_id"], "left").join(issue_counts(issues, latest), "asset_id", "left")
    rows = rows.join(counted, "asset_id", "left").join(described, ["asset_id", "asset_type"], "left")
    text = F.col("asset_type") == "text"
    return rows.select(
        "asset_id", "asset_type", "file_id", "source_root", "source_file", "source_format", "content", "extractor", "source_kind", "sheet_name", "page_number", "fallback_name", "semantic_name",
        F.coalesce("semantic_name", "fallback_name").alias("display_name"),
        "category",
        F.coalesce("p_rows", "rows").alias("rows"),
        F.coalesce("p_columns", "columns").alias("columns"),
        F.when(text, F.coalesce("p_chars", "chars")).alias("chars"),
        F.when(text, F.coalesce("p_chunks", "n_chunks", F.lit(0))).alias("chunks"),
        F.coalesce("cleaned_quality", "base_quality").alias("quality"),
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.when(F.col("described"), "enriched").otherwise("pending").alias("semantic_status"),
        F.coalesce("cleaning_status", F.lit("not_run")).alias("cleaning_status"),
        "cleaning_run",
    )


def summary(catalog: DataFrame, files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of all counters: assets, files and the visible issues of assets in the catalog."""
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v}")
    total = lambda kind, c, name: F.coalesce(F.sum(F.when(F.col("asset_type") == kind, F.col(c))), F.lit(0)).alias(name)
    a = catalog.agg(
        F.count("*").alias("assets"), is_("asset_type", "table"), total("table", "rows", "table_rows"), is_("asset_type", "text"), total("text", "chunks", "text_chunks"),
        *[is_("quality", q) for q in ("ready", "needs_review", "unusable")], *[is_("semantic_status", q) for q in ("pending", "enriched")], *[is_("cleaning_status", q) for q in ("successful", "failed", "not_run")],
    )
    f = files.where("state = 'present'").agg(F.count("*").alias("files"), F.count_if(F.col("support") == "supported").alias("supported_files"), F.count_if(~F.col("support").eqNullSafe(F.lit("supported"))).alias("unsupported_files"))
    here = catalog.select(F.col("asset_id").alias("a"), F.col("cleaning_run").alias("r"))
    seen = visible_issues(issues).join(here, (F.col("asset_id") == F.col("a")) & (F.col("run_id").isNull() | (F.col("run_id") == F.col("r"))), "left_semi")
    i = seen.agg(F.count_if(F.col("status").isin(*VISIBLE)).alias("visible_issues"), F.count_if(F.col("status") == "open").alias("open_issues"))
    return f.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(i))  # three rows


def route_status(files: DataFrame, runs: DataFrame, prefer_vision: bool = False) -> DataFrame:
    """(file_id, status) of present files: from the newest run of each route on the file's content.

    A picture has the status of the newest run of its two routes; with ``prefer_vision`` that of the vision route if it has any.
    """
    here = files.where("state = 'present'").select("file_id", F.col("sha256").alias("content"), "support", "source_format")
    own = runs.join(here.select("file_id", "content"), ["file_id", "content"], "left_semi")
    by_route = latest_by(own, ["file_id", "content", "route"], newest_first())
    first = [(F.col("route") == "vision_llm").desc()] if prefer_vision else []
    picture = latest_by(own.where(F.col("route").isin(*IMAGE_ROUTES)), ["file_id", "content"], first + newest_first()).select("file_id", F.col("status").alias("image"))
    names = {"structured_native": "structured", "pdf_native_text": "pdf", "ocr_rapidocr": "ocr", "text_plain": "plain", "docx_native": "docx"}
    wide = by_route.groupBy("file_id").pivot("route", list(names)).agg(F.max("status")).withColumnsRenamed(names)
    rows = here.join(wide, "file_id", "left").join(picture, "file_id", "left")
    form = F.col("source_format")
    pdf = (
        F.when((F.col("pdf") == "failed") | (F.col("ocr") == "failed"), "failed")
        .when(F.col("pdf").isin(*DONE) | F.col("ocr").isin(*DONE), "successful")
        .otherwise(F.coalesce("pdf", "ocr"))
    )
    status = (
        F.when(F.col("support") != "supported", "unsupported")
        .when(F.col("content").isNull(), "failed")
        .when(form.isin(*SHEETS), F.col("structured"))
        .when(form == "pdf", pdf)
        .when(form.isin(*PICTURES), F.col("image"))
        .when(form == "txt", F.col("plain"))
        .when(form == "docx", F.col("docx"))
    )
    return rows.select("file_id", status.alias("status"))


def processing_counts(files: DataFrame, runs: DataFrame, prefer_vision: bool = False) -> DataFrame:
    """One row: files processed, failed, deferred and finished either way; unsupported ones count nowhere."""
    s = F.col("status")
    out = route_status(files, runs, prefer_vision).agg(F.count_if(s.isin(*DONE)).alias("processed"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isNull() | ~s.isin(*DONE, "failed", "unsupported")).alias("deferred"))
    return out.withColumn("terminal", F.col("processed") + F.col("failed"))


def file_rollup(files: DataFrame, assets: DataFrame, cleaning: DataFrame, issues: DataFrame, semantic: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each file: assets by kind and quality, pages, usable evidence, visible issues, and its statuses."""
    latest = latest_cleaning(cleaning)
    seen = visible_issues(issues).join(latest.select("run_id", F.lit(True).alias("known")), "run_id", "left").where("run_id is null or known")
    counts = seen.groupBy("asset_id").agg(F.count_if(F.col("status").isin(*VISIBLE)).alias("n_issues"))
    described = current_semantic(semantic).select("asset_id", "asset_type", F.lit(1).alias("described"))
    rows = assets.join(latest.select("asset_id", "content", F.col("quality").alias("cleaned")), ["asset_id", "content"], "left").join(counts, "asset_id", "left").join(described, ["asset_id", "asset_type"], "left")
    rows = rows.withColumn("q", F.coalesce("cleaned", "base_quality"))
    text, table = F.col("asset_type") == "text", F.col("asset_type") == "table"
    usable = (text & (F.col("chars") > 0)) | (table & (F.col("q") == "ready") & ~rules.candidate(F.col("source_kind"), F.col("extractor")))
    per_file = rows.groupBy("file_id").agg(
        F.count_if(table).alias("tables"), F.count_if(text).alias("texts"), F.count_if(text & F.col("page_number").isNotNull()).alias("paged"), F.count_if(text & F.col("page_number").isNull()).alias("unpaged"),
        *[F.count_if(F.col("q") == q).alias(q) for q in ("unusable", "needs_review", "ready")],
        F.count_if(usable).alias("usable"), F.coalesce(F.sum("n_issues"), F.lit(0)).alias("issues"), F.count("described").alias("enriched"),
    )
    newest = latest_by(runs, ["file_id", "route"], newest_first()).groupBy("file_id").agg(F.count_if(F.col("status").isin(*DONE)).alias("good"), F.count_if(F.col("status") == "failed").alias("bad"), F.count("*").alias("routes"))
    out = files.join(per_file, "file_id", "left").join(newest, "file_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    supported, empty = F.col("support") == "supported", (n("good") > 0) & (n("usable") == 0)
    processing = F.when(~supported, "unsupported").when(empty, "no_evidence").when(n("good") > 0, "ready").when(n("bad") > 0, "failed").when(n("routes") == 0, "not_processed").otherwise("processing")
    quality = F.when(n("unusable") > 0, "unusable").when(n("needs_review") > 0, "needs_review").when(n("ready") > 0, "ready").otherwise("not_assessed")
    evidence = F.when(supported & empty, "no_evidence").when(supported & (n("good") > 0), "available").otherwise("not_assessed")
    return out.select(
        "file_id", "filename", "relative_path", "source_format", "support", "state", "sha256", n("tables").alias("tables"), n("texts").alias("texts"),
        F.when(n("paged") > 0, n("paged")).when(n("unpaged") > 0, 1).otherwise(0).cast("bigint").alias("text_pages"),
        n("issues").alias("issues"), processing.alias("processing_status"), quality.alias("quality_status"), evidence.alias("evidence_status"), F.when(n("enriched") > 0, "enriched").otherwise("pending").alias("semantic_status"),
    )


def category_filter(category: str | None) -> Column:
    """A kind of files as a condition on the roll-up; unknown kinds are refused."""
    known = {
        None: F.lit(True), "all": F.lit(True), "table_file": F.col("tables") > 0, "document": F.col("source_format").isin(*DOCUMENTS), "image": F.col("source_format").isin(*PICTURES),
        "ignored": F.col("support") != "supported", "unprocessed": F.col("processing_status") == "not_processed", "failed": F.col("processing_status") == "failed",
    }
    if category not in known:
        raise ValueError(f"category {category}")
    return known[category]


def _like(words: str, *columns: str) -> Column:
    """Any of the columns holds the words in any case; % and _ are wildcards, a backslash is itself."""
    pattern = "%" + words.strip().replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def _paged(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page with the total of all rows beside it; a page behind the end is one row of nulls with the total."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit or offset")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit).withColumn("has_next", F.lit(True))
    out = total.join(page, F.lit(True), "left")
    return out.withColumn("has_next", F.col("total") > F.lit(offset + limit)).select(*rows.columns, "total", "has_next")


def list_files(rollup: DataFrame, category: str | None = None, quality: str | None = None, source_format: str | None = None, words: str | None = None, ignored: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = rollup.where("state = 'present'").where(category_filter(category))
    if category != "ignored" and not ignored:
        rows = rows.where("support = 'supported'")
    if source_format:
        rows = rows.where(F.col("source_format") == source_format.casefold().lstrip("."))
    if quality:
        rows = rows.where(F.col("quality_status") == quality)
    if words and words.strip():
        rows = rows.where(_like(words, "filename", "relative_path"))
    return _paged(rows, [F.col("relative_path"), F.col("file_id")], limit, offset)


def list_assets(catalog: DataFrame, source_root: str | None = None, asset_type: str | None = None, quality: str | None = None, source_format: str | None = None, words: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = catalog
    for column, value in (("source_root", source_root), ("asset_type", asset_type), ("quality", quality), ("source_format", source_format)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if words and words.strip():
        rows = rows.where(_like(words, "display_name", "fallback_name", "source_file"))
    return _paged(rows, [F.col("source_file"), F.col("asset_type"), F.col("asset_id")], limit, offset)


def list_issues(issues: DataFrame, catalog: DataFrame, status: str | None = None, severity: str | None = None, asset: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of visible issues, newest first, with the names of their assets, looked up for the page only."""
    rows = visible_issues(issues)
    for column, value in (("status", status), ("severity", severity), ("asset_id", asset)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    page = _paged(rows, [F.desc("created"), F.col("issue_id")], limit, offset)
    return page.join(catalog.select("asset_id", "asset_type", "display_name", "source_file"), "asset_id", "left")


def issue_counts_for(selected: list[tuple[str, str | None]], issues: DataFrame) -> DataFrame:
    """(asset_id, issues) for the assets of a page, given with their cleaning runs; assets without issues count 0."""
    wanted = issues.sparkSession.createDataFrame(selected, "asset_id string, cleaning_run string")
    rows = visible_issues(issues).where(F.col("status").isin(*VISIBLE)).select(F.col("asset_id").alias("a"), F.col("run_id").alias("r"), "issue_id")
    on = (F.col("asset_id") == F.col("a")) & (F.col("r").isNull() | (F.col("r") == F.col("cleaning_run")))
    return F.broadcast(wanted).join(rows, on, "left").groupBy("asset_id").agg(F.count("issue_id").alias("issues"))  # a page of assets


def set_issue_status(events: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues after status events (issue_id, status, at): the last legal one wins."""
    last = latest_by(events.where(F.col("status").isin(*ISSUE_STATES)), ["issue_id"], [F.desc("at"), F.desc("status")]).select("issue_id", F.col("status").alias("__to"))
    return issues.join(last, "issue_id", "left").withColumn("status", F.coalesce("__to", "status")).drop("__to")


def merged_issues(before: DataFrame, found: DataFrame) -> DataFrame:
    """Issues after a cleaning run: one with a known id takes the new status and evidence."""
    both = before.withColumn("__new", F.lit(0)).unionByName(found.withColumn("__new", F.lit(1)))
    return latest_by(both, ["issue_id"], [F.desc("__new"), F.desc_nulls_last("created")]).drop("__new")


def asset_detail(asset: str, catalog: DataFrame, issues: DataFrame, semantic: DataFrame) -> DataFrame:
    """One asset with its visible issues and its descriptions' runs, oldest first."""
    one = catalog.where(F.col("asset_id") == asset)
    seen = visible_issues(issues.where(F.col("asset_id") == asset)).where(F.col("status").isin(*VISIBLE)).join(one.select(F.col("cleaning_run").alias("cr")), F.col("run_id").isNull() | (F.col("run_id") == F.col("cr")))
    listed = seen.agg(F.array_sort(F.collect_list(F.struct("issue_type", "status"))).alias("open_issues"))
    runs = semantic.where(F.col("asset_id") == asset).agg(F.transform(F.array_sort(F.collect_list(F.struct("generated", "run_id"))), lambda x: x["run_id"]).alias("semantic_runs"))
    return one.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(runs))  # one row each


def metadata_of(assets: DataFrame, columns: DataFrame, samples: DataFrame, semantic: DataFrame) -> DataFrame:
    """Assets with what search reads of them: arrays of column names and sample values, and the current description's words."""
    named = columns.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("columns"))
    sampled = samples.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    words = current_semantic(semantic).select("asset_id", "keywords")
    return assets.join(named, "asset_id", "left").join(sampled, "asset_id", "left").join(words, "asset_id", "left")


def insight_status(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, insight): the ladder from files (file_id, evidence_status) and queue records (file_id, state, phase, at)."""
    last = latest_by(records, ["file_id"], [F.desc("at"), F.asc("state")])
    state = F.col("state")
    ladder = (
        F.when(F.col("evidence_status") == "no_evidence", "no_evidence")
        .when(state == "queued", "queued")
        .when(state == "running", F.coalesce("phase", F.lit("running")))
        .when(state == "failed", "failed")
        .when(state == "completed", "ready")
        .otherwise("not_started")
    )
    return files.join(last, "file_id", "left").select("file_id", ladder.alias("insight"))


def queue_counts(records: DataFrame) -> DataFrame:
    """One row: insight records by state, running ones by phase, and all."""
    last = latest_by(records, ["file_id"], [F.desc("at"), F.asc("state")])
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "completed", "failed", "cancelled")]
    phases = [F.count_if((F.col("state") == "running") & (F.col("phase") == p)).alias(f"running_{p}") for p in ("preparing", "calling", "saving")]
    return last.agg(*states, *phases, F.count("*").alias("total"))


def stale_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """Queued records whose file has other content by now are cancelled; running ones wait again after a restart."""
    now = files.select("file_id", F.col("sha256").alias("__now"))
    rows = records.join(now, "file_id", "left")
    changed = ~F.col("content").eqNullSafe(F.col("__now"))
    state = F.when((F.col("state") == "queued") & changed, "cancelled").when(F.col("state") == "running", "queued").otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("__now")


def insight_preview(rollup: DataFrame, records: DataFrame) -> DataFrame:
    """One row: files ready for insight, those with a finished record of their content, those being worked on, and what is left."""
    last = latest_by(records, ["file_id", "content"], [F.desc("at"), F.asc("state")]).select("file_id", F.col("content").alias("sha256"), F.col("state").alias("record"))
    ready = rollup.where("processing_status = 'ready' and sha256 is not null").join(last, ["file_id", "sha256"], "left")
    out = ready.agg(F.count("*").alias("ready"), F.count_if(F.col("record") == "completed").alias("cached"), F.count_if(F.col("record").isin("queued", "running")).alias("active"))
    return out.withColumn("pending", F.col("ready") - F.col("cached") - F.col("active"))


def file_detail(file_id: str, rollup: DataFrame, texts: DataFrame, tables: DataFrame, budget: int = 12_000) -> DataFrame:
    """(file_id, processing_status, kind, asset_id, page_number, text): a file's children; texts by page share one budget of characters."""
    from sievework.operators.evidence import context_blocks

    one = rollup.where(F.col("file_id") == file_id).select("file_id", "processing_status")
    own = texts.where((F.col("file_id") == file_id) & F.col("is_current")).select("file_id", "asset_id", "page_number", "text")
    own = own.withColumn("page_order", F.coalesce("page_number", F.lit(2**40)))
    shown = context_blocks(own, "file_id", ["page_order", "asset_id"], "text", budget)
    t = tables.where((F.col("file_id") == file_id) & F.col("is_current")).select("file_id", F.lit("table").alias("kind"), "asset_id", "page_number", F.lit(None).cast("string").alias("text"))
    children = shown.select("file_id", F.lit("text").alias("kind"), "asset_id", "page_number", "text").unionByName(t)
    return one.join(children, "file_id", "left")


def reprocess_refusal(row_state: Column, relative_path: Column, known: Column, now: Column) -> Column:
    """Why one file may not be processed again: gone, outside of its root, or with other content than is registered; else null."""
    outside = relative_path.rlike(r"^(?:/|[A-Za-z]:)") | relative_path.rlike(r"(?:^|/)\.\.(?:/|$)")
    return F.when(row_state != "present", "missing").when(outside, "outside_root").when(~known.eqNullSafe(now), "content_changed")


def counts(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: tables, texts and chunks that search sees."""
    a = assets.agg(F.count_if(F.col("asset_type") == "table").alias("tables"), F.count_if(F.col("asset_type") == "text").alias("texts"))
    return a.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # two rows
