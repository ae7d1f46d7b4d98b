"""Registered queries of the research-data operators; their DuckDB oracles are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions import text as tx
from sievework.functions.inference import infer_types
from sievework.operators import chunking, evidence, history, layout, profiling, registry, safe_sql, search, tables
from sievework.plans.fixture import frames
from sievework.plans.oracles import ORACLES
from sievework.sources import documents, sinks

__all__ = ["ORACLES", "QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dirty(col):
    """Texts as they come from files: decomposed letters, Windows line ends, padded lines, blank runs, control characters."""
    col = F.replace(col, F.lit("\u00e9"), F.lit("e\u0301"))
    return F.concat(F.lit(" \x07"), F.replace(col, F.lit("\n"), F.lit(" \t\r\n\r\n\r\n\n")), F.lit("\x0b\r\n"))


# --- text -------------------------------------------------------------------------------------------


@_query
def text_clean_profile(spark, d):
    clean = tx.cleaned(_dirty(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", tx.char_count(clean).alias("char_count"), tx.line_count(clean).alias("line_count"), F.sha2(clean, 256).alias("clean_sha256"))


@_query
def text_clean_actions(spark, d):
    counts = tx.clean_counts(_dirty(F.col("text")))
    listed = F.transform(tx.actions(counts), lambda a: F.concat_ws("=", a["type"], a["count"].cast("string")))
    return _t(spark, d, "documents").select("doc_id", *[n.alias(k) for k, n in counts.items()], F.array_join(listed, " ").alias("actions"))


@_query
def text_extraction_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.extracted(_dirty(F.col("text"))), 256).alias("sha256"))


@_query
def presentation_text(spark, d):
    """Every third line of a text is turned into a list mark of its own."""
    marked = F.regexp_replace("text", r"\n([^\n]{1,6}) ", "\n- \n\n  $1 ")
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.presentation(marked), 256).alias("sha256"))


@_query
def text_issue_rules(spark, d):
    docs = frames(spark, d, "texts")["texts"].withColumn("confidence", F.when(F.col("asset_id").endswith("6"), 0.5))
    rows = docs.withColumn("n", F.length(tx.strip(F.col("text"))))
    issues = rules.text_issues(F.col("n"), F.col("extractor"), F.col("confidence"), F.col("page_number").isNotNull() | ~F.col("asset_id").endswith("1"))
    return rows.withColumn("issues", issues).select("asset_id", F.array_join("issues", ",").alias("issues"), rules.text_issue_status(F.col("issues"), F.col("extractor")).alias("status"))


@_query
def text_quality_by_lang(spark, d):
    status = tx.text_status(tx.cleaned(_dirty(F.col("text"))))
    return _t(spark, d, "documents").groupBy("lang", status.alias("quality")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_query
def effective_chars(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.effective_chars(F.col("text")).alias("effective"))


@_query
def text_chunks(spark, d):
    return chunking.chunks(_t(spark, d, "documents"), "doc_id").select("doc_id", "chunk", "start", "end", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@_query
def chunk_counts(spark, d):
    return chunking.chunks(_t(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end").alias("chars"))


@_query
def chunk_reassembly(spark, d):
    """Chunks joined in their order are the text."""
    found = chunking.chunks(_t(spark, d, "documents"), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "chunk_text"))), lambda x: x["chunk_text"])
    return found.groupBy("doc_id").agg(F.sha2(F.array_join(parts, ""), 256).alias("text_sha256"))


@_query
def search_ranked(spark, d):
    """Names, places and columns of tables and texts, and the chunks of texts, in one ranking."""
    f = frames(spark, d, "files", "tables", "texts")
    assets = registry.current_assets(f["tables"], f["texts"], f["files"])
    assets = assets.select("asset_id", "asset_type", "file_id", F.col("base_quality").alias("quality_status"), "source_kind", "extractor", "source_format", F.col("fallback_name").alias("effective_display_name"), "source_file", "source_root", "sheet_name")
    columns = _t(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("asset_id"), F.array("p_name", "p_brand").alias("columns"), F.array("p_type").alias("samples"))
    request = search.Request(" the  dir1 ", limit=50)
    chunks = search.chunks_of(f["texts"].where("is_current"), "asset_id", request.query)
    hits = search.ranked(assets.join(columns, "asset_id", "left"), chunks, request)
    more = search.ranked(assets.join(columns, "asset_id", "left"), chunks, search.Request("Brand#1", asset_type="table"))
    out = hits.withColumn("request", F.lit(1)).unionByName(more.withColumn("request", F.lit(2)))
    return out.select("request", "asset_id", "asset_type", "chunk", "match_kind", "score", "start", F.sha2("snippet", 256).alias("snippet_sha256"), "place")


@_query
def search_ranked_page(spark, d):
    """One page of the phrase ranking, with the total and the page's details."""
    docs = frames(spark, d, "texts")["texts"].where("is_current")
    assets = docs.select("asset_id", F.lit("text").alias("asset_type"), "file_id", F.lit("ready").alias("quality_status"), "source_kind", "extractor", F.lit("txt").alias("source_format"), F.col("asset_id").alias("effective_display_name"))
    request = search.Request("of the", mode="phrase", limit=40, offset=7)
    hits = search.ranked(assets, search.chunks_of(docs, "asset_id", request.query, request.mode), request)
    page = search.result_page(hits, request, docs.select("asset_id", "page_number"))
    return page.select("asset_id", "chunk", "score", "start", "page_number", "total")


@_query
def file_occurrences(spark, d):
    blocks = frames(spark, d, "texts")["texts"].select("asset_id", F.col("page_number").alias("page"), F.col("sheet_name").alias("section"), F.lit(0).alias("block"), "text")
    found = search.text_occurrences(blocks, "tion")
    return found.select("asset_id", "page", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.sha2("snippet", 256).alias("snippet_sha256"), "occurrence")


@_query
def occurrence_places(spark, d):
    blocks = frames(spark, d, "texts")["texts"].select("asset_id", F.col("page_number").alias("page"), F.col("sheet_name").alias("section"), F.lit(0).alias("block"), "text")
    out = search.matched(search.text_occurrences(blocks, "ononon"))
    return out.select("total", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("sections", ",").alias("sections"))


@_query
def cell_occurrences(spark, d):
    return search.cell_occurrences(_t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey", "a").select(F.col("row"), "column", "column_name", F.col("start").cast("bigint").alias("start"), "snippet")


@_query
def search_all_tokens(spark, d):
    chunks = search.chunks_of(_t(spark, d, "documents"), "doc_id", "the that")
    return search.search_chunks(chunks, "doc_id", "the that").select("doc_id", "chunk", "kind", "score", "start", "place", F.sha2("snippet", 256).alias("snippet_sha256"))


@_query
def search_phrase_page(spark, d):
    chunks = search.chunks_of(_t(spark, d, "documents"), "doc_id", "of the", "phrase")
    hits = search.search_chunks(chunks, "doc_id", "of the", mode="phrase")
    return search.page(hits, "doc_id", limit=50, offset=10).select("doc_id", "chunk", "kind", "score", "start")


@_query
def search_best_field(spark, d):
    part = _t(spark, d, "part")
    fields = part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("effective_display_name", "p_name"), ("column_name", "p_brand"), ("sample_value", "p_type"))])).alias("f")).select("p_partkey", "f.*")
    return search.search_fields(fields, "p_partkey", "BRAND#1").select("p_partkey", "field", "kind", "score")


@_query
def search_total_after_cap(spark, d):
    chunks = search.chunks_of(_t(spark, d, "documents"), "doc_id", "and")
    hits = search.search_chunks(chunks, "doc_id", "and")
    return hits.agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("assets"))


@_query
def text_occurrences(spark, d):
    n = tx.occurrences(F.col("text"), "tion")
    return _t(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")


@_query
def conversation_lines(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("offset"), "role")


# --- tables -----------------------------------------------------------------------------------------


@_query
def cell_normalize(spark, d):
    n = F.col("n_nationkey") % 5
    raw = F.when(n == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit("\t"))).when(n == 1, "N/A").when(n == 2, " null ").when(n == 3, F.concat(F.col("n_name"), F.lit("\r\n"))).otherwise(F.col("n_name"))
    return _t(spark, d, "nation").select("n_nationkey", tx.cell(raw).alias("value"))


@_query
def type_inference(spark, d):
    part = _t(spark, d, "part").select(F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), (F.col("p_size") > 20).cast("string").alias("large"), F.concat(F.lit("2024-01-"), (F.col("p_size") % 28 + 1).cast("string")).alias("day"), F.lit(None).cast("string").alias("nothing"))
    return infer_types(part)


@_query
def exact_duplicates_mark(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return profiling.duplicate_marks(rows).groupBy("l_returnflag", "is_duplicate").agg(F.count("*").alias("n"))


@_query
def exact_duplicates_drop(spark, d):
    """The first of equal rows in the order of the table."""
    rows = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "l_suppkey", "l_returnflag", "l_linestatus")
    return tables.first_of_equals(rows, ["l_suppkey", "l_returnflag", "l_linestatus"], "place")


def _dirty_table(spark, d):
    """Customers as a text table: padded cells, tokens of absence, an empty column, empty rows, repeated rows."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    gone = k % 10 == 0
    cell = lambda v: F.when(gone, F.when(k % 20 == 0, " ").otherwise("N/A")).otherwise(v)
    rows = c.select(
        k.alias("place"),
        cell(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t"))).alias("a"),
        cell((k % 7).cast("string")).alias("b"),
        cell(F.lit("null")).alias("c"),
        cell(F.concat(F.lit("2024/1/"), (k % 28 + 1).cast("string"))).alias("d"),
        cell(F.lpad((k % 50).cast("string"), 4, "0")).alias("e"),
        cell((F.col("c_acctbal") > 0).cast("string")).alias("f"),
    )
    return tables.clean_table(rows, [" Segment name ", "code", "nothing", "day", "CODE", None], "place")


@_query
def clean_table_actions(spark, d):
    out = _dirty_table(spark, d)
    rows = [(a["type"], a["count"]) for a in out.actions] + [("empty_rows_before", out.empty_rows_before), ("duplicate_rows", out.duplicate_rows)]
    return spark.createDataFrame(rows, "type string, count bigint")


@_query
def clean_table_columns(spark, d):
    rows = [(m["source_column_offset"], m["raw"], m["original"], m["normalized"], m["inferred_type"], ",".join(m["risk_reasons"])) for m in _dirty_table(spark, d).columns]
    return spark.createDataFrame(rows, "place bigint, raw string, original string, normalized string, inferred string, risks string")


@_query
def clean_table_rows(spark, d):
    return _dirty_table(spark, d).table


@_query
def column_rename_dedupe(spark, d):
    names = _t(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("place"), F.when(F.col("n_nationkey") % 4 == 0, " ").when(F.col("n_nationkey") % 4 == 1, " Name").otherwise("NAME").alias("name"))
    return tables.numbered_names(names, ["n_regionkey"], "place", "name").select("n_regionkey", "place", "name_out", "duplicate_ordinal")


@_query
def table_preview(spark, d):
    """The first rows and columns of a table, long cells cut."""
    return tables.bounded(_t(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", rows=20, chars=100)


@_query
def table_slice(spark, d):
    return tables.slice_rows(_t(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_totalprice"], 100, 50)


@_query
def matrix_types(spark, d):
    """Types of sheet columns from the types of their cells."""
    li = _t(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "integer").when(F.col("l_linenumber") % 4 == 1, F.when(F.col("l_quantity") > 25, "float").otherwise("integer")).when(F.col("l_linenumber") % 4 == 2, "date").otherwise(F.when(F.col("l_quantity") > 40, "integer").otherwise("string"))
    cells = li.select(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").cast("bigint").alias("col"), F.col("l_returnflag").alias("value"), kind.alias("kind"))
    return tables.typed_matrix(cells, ["sheet"])


@_query
def table_profile_lineitem(spark, d):
    return profiling.column_profile(_t(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])


@_query
def table_profile(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("text"))
    return profiling.table_profile(rows)


@_query
def column_samples(spark, d):
    out = profiling.sample_values(_t(spark, d, "part"), [F.col("p_partkey")], ["p_brand", "p_size"])
    return out.select("column_name", F.array_join("sample_values", "|").alias("samples"))


@_query
def time_ranges(spark, d):
    return profiling.time_range(_t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("l_shipdate")), ["l_shipdate"])


@_query
def table_quality(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(F.col("l_suppkey") % 6 == 0, 1).otherwise(F.count("*")).alias("rows"), F.round(F.count_if(F.col("l_discount") == 0) / F.count("*"), 6).alias("empty_ratio"), F.round(F.avg("l_tax") * 10, 6).alias("confidence"))
    review = F.col("l_suppkey") % 3 == 0
    columns = F.col("l_suppkey") % 5
    warnings = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("possible_title_row"), F.lit("ambiguous_table_boundary")))
    issues = rules.table_issues(F.col("rows"), columns, F.col("empty_ratio"), F.lit(0.6), review, F.col("l_suppkey") % 7 == 0, F.col("confidence"), F.col("l_suppkey") % 11 > 0, warnings)
    out = g.withColumn("issues", issues).withColumn("status", rules.table_status(F.col("issues"), review))
    return out.select("l_suppkey", "rows", F.array_join("issues", ",").alias("issues"), "status", rules.trust(F.col("status"), review).alias("trust"))


@_query
def table_row_counts(spark, d):
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        one = _t(spark, d, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@_query
def numeric_summary(spark, d):
    return profiling.numeric_summary(_t(spark, d, "lineitem"), "l_extendedprice")


@_query
def outliers_3sigma(spark, d):
    return profiling.outlier_count(_t(spark, d, "events"), "value")


@_query
def category_top10(spark, d):
    return profiling.top_categories(_t(spark, d, "customer"), "c_mktsegment")


@_query
def trend_by_day(spark, d):
    return profiling.trend(_t(spark, d, "events"), F.date_trunc("day", "ts"), "value")


@_query
def percentile_nearest_rank(spark, d):
    return profiling.nearest_rank(_t(spark, d, "lineitem"), "l_extendedprice", [0.5, 0.9, 0.95, 0.99])


@_query
def sample_head_mid_tail(spark, d):
    return profiling.head_middle_tail(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "part")


@_query
def stratified_sample(spark, d):
    return profiling.stratified_sample(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 5)


@_query
def cell_score(spark, d):
    a = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    b = a.where("l_orderkey % 11 <> 0").withColumn("q", F.when(F.col("l_orderkey") % 13 == 0, F.col("q") + 1).otherwise(F.col("q")))
    b = b.unionByName(a.where("l_orderkey % 17 = 0").withColumn("l_orderkey", -F.col("l_orderkey") - 1))
    return profiling.cell_score(a, b, ["l_orderkey", "l_linenumber"], "q")


# --- history and catalog ----------------------------------------------------------------------------


@_query
def latest_run_per_user(spark, d):
    return history.latest_by(_t(spark, d, "events"), ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@_query
def latest_status_pivot(spark, d):
    status = F.when(F.col("value") < 20, "failed").when(F.col("value") < 60, "partial").otherwise("done")
    runs = _t(spark, d, "events").withColumn("status", status)
    latest = history.latest_by(runs, ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.desc("event_id")])
    return history.status_ladder(latest, "user_id", "event_type", "status", ["view", "click", "purchase", "signup", "error"])


@_query
def recent_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return _t(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))


@_query
def incremental_classify(spark, d):
    docs = _t(spark, d, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("size"))
    before = docs.where("doc_id % 7 <> 0").withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return history.classify_changes(before, docs.where("doc_id % 11 <> 0"), "doc_id", ["size"])


@_query
def missing_customers(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@_query
def existing_keys(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem").where("l_quantity >= 49")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & ((F.col("l_returnflag") == "R") | (F.col("l_shipdate") > F.col("o_orderdate"))), "left_semi").select("o_orderkey", "o_orderstatus")


def _catalog(spark, d):
    f = frames(spark, d)
    assets = registry.current_assets(f["tables"], f["texts"], f["files"])
    return f, assets, registry.view(assets, f["cleaning"], f["profiles"], f["issues"], f["semantic"], chunking.chunks(f["texts"], "asset_id"))


@_query
def catalog_view(spark, d):
    return _catalog(spark, d)[2]


@_query
def catalog_summary(spark, d):
    f, _, catalog = _catalog(spark, d)
    return registry.summary(catalog, f["files"], f["issues"])


@_query
def catalog_page(spark, d):
    page = registry.list_assets(_catalog(spark, d)[2], quality="ready", words="SUPPLIER", limit=100, offset=5)
    return page.select("source_file", "asset_type", "asset_id", "display_name", "total", "has_next")


@_query
def catalog_empty_page(spark, d):
    return registry.list_assets(_catalog(spark, d)[2], words="a_b%c", limit=10, offset=10**6).select("asset_id", "total", "has_next")


@_query
def file_rollup(spark, d):
    f, assets, _ = _catalog(spark, d)
    return registry.file_rollup(f["files"], assets, f["cleaning"], f["issues"], f["semantic"], f["runs"])


@_query
def files_page(spark, d):
    page = registry.list_files(file_rollup(spark, d), category="document", words="dir_/", limit=30, offset=2)
    return page.select("file_id", "relative_path", "processing_status", "quality_status", "total", "has_next")


@_query
def processing_counts(spark, d):
    f = frames(spark, d, "files", "runs")
    return registry.processing_counts(f["files"], f["runs"])


@_query
def issue_page(spark, d):
    f, _, catalog = _catalog(spark, d)
    page = registry.list_issues(f["issues"], catalog, status="open", limit=60, offset=3)
    return page.select("issue_id", "asset_id", "issue_type", "created", "display_name", "total")


@_query
def values_left_join_counts(spark, d):
    """Visible issues of the assets on a page, given as literals."""
    wanted = [("t2", "r101"), ("t4", None), ("x7", "r8"), ("x9", None), ("nothing", None)]
    return registry.issue_counts_for(wanted, frames(spark, d, "issues")["issues"])


@_query
def correlated_chunk_count(spark, d):
    """Texts and how many chunks each has, those without included."""
    docs = _t(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 5 > 0, F.col("text")))
    n = chunking.chunks(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@_query
def asset_details(spark, d):
    f, _, catalog = _catalog(spark, d)
    out = registry.asset_detail("t2", catalog, f["issues"], f["semantic"])
    return out.select("asset_id", "display_name", "quality", F.array_join(F.transform("open_issues", lambda i: F.concat_ws(":", i["issue_type"], i["status"])), ",").alias("open_issues"), F.array_join("semantic_runs", ",").alias("semantic_runs"))


@_query
def issue_updates(spark, d):
    """Issues after status events; states that are no states are ignored."""
    issues = frames(spark, d, "issues")["issues"]
    events = _t(spark, d, "events").where("event_id % 9 = 0").select(F.concat(F.lit("i"), (F.col("event_id") % 4000).cast("string")).alias("issue_id"), F.when(F.col("event_id") % 2 == 0, "resolved").when(F.col("event_id") % 5 == 0, "unheard").otherwise("accepted").alias("status"), F.col("event_id").alias("at"))
    return registry.set_issue_status(events, issues).groupBy("issue_type", "status").agg(F.count("*").alias("n"))


@_query
def issue_upserts(spark, d):
    before = frames(spark, d, "issues")["issues"]
    found = before.where("substr(issue_id, 2) % 6 = 0").withColumn("status", F.lit("resolved")).unionByName(before.where("substr(issue_id, 2) % 50 = 0").withColumn("issue_id", F.concat(F.lit("n"), "issue_id")))
    return registry.merged_issues(before, found).groupBy("status").agg(F.count("*").alias("n"))


@_query
def file_upserts(spark, d):
    """Contents known before and a new batch: the first time seen stays, the newest values win."""
    e = _t(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("size"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    new = e.where("event_id % 2 = 1 and user_id % 3 > 0").groupBy("user_id").agg(F.min("value").alias("size"), F.max("ts").alias("at"))
    return history.upserted(old, new, "user_id", "at")


@_query
def missing_paths(spark, d):
    files = frames(spark, d, "files")["files"].select(F.col("relative_path").alias("path"), "state")
    seen = files.where("path like '%.csv' or path like '%.pdf'")
    return history.missing_paths(files, seen, spark.createDataFrame([("dir3",), ("dir",)], "folder string")).select("path")


@_query
def runs_to_do(spark, d):
    """Files whose content has no finished run of the plain-text route yet."""
    f = frames(spark, d, "files", "runs")
    files = f["files"].select("file_id", F.col("sha256").alias("content")).where("content is not null")
    return history.to_do(files, f["runs"].where("route = 'text_plain'"), ["file_id", "content"])


@_query
def reusable_runs(spark, d):
    """The newest finished run on each file's content."""
    f = frames(spark, d, "files", "runs")
    files = f["files"].select("file_id", F.col("sha256").alias("content"), "source_root")
    return history.reusable(files, f["runs"], ["file_id", "content"], registry.newest_first()).select("file_id", "run_id", "route", "status")


@_query
def interrupted_runs(spark, d):
    return history.reconciled(frames(spark, d, "runs")["runs"]).groupBy("route", "status").agg(F.count("*").alias("n"))


@_query
def root_snapshot(spark, d):
    """Known files of one root, and its sums of rows and characters."""
    f = frames(spark, d, "files", "tables", "texts")
    assets = registry.current_assets(f["tables"], f["texts"], f["files"]).where("source_root = 'root1'")
    return assets.groupBy("source_file").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def _records(spark, d):
    e = _t(spark, d, "events")
    state = F.when(F.col("value") < 10, "queued").when(F.col("value") < 25, "running").when(F.col("value") < 70, "completed").when(F.col("value") < 90, "failed").otherwise("cancelled")
    phase = F.when(F.col("event_id") % 3 == 0, "calling").when(F.col("event_id") % 3 == 1, "preparing")
    return e.select((F.col("user_id") % 120).cast("string").alias("file_id"), state.alias("state"), F.when(state == "running", phase).alias("phase"), F.col("event_id").alias("at"), F.concat(F.lit("c"), F.when(F.col("event_id") % 4 == 0, "0").otherwise((F.col("user_id") % 120).cast("string"))).alias("content"))


@_query
def insight_statuses(spark, d):
    files = frames(spark, d, "files")["files"].select("file_id", F.when(F.col("source_format") == "png", "no_evidence").otherwise("available").alias("evidence_status"))
    return registry.insight_status(files, _records(spark, d))


@_query
def insight_queue(spark, d):
    return registry.queue_counts(_records(spark, d))


@_query
def stale_insights(spark, d):
    return registry.stale_records(_records(spark, d), frames(spark, d, "files")["files"]).groupBy("state").agg(F.count("*").alias("n"))


@_query
def duplicate_contents(spark, d):
    groups = _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return groups.where("copies > 1")


@_query
def format_counts(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    top = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return _t(spark, d, "pages").groupBy(top.alias("format")).agg(F.count("*").alias("n"), F.count_distinct(host).alias("hosts"))


@_query
def page_types(spark, d):
    from sievework.sources.files import detected_type

    kind = detected_type(F.col("url"), F.col("html").cast("binary"))
    return _t(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@_query
def benchmark_mentions(spark, d):
    """Documents that hold the words of an item: whole short items, or any eight neighbouring words of longer ones.

    The items' word sequences are few and broadcast if they are; the documents' rows never meet in a shuffle then.
    """
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")
    items = _t(spark, d, "benchmark").select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(8), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    grams = items.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("g")).distinct()
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    docs = _t(spark, d, "documents").select("doc_id", words("text").alias("w"))
    of = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", F.explode(F.concat(*[of(n) for n in sizes])).alias("g")) if sizes else docs.select("doc_id", F.lit("").alias("g"))
    few = grams.count() <= 200_000
    side = grams.select("g", "item_id")
    return found.join(F.broadcast(side) if few else side, "g").select("doc_id", "item_id").distinct()


# --- SQL, evidence, layout --------------------------------------------------------------------------


@_query
def safe_sql_join(spark, d):
    sql = "WITH big AS (SELECT * FROM t1 WHERE o_totalprice > 1000) SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM big JOIN t2 ON o_orderkey = l_orderkey GROUP BY o_orderstatus"
    return safe_sql.query({"t1": _t(spark, d, "orders"), "t2": _t(spark, d, "lineitem")}, sql)


@_query
def safe_sql_setop(spark, d):
    sql = "SELECT c_nationkey AS k FROM t1 EXCEPT SELECT s_nationkey FROM t2 WHERE s_acctbal < 0;"
    return safe_sql.query({"t1": _t(spark, d, "customer"), "t2": _t(spark, d, "supplier")}, sql)


@_query
def safe_sql_rejections(spark, d):
    bad = ["", "DROP TABLE t1", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM range(5)", "SELECT reflect('java.lang.System', 'exit') FROM t1", "SELECT (SELECT max(x) FROM hidden) FROM t1", "INSERT INTO t1 SELECT 1"]
    rows = []
    for i, sql in enumerate(bad):
        try:
            safe_sql.validate(spark, sql, {"t1"})
            rows.append((i, "accepted"))
        except safe_sql.SqlRefused as e:
            rows.append((i, e.code))
    return spark.createDataFrame(rows, "statement bigint, code string")


@_query
def budgeted_context(spark, d):
    out = evidence.within_budget(_t(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size")), "source", "doc_id", "size", 12000)
    return out.select("source", "doc_id", "used")


@_query
def grounding_check(spark, d):
    """A finding (an order) is grounded if all the parts that it cites are known."""
    cited = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    known = _t(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    return cited.join(known, "l_partkey", "left").groupBy("l_orderkey").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("grounded"))


def _boxes(spark, d):
    e = _t(spark, d, "events")
    x0, y0 = (F.col("event_id") * 7 % 97).cast("double"), (F.col("event_id") * 13 % 89).cast("double")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 10).alias("y1"))


@_query
def reading_order(spark, d):
    return layout.reading_order(_boxes(spark, d), "page", "seq").select("page", "seq", "place")


@_query
def overlap_suppress(spark, d):
    b = _boxes(spark, d)
    return layout.outside_tables(b.where("seq % 10 <> 0"), b.where("seq % 10 = 0"), "page").select("page", "seq")


@_query
def iou_pairs(spark, d):
    return layout.overlapping_pairs(_boxes(spark, d), "page", "seq", 0.5)


@_query
def row_bands(spark, d):
    cells = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("sheet"), (F.col("l_orderkey") % 97).cast("bigint").alias("row"), F.when(F.col("l_orderkey") % 97 % 6 != 0, F.col("l_returnflag")).alias("value"))
    return layout.row_bands(cells, "sheet", "row", "value")


@_query
def table_regions(spark, d):
    """Cells of sheets (one a supplier) with blank rows and columns between."""
    li = _t(spark, d, "lineitem")
    row, col = F.col("l_orderkey") % 29, F.col("l_partkey") % 11
    there = (row % 6 != 5) & (col % 4 != 3) & ((row % 6 != 0) | (F.col("l_suppkey") % 3 > 0) | (col % 4 == 0))
    cells = li.where(there).groupBy(F.col("l_suppkey").alias("sheet"), row.alias("row"), col.alias("col")).agg(F.max("l_returnflag").alias("value"))
    kind = F.when((F.col("row") % 6 < 2) | (F.col("sheet") % 4 == 0), "string").otherwise("number")
    found = layout.regions(cells.withColumn("kind", kind), "sheet")
    return found.withColumn("warnings", F.array_join("warnings", ","))


@_query
def spatial_lines(spark, d):
    return layout.join_lines(_boxes(spark, d).select("page", "seq", "x0", "y0", "x1", "y1", F.col("seq").cast("string").alias("text")), "page", "seq")


def _page_blocks(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "image").when(F.col("event_id") % 5 == 0, "drawing").otherwise("text")
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("doc"), (F.col("event_id") % 7).alias("page"), kind.alias("kind"), (F.col("event_id") % 11).alias("chars"), (F.col("event_id") % 11 % 6).alias("effective"), F.col("value").alias("area"), F.lit(400.0).alias("page_area"), (F.col("event_id") % 4).cast("double").alias("width"), (F.col("event_id") % 9).cast("double").alias("height"))


@_query
def page_profiles(spark, d):
    return layout.page_profile(_page_blocks(spark, d), ["doc", "page"])


@_query
def page_table_hints(spark, d):
    e = _t(spark, d, "events")
    blocks = e.select(F.col("user_id").alias("doc"), (F.col("event_id") % 2).alias("page"), "event_id", (F.col("event_id") * 7 % 5 * 60).cast("double").alias("x0"), (F.col("event_id") * 13 % 31 * 6).cast("double").alias("y0"), (F.col("event_id") % 53).alias("effective"))
    return layout.table_hints(blocks, ["doc", "page"], "event_id")


def _hinted(spark, d):
    pages = page_profiles(spark, d).withColumn("table_hint", F.col("grid_lines") >= layout.GRID_LINES)
    return pages, layout.document_class(pages, "doc")


@_query
def document_classes(spark, d):
    return _hinted(spark, d)[1]


@_query
def table_pages(spark, d):
    return layout.table_pages(*_hinted(spark, d), "doc").select("doc", "page", "class")


@_query
def ocr_pages(spark, d):
    return layout.ocr_pages(*_hinted(spark, d), "doc").select("doc", "page", "reason")


@_query
def vision_pages(spark, d):
    return layout.vision_pages(page_profiles(spark, d)).select("doc", "page")


@_query
def layout_hints(spark, d):
    return page_profiles(spark, d).select("doc", "page", layout.layout_hint(F.col("grid_lines") % 2, F.col("effective") * 10).alias("hint"))


def _read_cells(spark, d):
    """Cells of recognised tables (one an order): rows of differing width, long and empty cells, sizes."""
    li = _t(spark, d, "lineitem")
    k = F.col("l_orderkey")
    value = F.when(k % 4 == 0, F.repeat(F.lit("x"), 170)).when(F.col("l_quantity") > 30, " ").otherwise(F.col("l_returnflag"))
    return li.select(k.alias("table_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("row"), value.alias("value"), F.col("l_quantity").alias("width"), (F.col("l_tax") * 100 + 1).alias("height"))


@_query
def image_table_flags(spark, d):
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    blocks = _t(spark, d, "lineitem").where("l_orderkey % 9 > 0").select(F.col("l_orderkey").alias("table_id"), F.round(F.col("l_discount") * 10, 1).alias("confidence"), place)
    return layout.table_flags(_read_cells(spark, d), ["table_id"], blocks).select("table_id", F.array_join("flags", ",").alias("flags"))


@_query
def native_table_flags(spark, d):
    return layout.native_table_flags(_read_cells(spark, d), ["table_id"]).select("table_id", F.array_join("flags", ",").alias("flags"))


@_query
def scaled_boxes(spark, d):
    box = layout.scaled([F.col(c) for c in ("x0", "y0", "x1", "y1")], (F.when(F.col("seq") % 5 > 0, 200.0), F.lit(100.0)), (F.lit(50.0), F.lit(25.0)), F.col("seq") % 4 * 90)
    return _boxes(spark, d).select("seq", box.alias("b")).select("seq", "b.*")


@_query
def read_table_warnings(spark, d):
    """Tables of a reading model: names, and how many rows came with them."""
    names = F.array("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise("x"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(" ")).otherwise("y"))
    warned = layout.vision_warnings(names, F.col("n_regionkey"))
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(warned, ",").alias("warnings"))


# --- scores and samples -----------------------------------------------------------------------------


def _scored(spark, d):
    """Tables of orders on pages of customers; the found ones lack some and have other sizes and cells."""
    o = _t(spark, d, "orders")
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("value"))
    rows = li.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("bigint").alias("rows"))
    both = o.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page"), "rows", F.lit(1).cast("bigint").alias("columns"))
    order = Window.partitionBy("page").orderBy("id")
    expected = both.withColumn("idx", F.row_number().over(order).cast("bigint"))
    found = expected.where("id % 7 > 0").withColumn("rows", F.when(F.col("id") % 5 == 0, F.col("rows") + 1).otherwise(F.col("rows"))).withColumn("idx", F.row_number().over(order).cast("bigint"))
    cells = li.join(expected.select(F.col("id").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("col"), "value")
    other = cells.where("id % 7 > 0").withColumn("value", F.when(F.col("id") % 3 == 0, F.concat(F.col("value"), F.lit(" "))).when(F.col("id") % 11 == 0, F.lit("?")).otherwise(F.col("value")))
    return expected, found, cells, other


@_query
def table_scores(spark, d):
    """Expected tables with an index match the candidate of that index; others take the first free one of their page."""
    expected, found, cells, other = _scored(spark, d)
    expected = expected.withColumn("idx", F.when(F.col("page") % 2 == 0, F.col("idx")))
    return profiling.table_scores(expected, found, cells, other)


@_query
def cell_overlaps(spark, d):
    _, _, cells, other = _scored(spark, d)
    return profiling.cell_overlap(cells, other, ["id"])


@_query
def half_sample(spark, d):
    rows = _t(spark, d, "labels").select("doc_id", "quality")
    return profiling.halves(rows, F.col("quality") == 1, [F.col("doc_id")], 20)


@_query
def rates(spark, d):
    g = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("files"), F.sum(F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))).alias("bytes"), F.when(F.col("user_id") % 4 == 0, 0.0).otherwise(F.round(F.avg("value"), 3)).alias("seconds"))
    return g.select("user_id", F.round(profiling.throughput(g, "files", "seconds"), 6).alias("files_s"), F.round(profiling.throughput(g, "bytes", "seconds"), 6).alias("bytes_s"))


@_query
def corpus_distribution(spark, d):
    """Classes of documents with the sum, least and most of their pages, and the sorted sizes."""
    classes = _hinted(spark, d)[1]
    out = classes.groupBy("class").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.min("pages").alias("least"), F.max("pages").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_list("pages")), lambda p: p.cast("string")), ",").alias("sizes"))
    return out


@_query
def run_rollup(spark, d):
    """The newest run of each file and route, summed up by route: time, first start, last finish."""
    runs = frames(spark, d, "runs")["runs"]
    last = history.latest_by(runs, ["file_id", "route"], registry.newest_first())
    return last.groupBy("route").agg(F.count("*").alias("files"), F.min("started").alias("first_start"), F.max("finished").alias("last_finish"), F.count_if(F.col("status") == "failed").alias("failed"))


@_query
def first_reuse(spark, d):
    """Of each user's runs the first after the initial one that used something again, else the initial one."""
    e = _t(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    pick = F.when((F.col("n") > 1) & (F.col("event_type") == "error"), 0).when(F.col("n") == 1, 1)
    return history.latest_by(e.where(pick.isNotNull()), ["user_id"], [pick.asc(), F.asc("n")]).select("user_id", "event_id")


@_query
def current_runs(spark, d):
    runs = _t(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 4).alias("content"), (F.col("event_type") != "error").alias("ok"))
    return history.current_flags(runs, ["user_id"], "content", "ok", [F.desc("ts"), F.desc("event_id")]).where("is_current").select("user_id", "event_id")


@_query
def first_last_seen(spark, d):
    return history.first_last_seen(_t(spark, d, "events").select("user_id", "ts", "event_type"), "user_id", "ts", "event_type")


@_query
def issue_dedupe(spark, d):
    """The newest row of each user and type; routing hints (views) stay hidden."""
    rows = _t(spark, d, "events").where("event_type <> 'view'")
    return history.latest_by(rows, ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.asc("event_id")]).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


@_query
def context_in_budget(spark, d):
    rows = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "role", "text")
    out = evidence.context_blocks(rows, "conv_id", ["turn"], "text", 300)
    return out.select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("chars"))


@_query
def report_facts(spark, d):
    profile = profiling.column_profile(_t(spark, d, "part"), ["p_brand", "p_size", "p_retailprice"])
    return evidence.table_facts(profile, "part")


@_query
def shared_columns(spark, d):
    names = [(t, c) for t in ("documents", "labels", "pages", "benchmark", "conversations") for c in _t(spark, d, t).columns]
    return evidence.shared_columns(spark.createDataFrame(names, "table_name string, column_name string"))


@_query
def block_offsets(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return documents.with_offsets(rows, "conv_id", "turn", gap=2).select("conv_id", "turn", "start", "end")


@_query
def text_windows(spark, d):
    out = documents.text_window(_t(spark, d, "documents"), "text", 100, 500)
    return out.select("doc_id", F.sha2("window", 256).alias("window_sha256"), "has_next")


@_query
def budgeted_rows(spark, d):
    return sinks.bounded_json(_t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 400)


@_query
def finding_grounds(spark, d):
    found = _t(spark, d, "orders").select(F.col("o_orderkey").alias("finding"), F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("o_orderstatus")))).alias("evidence"), F.when(F.col("o_orderkey") % 7 == 0, "unconfirmed").alias("status"))
    known = _t(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")).union(spark.createDataFrame([("sF",), ("sO",)], "id string"))
    return evidence.ground_findings(found, known)


@_query
def text_excerpts(spark, d):
    """Long texts as three windows of bytes, as a model sees them."""
    return _t(spark, d, "documents").select("doc_id", F.sha2(documents.excerpt(F.col("text"), 900), 256).alias("sha256"))


@_query
def safe_paths(spark, d):
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("/abs/"), "s_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("C:\\x\\"), "s_name")).otherwise(F.concat(F.lit(" dir\\"), "s_name"))
    return _t(spark, d, "supplier").select("s_suppkey", evidence.safe_path(raw).alias("path"))


@_query
def safe_metadata(spark, d):
    """Metadata without the keys of secrets and places."""
    m = F.create_map(*[x for k in ("API-Key", "k", "workspaceRoot", "token_count", "pathology", "Path") for x in (F.lit(k), F.col("n_name"))])
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(F.array_sort(F.map_keys(evidence.without_secrets(m))), ",").alias("keys"))


@_query
def evidence_snapshot(spark, d):
    """Evidence that findings cite first, then the rest, each once, 128 at most."""
    o = _t(spark, d, "orders").where("o_custkey < 40")
    findings = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("place"), F.array(F.concat(F.lit("e"), (F.col("o_orderkey") % 90).cast("string")), F.lit("unknown")).alias("evidence_ids"))
    manifest = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("place"), F.concat(F.lit("e"), (F.col("o_orderkey") % 300).cast("string")).alias("evidence_id"), F.col("o_orderstatus").alias("value"))
    return evidence.snapshot(findings, manifest)


@_query
def citations_outside(spark, d):
    """Citations that are not among the allowed ones."""
    e = _t(spark, d, "events")
    cited = e.select(F.concat(F.lit("t"), (F.col("event_id") % 300).cast("string")).alias("asset_id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 4).alias("page_number"), F.when(F.col("event_id") % 2 == 0, "").alias("sheet_name")).distinct()
    allowed = _t(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("asset_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 4).alias("page_number"), F.lit(None).cast("string").alias("sheet_name"))
    return evidence.checked_citations(cited, allowed).select("asset_id", "page_number", F.coalesce("sheet_name", F.lit("-")).alias("sheet"))


@_query
def insight_contexts(spark, d):
    f = frames(spark, d, "tables", "texts")
    texts = f["texts"].select("file_id", F.concat(F.lit("0"), "asset_id").alias("place"), "text")
    tables_ = f["tables"].select("file_id", F.concat(F.lit("1"), "asset_id").alias("place"), F.concat(F.lit("rows "), F.col("rows").cast("string")).alias("text"), rules.candidate(F.col("source_kind"), F.col("extractor")).alias("candidate"))
    out = evidence.insight_context(texts, tables_, 6000)
    return out.select("file_id", "place", F.sha2("text", 256).alias("sha256"))


@_query
def files_selected(spark, d):
    f = frames(spark, d, "files")["files"]
    every = evidence.selected_files(f, condition=F.col("source_format") != "png").select("file_id", F.lit("all").alias("how"))
    return every.unionByName(evidence.selected_files(f, ids=["3", "17", "5", "3", "none"]).select("file_id", F.lit("ids").alias("how")))


@_query
def evidence_collected(spark, d):
    f = frames(spark, d, "tables", "texts")
    insights = _t(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").cast("string").alias("file_id"), F.col("s_name").alias("text"))
    texts = f["texts"].where("page_number is null").select("file_id", "asset_id", F.sha2("text", 256).alias("text"))
    tables_ = f["tables"].select("file_id", "asset_id", F.col("quality").alias("text"), (~rules.candidate(F.col("source_kind"), F.col("extractor"))).alias("trusted"))
    return evidence.collected_evidence(insights, texts, tables_)


@_query
def read_page_texts(spark, d):
    """Pages put together from recognised blocks, in reading order."""
    from sievework.operators import semantic

    b = _boxes(spark, d)
    blocks = b.select(F.lit("f").alias("path"), "page", F.col("seq").alias("block"), F.col("seq").cast("string").alias("text"), "x0", "y0", "x1", "y1", F.when(F.col("seq") % 3 > 0, F.col("x0") / 100).alias("confidence"), F.when(F.col("seq") % 7 > 0, "ok").otherwise("failed").alias("status"))
    return semantic.page_texts(blocks).select("page", F.sha2("text", 256).alias("sha256"), "confidence", "chars", "quality")


@_query
def processing_policies(spark, d):
    from sievework.sources import files

    kinds = ("pdf", "jpeg", "png", "xlsx", "docx", "pptx", "zip", "ole_compound", "delimited_text", "plain_text", "html", "unknown", "odd")
    ends = (".pdf", ".xlsx", ".docx", ".csv", ".tsv", ".xls", ".doc", ".txt", ".md", ".bin")
    rows = spark.createDataFrame([(k, e) for k in kinds for e in ends], "detected string, ext string")
    return rows.withColumn("p", files.policy(F.col("detected"), F.col("ext"))).select("detected", "ext", "p.support", "p.source_format", "p.reason", F.concat_ws("", *[F.when(F.col(f"p.{c}"), "x").otherwise("-") for c in ("attempt_table", "attempt_text", "may_ocr", "may_vision")]).alias("tried"))


@_query
def content_health(spark, d):
    from sievework.sources import files

    dirt = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("\x01"), 40)).when(F.col("doc_id") % 3 == 1, F.lit("\ufffd\u200b\t")).otherwise("")
    cells = _t(spark, d, "documents").select(F.col("lang").alias("sheet"), (F.col("doc_id") % 50).alias("part"), F.concat(dirt, F.substring("text", 1, 300)).alias("value"))
    return files.content_health(cells, ["sheet", "part"])


@_query
def files_excluded(spark, d):
    from sievework.sources import files

    rows = frames(spark, d, "files")["files"]
    return rows.where(~files.excluded(F.col("relative_path"), ["dir[12]/*", "*.p?g", ""])).select("file_id")


@_query
def files_without_packages(spark, d):
    """Paths below an unpacked office package are left out."""
    from sievework.sources import files

    rows = _t(spark, d, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 3).cast("string"), F.when(F.col("s_suppkey") % 5 == 0, "/[Content_Types].xml").when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit("/xl/"), "s_name")).otherwise(F.concat(F.lit("x/"), "s_name"))).alias("path")).distinct()
    return files.without_packages(rows.where("path not like 'd1/xl/%'"))


@_query
def newest_records(spark, d):
    return evidence.newest(_t(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@_query
def stable_ids(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", sinks.stable_id("tbl_", "n_regionkey", "n_name").alias("id"))


@_query
def sheet_orders(spark, d):
    p = _t(spark, d, "part")
    rows = p.select((F.col("p_partkey") % 50).alias("file"), F.when(F.col("p_size") % 6 > 0, F.col("p_size") % 3).alias("sheet_index"), (F.col("p_size") % 4).alias("row_start"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 2).alias("column_start"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"))
    return layout.sheet_order(rows, "file").select("file", "id", "place")


@_query
def document_orders(spark, d):
    e = _t(spark, d, "events").select("user_id", F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 20).alias("document_order"), F.when(F.col("event_type") == "view", "table").otherwise("text").alias("kind"), F.col("event_id").alias("id"))
    return layout.document_order(e, "user_id").select("user_id", "id", "place")


@_query
def processing_counts_fallback(spark, d):
    f = frames(spark, d, "files", "runs")
    return registry.processing_counts(f["files"], f["runs"], prefer_vision=True)


@_query
def insight_preview(spark, d):
    return registry.insight_preview(file_rollup(spark, d), _records(spark, d))


@_query
def file_details(spark, d):
    f = frames(spark, d, "tables", "texts")
    out = registry.file_detail("3", file_rollup(spark, d), f["texts"], f["tables"])
    return out.select("file_id", "processing_status", "kind", "asset_id", "page_number", F.sha2("text", 256).alias("text_sha256"))


@_query
def reprocess_checks(spark, d):
    f = frames(spark, d, "files")["files"]
    path = F.when(F.col("file_id").endswith("7"), F.concat(F.lit("../"), "relative_path")).otherwise(F.col("relative_path"))
    now = F.when(F.col("file_id").endswith("4"), "other").otherwise(F.col("sha256"))
    return f.select("file_id", registry.reprocess_refusal(F.col("state"), path, F.col("sha256"), now).alias("refusal"))


@_query
def search_counts(spark, d):
    f = frames(spark, d, "files", "tables", "texts")
    return registry.counts(registry.current_assets(f["tables"], f["texts"], f["files"]), chunking.chunks(f["texts"], "asset_id"))


@_query
def asset_selection(spark, d):
    """Tables for a statement: in the order of the request, refused if one is unknown or unconfirmed."""
    t = frames(spark, d, "tables")["tables"]
    status = F.when(F.col("quality") == "pass", "ready").when(F.col("quality") == "fail", "unusable").otherwise("needs_review")
    assets = t.select("asset_id", rules.trust(status, rules.candidate(F.col("source_kind"), F.col("extractor"))).alias("trust"))
    good = [r.asset_id for r in assets.where("trust = 'confirmed'").orderBy(F.desc("asset_id")).limit(3).collect()]
    out = []
    for ids in (good, good[:1] * 2, ["t0"], ["none"], [], ["x" * 161], [f"t{i}" for i in range(9)]):
        try:
            out.append(",".join(r.asset_id for r in safe_sql.selected(ids, assets)))
        except safe_sql.SqlRefused as e:
            out.append(e.code)
    return spark.createDataFrame(list(enumerate(out)), "request bigint, answer string")


@_query
def page_consistency(spark, d):
    expected, found, _, _ = _scored(spark, d)
    cols = lambda t: t.select("page", F.col("idx").alias("ordinal"), "rows", "columns")
    return profiling.page_consistency(cols(expected), cols(found))


@_query
def task_progress(spark, d):
    from sievework.streaming import ingest

    return _t(spark, d, "nation").select("n_nationkey", F.round(ingest.progress(F.col("n_nationkey"), F.col("n_regionkey") * 5), 6).alias("progress"))


@_query
def layout_upgrade(spark, d):
    """Rows of an older layout with the columns that came later."""
    return sinks.upgraded(_t(spark, d, "region"), 1, {"r_source": (2, "string", "native"), "r_rank": (3, "bigint", 0), "r_name": (2, "string", "x")}, 3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality_by_lang(spark, sf_dir)
