"""DuckDB statements for the rows of the registered queries."""

from sievework.plans.fixture import statements

DIRTY = r"(' ' || chr(7) || replace(replace(text, 'é', 'e' || chr(769)), chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) || chr(11) || chr(13) || chr(10))"
STEP_A = f"replace(replace(nfc_normalize({DIRTY}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
STEP_B = f"regexp_replace(regexp_replace({STEP_A}, '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+\\z', '', 'g')"
STEP_C = f"regexp_replace({STEP_B}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
STEP_D = f"regexp_replace({STEP_C}, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"
STRIP_D = f"regexp_replace(regexp_replace({STEP_D}, '^\\s+', ''), '\\s+\\z', '')"
STATUS = "case when length({0}) = 0 then 'unusable' when length({0}) < 20 then 'needs_review' else 'ready' end"



def chunks_of(table: str, key: str, before: str = "") -> str:
    """Statements that end with ``chunks``: windows of 2,000 characters, cut after the last newline of their second half."""
    cut = "{0} + 2000 - instr(reverse(text[{0}+1001:{0}+2000]), chr(10)) + 1"
    end = lambda at: f"CASE WHEN {at} + 2000 < length(text) AND instr(reverse(text[{at}+1001:{at}+2000]), chr(10)) > 0 THEN {cut.format(at)} ELSE least({at} + 2000, length(text)) END"
    return f"""{before or "WITH RECURSIVE "} c({key}, text, chunk, s, e) AS (
      SELECT {key}, text, 0, 0, {end("0")} FROM {table} WHERE length(text) > 0
      UNION ALL SELECT {key}, text, chunk + 1, e, {end("e")} FROM c WHERE e < length(text)),
    chunks AS (SELECT {key}, chunk::BIGINT AS chunk, s::BIGINT AS start, e::BIGINT AS "end", text[s+1:e] AS chunk_text FROM c)
    """


CHUNKS = chunks_of("documents", "doc_id")
#: Newest row of each key, as a condition.
NEWEST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY finished DESC NULLS LAST, started DESC, run_id DESC) = 1"
SEEN = "seen AS (SELECT * FROM issues WHERE issue_type <> 'possible_table_candidate' QUALIFY row_number() OVER (PARTITION BY asset_id, issue_type ORDER BY created DESC NULLS LAST, issue_id) = 1)"
IS_CANDIDATE = "(coalesce(source_kind, '') IN ('page', 'image') OR extractor = 'img2table')"


def registry(*more: str, names: tuple[str, ...] = ()) -> str:
    """The fixture with current assets, latest cleaning and visible issues, and further statements."""
    parts = [
        f"""ta AS (SELECT t.*, f.source_root, f.relative_path AS source_file, f.source_format, f.filename,
          row_number() OVER (PARTITION BY t.file_id, t.page_number ORDER BY asset_id) AS on_page, row_number() OVER (PARTITION BY t.file_id ORDER BY asset_id) AS on_file
          FROM tables t JOIN files f USING (file_id) WHERE is_current AND state = 'present')""",
        f"""assets AS (
          SELECT 'table' AS asset_type, asset_id, file_id, source_root, source_file, source_format, content, extractor, source_kind, sheet_name, page_number,
            filename || CASE WHEN sheet_name IS NOT NULL THEN ' / ' || sheet_name WHEN page_number IS NOT NULL THEN ' / Page ' || page_number || ' / Table ' || on_page WHEN source_kind = 'image' THEN ' / Table ' || on_file ELSE '' END AS fallback_name,
            "rows", "columns", NULL::BIGINT AS chars,
            CASE WHEN source_format = 'pdf' OR {IS_CANDIDATE} THEN 'needs_review' ELSE CASE quality WHEN 'pass' THEN 'ready' WHEN 'fail' THEN 'unusable' ELSE 'needs_review' END END AS base_quality FROM ta
          UNION ALL
          SELECT 'text', t.asset_id, file_id, f.source_root, f.relative_path, f.source_format, t.content, t.extractor, t.source_kind, t.sheet_name, t.page_number,
            f.filename || coalesce(' / Page ' || t.page_number, ''), NULL, NULL, length(text), CASE WHEN trim(text) = '' THEN 'unusable' WHEN contains(extractor, 'ocr') THEN 'needs_review' ELSE 'ready' END
          FROM texts t JOIN files f USING (file_id) WHERE t.is_current AND f.state = 'present')""",
        f"lc AS (SELECT * FROM cleaning {NEWEST.format('asset_id, content')})",
        SEEN,
        "sem AS (SELECT * FROM semantic WHERE current QUALIFY row_number() OVER (PARTITION BY asset_id, asset_type ORDER BY generated DESC, run_id DESC NULLS LAST) = 1)",
    ]
    return statements(*names).replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ", ".join([*parts, *more]) + " "


VIEW = (
    chunks_of("texts", "asset_id", before=", ").strip().lstrip(",").strip(),
    """catalog AS (SELECT a.asset_id, a.asset_type, a.file_id, a.source_root, a.source_file, a.source_format, a.content, a.extractor, a.source_kind, a.sheet_name, a.page_number, a.fallback_name,
      s.display_name AS semantic_name, coalesce(s.display_name, a.fallback_name) AS display_name, s.category, coalesce(p."rows", a."rows") AS "rows", coalesce(p."columns", a."columns") AS "columns",
      CASE a.asset_type WHEN 'text' THEN coalesce(p.chars, a.chars) END AS chars,
      CASE a.asset_type WHEN 'text' THEN coalesce(p.chunks, (SELECT count(*) FROM chunks k WHERE k.asset_id = a.asset_id)) END AS chunks,
      coalesce(lc.quality, a.base_quality) AS quality,
      (SELECT count(*) FROM issues i WHERE i.asset_id = a.asset_id AND i.issue_type <> 'possible_table_candidate' AND i.status IN ('open', 'accepted') AND (i.run_id IS NULL OR i.run_id IN (SELECT run_id FROM lc))) AS issues,
      CASE WHEN s.asset_id IS NULL THEN 'pending' ELSE 'enriched' END AS semantic_status, coalesce(lc.status, 'not_run') AS cleaning_status, lc.run_id AS cleaning_run
      FROM assets a LEFT JOIN lc ON lc.asset_id = a.asset_id AND lc.content = a.content LEFT JOIN profiles p ON p.run_id = lc.run_id AND p.asset_id = a.asset_id
      LEFT JOIN sem s ON s.asset_id = a.asset_id AND s.asset_type = a.asset_type)""",
)
ROLLUP = (
    """per_asset AS (SELECT a.*, coalesce(lc.quality, base_quality) AS q,
      (SELECT count(*) FROM seen i WHERE i.asset_id = a.asset_id AND i.status IN ('open', 'accepted') AND (i.run_id IS NULL OR i.run_id IN (SELECT run_id FROM lc))) AS n_issues,
      EXISTS (SELECT 1 FROM sem s WHERE s.asset_id = a.asset_id AND s.asset_type = a.asset_type) AS described
      FROM assets a LEFT JOIN lc ON lc.asset_id = a.asset_id AND lc.content = a.content)""",
    f"""per_file AS (SELECT file_id, count(*) FILTER (asset_type = 'table') AS tables, count(*) FILTER (asset_type = 'text') AS texts, count(*) FILTER (asset_type = 'text' AND page_number IS NOT NULL) AS paged,
      count(*) FILTER (asset_type = 'text' AND page_number IS NULL) AS unpaged, bool_or(q = 'unusable') AS bad, bool_or(q = 'needs_review') AS unsure, bool_or(q = 'ready') AS good,
      count(*) FILTER ((asset_type = 'text' AND chars > 0) OR (asset_type = 'table' AND q = 'ready' AND NOT {IS_CANDIDATE})) AS usable, sum(n_issues)::BIGINT AS issues, bool_or(described) AS described FROM per_asset GROUP BY 1)""",
    f"""per_route AS (SELECT file_id, count(*) FILTER (status IN ('successful', 'partial')) AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) AS n FROM (SELECT * FROM runs {NEWEST.format('file_id, route')}) GROUP BY 1)""",
    """rollup AS (SELECT f.file_id, filename, relative_path, source_format, support, state, sha256, coalesce(a.tables, 0) AS tables, coalesce(a.texts, 0) AS texts,
      CASE WHEN paged > 0 THEN paged WHEN unpaged > 0 THEN 1 ELSE 0 END::BIGINT AS text_pages, coalesce(a.issues, 0) AS issues,
      CASE WHEN support <> 'supported' THEN 'unsupported' WHEN ok > 0 AND coalesce(usable, 0) = 0 THEN 'no_evidence' WHEN ok > 0 THEN 'ready' WHEN failed > 0 THEN 'failed' WHEN n IS NULL THEN 'not_processed' ELSE 'processing' END AS processing_status,
      CASE WHEN bad THEN 'unusable' WHEN unsure THEN 'needs_review' WHEN good THEN 'ready' ELSE 'not_assessed' END AS quality_status,
      CASE WHEN support <> 'supported' OR coalesce(ok, 0) = 0 THEN 'not_assessed' WHEN coalesce(usable, 0) = 0 THEN 'no_evidence' ELSE 'available' END AS evidence_status,
      CASE WHEN described THEN 'enriched' ELSE 'pending' END AS semantic_status
      FROM files f LEFT JOIN per_file a ON a.file_id = f.file_id LEFT JOIN per_route r ON r.file_id = f.file_id)""",
)

BOXES = """
WITH boxes AS (SELECT page, seq, x0, y0, x0 + 20 AS x1, y0 + 10 AS y1 FROM (
  SELECT user_id AS page, event_id AS seq, (event_id * 7 % 97)::DOUBLE AS x0, (event_id * 13 % 89)::DOUBLE AS y0
  FROM events))
"""



def snippet(text: str, pos: str) -> str:
    """Whole up to 500 characters, else a window of 500 from 166 before the place, moved back at the end."""
    b = f"greatest(0, least(length({text}), greatest(0, {pos} - 166) + 500) - 500)"
    return f"(CASE WHEN length({text}) <= 500 THEN {text} ELSE CASE WHEN {b} > 0 THEN '…' ELSE '' END || {text}[{b} + 1:{b} + 500] || CASE WHEN {b} + 500 < length({text}) THEN '…' ELSE '' END END)"


def _profile(name: str, number: bool) -> str:
    v = f"{name}::DOUBLE" if number else "NULL::DOUBLE"
    return f"""SELECT '{name}' AS column_name, count(*) AS n, count(*) FILTER ({name} IS NULL) AS n_null, count(DISTINCT {name}) AS n_distinct,
      min({v}) AS min_value, max({v}) AS max_value, round(avg({v}), 6) AS mean_value, round(median({v}), 6) AS median_value FROM lineitem"""


PAGE_PROFILES = """
SELECT user_id AS doc, event_id % 7 AS page, sum(CASE WHEN k = 't' THEN event_id % 11 ELSE 0 END)::BIGINT AS chars, sum(CASE WHEN k = 't' THEN event_id % 11 % 6 ELSE 0 END)::BIGINT AS effective,
  count(*) FILTER (k = 't') AS blocks, count(*) FILTER (k = 'i') AS images,
  round(least(1.0, sum(CASE WHEN k = 'i' THEN value ELSE 0 END) / 400), 6) AS image_share, round(least(1.0, sum(CASE WHEN k = 't' THEN value ELSE 0 END) / 400), 6) AS text_share,
  count(*) FILTER (k = 'd' AND least(event_id % 4, event_id % 9) <= 2 AND greatest(event_id % 4, event_id % 9) >= 4) AS grid_lines
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'i' WHEN event_id % 5 = 0 THEN 'd' ELSE 't' END AS k FROM events) GROUP BY 1, 2
"""
PAGE_PROFILES = f"SELECT *, effective > 0 AS native_text, images > 0 AND effective < 20 AND image_share >= 0.35 AS suspected_scan FROM ({PAGE_PROFILES})"
CLASSES = f"""SELECT doc, pages, scanned, native, CASE WHEN scanned > 0 AND native > 0 THEN 'mixed' WHEN scanned > 0 AND 2 * scanned >= pages THEN 'suspected_scanned' WHEN native = pages THEN 'native_text' WHEN native > 0 THEN 'mixed' ELSE 'unknown' END AS class,
  CASE WHEN scanned > 0 AND native > 0 THEN 'native_and_suspected_scanned_pages' WHEN scanned > 0 AND 2 * scanned >= pages THEN 'most_pages_have_scanned_signal' WHEN native = pages THEN 'all_pages_have_native_text' WHEN native > 0 THEN 'text_and_blank_pages' ELSE 'no_native_text_and_no_scanned_consensus' END AS reason
  FROM (SELECT doc, count(*) AS pages, count(*) FILTER (suspected_scan) AS scanned, count(*) FILTER (native_text) AS native FROM ({PAGE_PROFILES}) GROUP BY 1)"""

DIRTY_TABLE = """
WITH raw AS (SELECT c_custkey AS k, c_custkey % 10 = 0 AS gone, c_mktsegment AS a, (c_custkey % 7)::VARCHAR AS b, c_custkey % 28 + 1 AS d, lpad((c_custkey % 50)::VARCHAR, 4, '0') AS e, c_acctbal > 0 AS f FROM customer),
body AS (SELECT * FROM raw WHERE NOT gone),
dup AS (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM body GROUP BY a, b, d, e, f HAVING count(*) > 1))
"""

RECORDS = """WITH r AS (SELECT (user_id % 120)::VARCHAR AS file_id, event_id AS t0, event_id % 3 AS p, 'c' || CASE WHEN event_id % 4 = 0 THEN '0' ELSE (user_id % 120)::VARCHAR END AS content,
  CASE WHEN value < 10 THEN 'queued' WHEN value < 25 THEN 'running' WHEN value < 70 THEN 'completed' WHEN value < 90 THEN 'failed' ELSE 'cancelled' END AS state FROM events),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY t0 DESC) = 1)"""

SCORED = """
WITH li AS (SELECT l_orderkey AS id, l_linenumber - 1 AS r, max(l_returnflag) AS v FROM lineitem GROUP BY 1, 2),
e AS (SELECT o_orderkey AS id, o_custkey AS page, max(r) + 1 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx FROM orders JOIN li ON li.id = o_orderkey GROUP BY 1, 2),
f AS (SELECT id, page, n + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS n, row_number() OVER (PARTITION BY page ORDER BY id) AS idx FROM e WHERE id % 7 > 0),
ec AS (SELECT li.* FROM li JOIN e USING (id)),
fc AS (SELECT id, r, CASE WHEN id % 3 = 0 THEN v || ' ' WHEN id % 11 = 0 THEN '?' ELSE v END AS v FROM ec WHERE id % 7 > 0),
p AS (SELECT e.id AS e, f.id AS f, e.n AS en, f.n AS fn FROM e LEFT JOIN f ON e.page = f.page AND e.idx = f.idx)
"""

READ_CELLS = """
WITH c AS (SELECT l_orderkey AS t, l_linenumber % 3 AS r, CASE WHEN l_orderkey % 4 = 0 THEN 170 WHEN l_quantity > 30 THEN 0 ELSE 1 END AS size, l_quantity AS w, l_tax * 100 + 1 AS h, l_discount AS d FROM lineitem),
l AS (SELECT t, r, count(*) AS w, count(*) FILTER (size > 0) AS f, count(*) FILTER (size >= 160) AS g FROM c GROUP BY 1, 2),
g AS (SELECT t, count(*) AS n, max(w) AS hi, min(w) AS lo, sum(w) AS cells, sum(f) AS filled, sum(g) AS long, coalesce(max(f) FILTER (r = 0), 0) AS head FROM l GROUP BY 1),
s AS (SELECT t, count(*) AS boxes, median(w) AS mw, max(w) AS xw, median(h) AS mh, max(h) AS xh, avg(round(d * 10, 1)) AS sure FROM c GROUP BY 1)
"""


ORACLES: dict[str, str] = {
    "text_clean_profile": f"SELECT doc_id, length(t) AS char_count, CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS line_count, sha256(t) AS clean_sha256 FROM (SELECT doc_id, {STEP_D} AS t FROM documents)",
    "text_quality_by_lang": f"SELECT lang, {STATUS.format('t')} AS quality, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT lang, text, {STRIP_D} AS t FROM documents) GROUP BY 1, 2",
    "effective_chars": r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS effective FROM documents",
    "text_chunks": CHUNKS + 'SELECT doc_id, chunk, start, "end", sha256(chunk_text) AS chunk_sha256 FROM chunks',
    "chunk_counts": CHUNKS + 'SELECT doc_id, count(*) AS chunks, max("end") AS chars FROM chunks GROUP BY 1',
    "search_total_after_cap": CHUNKS + ", h AS (SELECT doc_id, least(3, count(*)) AS k FROM chunks WHERE contains(lower(chunk_text), 'and') GROUP BY 1) SELECT sum(k)::BIGINT AS total, count(*) AS assets FROM h",
    "text_occurrences": "SELECT doc_id, n FROM (SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS n FROM documents) WHERE n > 0",
    "conversation_lines": 'SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", role FROM conversations',
    "cell_normalize": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 IN (1, 2) THEN NULL ELSE n_name END AS value FROM nation",
    "exact_duplicates_mark": "SELECT l_returnflag, c > 1 AS is_duplicate, sum(c)::BIGINT AS n FROM (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus, l_linenumber) GROUP BY 1, 2",
    "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "numeric_summary": "SELECT min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS deviation FROM lineitem",
    "outliers_3sigma": "SELECT count(*) AS outliers FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) > 3 * s",
    "category_top10": "SELECT c_mktsegment AS value, count(*) AS frequency FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "trend_by_day": "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY 1 LIMIT 50",
    "sample_head_mid_tail": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r < 6 THEN 'head' WHEN r >= greatest(6, (n - 6) // 2) AND r < greatest(6, (n - 6) // 2) + 6 THEN 'middle' ELSE 'tail' END AS part FROM o WHERE r < 6 OR (r >= greatest(6, (n - 6) // 2) AND r < greatest(6, (n - 6) // 2) + 6) OR r >= n - 6",
    "stratified_sample": "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 5",
    "cell_score": """
      WITH a AS (SELECT l_orderkey AS k, l_linenumber AS j, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
      SELECT count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0) AS matched, count(*) FILTER (k % 11 <> 0 AND k % 13 = 0) AS differing,
        count(*) FILTER (k % 11 = 0) AS missing, count(*) FILTER (k % 17 = 0) AS extra FROM a""",
    "latest_run_per_user": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1",
    "latest_status_pivot": """
      WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r,
          CASE WHEN value < 20 THEN 'failed' WHEN value < 60 THEN 'partial' ELSE 'done' END AS status FROM events) WHERE r = 1)
      SELECT user_id, max(status) FILTER (event_type = 'view') AS "view", max(status) FILTER (event_type = 'click') AS click, max(status) FILTER (event_type = 'purchase') AS purchase,
        max(status) FILTER (event_type = 'signup') AS signup, max(status) FILTER (event_type = 'error') AS error,
        CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'partial') THEN 'partial' WHEN bool_or(status = 'done') THEN 'done' ELSE 'pending' END AS overall
      FROM l GROUP BY 1""",
    "recent_rate": "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "incremental_classify": """
      WITH d AS (SELECT doc_id, max(n_chars) AS size FROM documents GROUP BY 1)
      SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change
      FROM d WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)""",
    "missing_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "existing_keys": "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49 AND (l_returnflag = 'R' OR l_shipdate > o_orderdate))",
    "duplicate_contents": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "format_counts": r"SELECT regexp_extract(h, '\.([a-z]+)$', 1) AS format, count(*) AS n, count(DISTINCT h) AS hosts FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) GROUP BY 1",
    "safe_sql_join": "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 1000 GROUP BY 1",
    "safe_sql_setop": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "safe_sql_rejections": "SELECT i::BIGINT AS statement, code FROM (VALUES (0, 'empty_sql'), (1, 'read_only_required'), (2, 'multiple_statements'), (3, 'unknown_relation'), (4, 'external_access_denied'), (5, 'external_access_denied'), (6, 'forbidden_sql'), (7, 'unknown_relation'), (8, 'read_only_required')) v(i, code)",
    "grounding_check": "SELECT l_orderkey, bool_and(p_partkey IS NOT NULL) AS grounded FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON p_partkey = l_partkey GROUP BY 1",
    "reading_order": BOXES + "SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY y0, x0, seq) - 1 AS place FROM boxes",
    "overlap_suppress": BOXES
    + """SELECT t.page, t.seq FROM boxes t WHERE t.seq % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.seq % 10 = 0 AND b.page = t.page
      AND greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) * greatest(0, least(t.y1, b.y1) - greatest(t.y0, b.y0)) / 200 >= 0.55)""",
    "iou_pairs": BOXES
    + """, p AS (SELECT a.page, a.seq AS a, b.seq AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o
      FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq < b.seq) SELECT page, a, b, round(o / (400 - o), 6) AS iou FROM p WHERE round(o / (400 - o), 6) >= 0.5""",
    "row_bands": """
      WITH r AS (SELECT DISTINCT l_suppkey % 20 AS sheet, l_orderkey % 97 AS row FROM lineitem WHERE l_orderkey % 97 % 6 <> 0),
      i AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS k FROM r)
      SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY min(row)) AS band, min(row) AS first_row, max(row) AS last_row FROM i GROUP BY sheet, k""",
    "first_last_seen": """SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, min({'t': ts, 'e': event_type}).e AS first_event_type, max({'t': ts, 'e': event_type}).e AS last_event_type, count(*) AS n FROM events GROUP BY 1""",
    "issue_dedupe": """SELECT event_type, count(*) AS n, max(ts) AS newest FROM (SELECT event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events WHERE event_type <> 'view') WHERE r = 1 GROUP BY 1""",
    "report_facts": """
      SELECT 'shape' AS fact, 'part has ' || count(*) || ' rows and 3 columns' AS text FROM part
      UNION ALL SELECT 'missing', 'part has ' || (count(*) * 3 - count(p_brand) - count(p_size) - count(p_retailprice)) || ' missing values' FROM part
      UNION ALL SELECT 'numeric', 'p_retailprice from ' || round(min(p_retailprice), 2)::DECIMAL(30,2) || ' to ' || round(max(p_retailprice), 2)::DECIMAL(30,2) FROM part""",
    "shared_columns": "SELECT * FROM (VALUES ('documents', 'labels', 'doc_id'), ('benchmark', 'documents', 'text'), ('benchmark', 'conversations', 'text'), ('conversations', 'documents', 'text')) v(a, b, column_name)",
    "block_offsets": """SELECT conv_id, turn, s::BIGINT AS start, (s + length(text))::BIGINT AS "end" FROM (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)""",
    "text_windows": "SELECT doc_id, sha256(text[101:600]) AS window_sha256, length(text) > 600 AS has_next FROM documents",
    "budgeted_rows": """SELECT n_nationkey, n_name FROM (SELECT *, sum(length(n_nationkey::VARCHAR) + length(n_name) + 29) OVER (ORDER BY n_nationkey) AS used FROM nation) WHERE used <= 400""",
    "finding_grounds": """
      SELECT o_orderkey AS finding, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n_cited,
        o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS grounded FROM orders""",
    "text_clean_actions": rf"""SELECT *, concat_ws(' ', CASE WHEN unicode_nfc > 0 THEN 'unicode_nfc=' || unicode_nfc END, CASE WHEN trim_trailing_whitespace > 0 THEN 'trim_trailing_whitespace=' || trim_trailing_whitespace END,
        CASE WHEN compress_excessive_blank_lines > 0 THEN 'compress_excessive_blank_lines=' || compress_excessive_blank_lines END, CASE WHEN remove_control_characters > 0 THEN 'remove_control_characters=' || remove_control_characters END) AS actions FROM (
      SELECT doc_id, (r <> nfc_normalize(r))::BIGINT AS unicode_nfc, len(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '[ \t]\z')))::BIGINT AS trim_trailing_whitespace,
        length(b) - length(c) AS compress_excessive_blank_lines, length(c) - length(e) AS remove_control_characters
      FROM (SELECT doc_id, {DIRTY} AS r, {STEP_A} AS a, {STEP_B} AS b, {STEP_C} AS c, {STEP_D} AS e FROM documents))""",
    "text_extraction_normalize": rf"SELECT doc_id, sha256(regexp_replace({STEP_A}, '[\x00-\x08\x0B-\x1F]', '', 'g')) AS sha256 FROM documents",
    "presentation_text": r"""
      WITH m AS (SELECT doc_id, regexp_replace(text, '\n([^\n]{1,6}) ', E'\n- \n\n  \\1 ', 'g') AS t FROM documents),
      l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: rtrim(x, ' ' || chr(9))) AS ls FROM m),
      j AS (SELECT doc_id, list_reduce(list_transform(ls, lambda x: [x]), lambda acc, x: CASE
          WHEN regexp_matches(trim(acc[-1]), '^([•·▪◦–—-]|[0-9]{1,3}[.)、])$') AND trim(x[1]) = '' THEN acc
          WHEN regexp_matches(trim(acc[-1]), '^([•·▪◦–—-]|[0-9]{1,3}[.)、])$') THEN acc[1:len(acc) - 1] || [trim(acc[-1]) || ' ' || ltrim(x[1]) || chr(1)]
          ELSE acc || x END) AS ls FROM l)
      SELECT doc_id, sha256(trim(replace(array_to_string(ls, chr(10)), chr(1), ''), ' ' || chr(9) || chr(10))) AS sha256 FROM j""",
    "text_issue_rules": statements("texts")
    + r""", n AS (SELECT *, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+\z', '')) AS n FROM texts),
      i AS (SELECT asset_id, extractor, CASE WHEN n = 0 THEN ['empty_text'] ELSE list_sort(list_filter([CASE WHEN page_number IS NULL AND asset_id LIKE '%1' THEN 'incomplete_text_provenance' END, CASE WHEN n < 20 THEN 'low_content' END,
        CASE WHEN asset_id LIKE '%6' THEN 'low_ocr_confidence' END], lambda x: x IS NOT NULL)) END AS x FROM n)
      SELECT asset_id, array_to_string(x, ',') AS issues, CASE WHEN list_contains(x, 'empty_text') THEN 'unusable' WHEN len(x) > 0 OR contains(extractor, 'ocr') THEN 'needs_review' ELSE 'ready' END AS status FROM i""",
    "chunk_reassembly": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE length(text) > 0",
    "search_all_tokens": CHUNKS
    + f""", hits AS (SELECT *, least(instr(lower(chunk_text), 'the'), instr(lower(chunk_text), 'that')) - 1 AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS place
        FROM chunks WHERE contains(lower(chunk_text), 'the') AND contains(lower(chunk_text), 'that'))
      SELECT doc_id, chunk, 'tokens' AS kind, 82.0::DOUBLE AS score, pos::BIGINT AS start, place, sha256({snippet("chunk_text", "pos")}) AS snippet_sha256 FROM hits WHERE place <= 3""",
    "search_phrase_page": CHUNKS
    + """, hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS place FROM chunks WHERE contains(lower(chunk_text), 'of the'))
      SELECT doc_id, chunk, 'phrase' AS kind, 105.0::DOUBLE AS score, (instr(lower(chunk_text), 'of the') - 1)::BIGINT AS start FROM hits WHERE place <= 3 ORDER BY doc_id, chunk LIMIT 50 OFFSET 10""",
    "search_best_field": """
      WITH f AS (SELECT p_partkey, 'effective_display_name' AS field, 120.0 AS weight, p_name AS value FROM part UNION ALL SELECT p_partkey, 'column_name', 76.0, p_brand FROM part UNION ALL SELECT p_partkey, 'sample_value', 42.0, p_type FROM part),
      h AS (SELECT *, CASE WHEN lower(value) = 'brand#1' THEN 'exact' ELSE 'substring' END AS kind FROM f WHERE contains(lower(value), 'brand#1')),
      s AS (SELECT p_partkey, field, kind, round((weight * CASE kind WHEN 'exact' THEN 1.0 ELSE 0.76 END)::DOUBLE, 4) AS score FROM h)
      SELECT p_partkey, field, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, field) AS r FROM s) WHERE r = 1""",
    "search_ranked": registry(
        chunks_of("(SELECT * FROM texts WHERE is_current)", "asset_id", before=" ").strip(),
        f"""ok AS (SELECT a.*, p_name, p_brand, p_type, CASE base_quality WHEN 'ready' THEN 0 WHEN 'unusable' THEN -18 ELSE -4 END AS points FROM assets a LEFT JOIN part ON a.asset_id = 't' || p_partkey
          WHERE asset_type = 'text' OR (base_quality = 'ready' AND NOT {IS_CANDIDATE}))""",
        """fields AS (SELECT asset_id, asset_type, points, unnest([{'f': 'effective_display_name', 'w': 120, 'l': 'name', 'v': fallback_name}, {'f': 'source_file', 'w': 92, 'l': 'source file', 'v': source_file}, {'f': 'source_root', 'w': 80, 'l': 'source path', 'v': source_root},
          {'f': 'sheet_name', 'w': 78, 'l': 'sheet', 'v': sheet_name}, {'f': 'source_format', 'w': 38, 'l': 'format', 'v': source_format}, {'f': 'column_name', 'w': 76, 'l': 'column', 'v': p_name}, {'f': 'column_name', 'w': 76, 'l': 'column', 'v': p_brand},
          {'f': 'sample_value', 'w': 42, 'l': 'sample', 'v': p_type}]) AS x FROM ok)""",
        """q AS (SELECT 1 AS request, 'the' AS a, 'dir1' AS b UNION ALL SELECT 2, 'brand#1', 'brand#1')""",
        """meta AS (SELECT request, asset_id, asset_type, points, x.f AS field, x.l || ': ' || x.v AS body, CASE WHEN request = 2 AND lower(x.v) = 'brand#1' THEN x.w ELSE round(x.w * CASE request WHEN 1 THEN 0.6 ELSE 0.76 END, 4) END AS score, request = 2 AND lower(x.v) = 'brand#1' AS exact,
          least(instr(lower(x.l || ': ' || x.v), a), instr(lower(x.l || ': ' || x.v), b)) - 1 AS pos FROM fields, q WHERE (request = 1 OR asset_type = 'table') AND contains(lower(x.v), a) AND contains(lower(x.v), b)
          QUALIFY row_number() OVER (PARTITION BY request, asset_id ORDER BY score DESC, x.f, x.l, x.v) = 1)""",
        """hits AS (SELECT request, asset_id, asset_type, NULL AS chunk, field || CASE WHEN exact THEN '_exact' ELSE '_contains' END AS match_kind, round(score + points, 4)::DOUBLE AS score, pos, body FROM meta
          UNION ALL SELECT 1, c.asset_id, 'text', chunk::VARCHAR, 'text_token', 82.0 + points, least(instr(lower(chunk_text), 'the'), instr(lower(chunk_text), 'dir1')) - 1, chunk_text FROM chunks c JOIN ok ON ok.asset_id = c.asset_id WHERE contains(lower(chunk_text), 'the') AND contains(lower(chunk_text), 'dir1'))""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY request, asset_id ORDER BY score DESC, coalesce(chunk, ''), match_kind) AS place FROM hits)",
        names=("files", "tables", "texts", "cleaning", "issues", "semantic"),
    )
    + f"SELECT request, asset_id, asset_type, chunk, match_kind, score, pos::BIGINT AS start, sha256({snippet('body', 'pos')}) AS snippet_sha256, place FROM placed WHERE place <= 3",
    "search_ranked_page": statements("texts").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", "
    + chunks_of("(SELECT * FROM texts WHERE is_current)", "asset_id", before=" ")
    + """, h AS (SELECT asset_id, chunk::VARCHAR AS chunk, 105.0::DOUBLE AS score, instr(lower(chunk_text), 'of the') - 1 AS start FROM chunks WHERE contains(lower(chunk_text), 'of the') QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY chunk::VARCHAR) <= 3)
      SELECT h.asset_id, chunk, score, start, page_number, (SELECT count(*) FROM h) AS total FROM h JOIN texts t ON t.asset_id = h.asset_id ORDER BY h.asset_id, chunk LIMIT 40 OFFSET 7""",
    "file_occurrences": statements("texts")
    + f""", p AS (SELECT asset_id, page_number AS page, text, string_split(text, 'tion') AS parts FROM texts WHERE contains(text, 'tion')),
      o AS (SELECT asset_id, page, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + 4 * (i - 1))) AS start FROM p)
      SELECT asset_id, page, start::BIGINT AS start, (start + 4)::BIGINT AS "end", sha256({snippet("text", "start::BIGINT")}) AS snippet_sha256, row_number() OVER (PARTITION BY asset_id ORDER BY start) - 1 AS occurrence FROM o""",
    "occurrence_places": statements("texts")
    + """, h AS (SELECT page_number, sheet_name, (length(text) - length(replace(text, 'ononon', ''))) // 6 AS n FROM texts WHERE contains(text, 'ononon'))
      SELECT coalesce(sum(n), 0)::BIGINT AS total, coalesce(array_to_string(list_sort(list(DISTINCT page_number)), ','), '') AS pages, coalesce(array_to_string(list_sort(list(DISTINCT sheet_name) FILTER (sheet_name IS NOT NULL)), ','), '') AS sections FROM h""",
    "cell_occurrences": """
      WITH c AS (SELECT p_partkey AS row, unnest([{'column': 0, 'n': 'p_name', 'v': p_name}, {'column': 1, 'n': 'p_brand', 'v': p_brand}, {'column': 2, 'n': 'p_type', 'v': p_type}]) AS c FROM part),
      s AS (SELECT row, c, unnest(list_filter(range(0, length(c.v)), lambda i: c.v[i + 1] = 'a')) AS start FROM c)
      SELECT row, c."column"::BIGINT AS "column", c.n AS column_name, start, c.n || ': ' || c.v AS snippet FROM s""",
    "type_inference": "SELECT * FROM (VALUES ('size', 'integer'), ('brand', 'string'), ('code', 'string'), ('price', 'float_candidate'), ('large', 'boolean_candidate'), ('day', 'date'), ('nothing', 'string')) v(column_name, inferred)",
    "exact_duplicates_drop": "SELECT min(l_orderkey * 10 + l_linenumber) AS place, l_suppkey, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL",
    "clean_table_actions": DIRTY_TABLE
    + """SELECT 'normalize_unicode_whitespace_newlines_nulls' AS type, (SELECT 6 * count(*) FILTER (gone) + 2 * count(*) FILTER (NOT gone) FROM raw) AS "count"
      UNION ALL SELECT 'mechanical_column_name_normalization', 6
      UNION ALL SELECT 'trim_empty_rows', count(*) FROM raw WHERE gone UNION ALL SELECT 'trim_empty_columns', 1
      UNION ALL SELECT 'mark_exact_duplicate_rows', n FROM dup WHERE n > 0 UNION ALL SELECT 'conservative_type_inference', 3
      UNION ALL SELECT 'empty_rows_before', count(*) FROM raw WHERE k % 20 = 0 UNION ALL SELECT 'duplicate_rows', n FROM dup""",
    "clean_table_columns": """SELECT * FROM (VALUES (0::BIGINT, 'a', ' Segment name ', 'Segment_name', 'string', ''), (1, 'b', 'code', 'code', 'integer', ''), (2, 'c', 'nothing', 'nothing', 'string', ''), (3, 'd', 'day', 'day', 'date', ''),
      (4, 'e', 'CODE', 'CODE__2', 'string', 'leading_zero_numeric_text'), (5, 'f', NULL, 'column_0006', 'boolean_candidate', '')) v(place, raw, original, normalized, inferred, risks)""",
    "clean_table_rows": DIRTY_TABLE + """SELECT k AS place, a AS "Segment_name", b::BIGINT AS code, make_date(2024, 1, d::INTEGER) AS day, e AS "CODE__2", f AS column_0006 FROM body""",
    "column_rename_dedupe": """
      WITH n AS (SELECT n_regionkey, n_nationkey AS place, CASE n_nationkey % 4 WHEN 0 THEN 'column_' || lpad((n_nationkey + 1)::VARCHAR, 4, '0') WHEN 1 THEN 'Name' ELSE 'NAME' END AS b FROM nation),
      r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, lower(b) ORDER BY place) AS duplicate_ordinal FROM n)
      SELECT n_regionkey, place, b || CASE WHEN duplicate_ordinal > 1 THEN '__' || duplicate_ordinal ELSE '' END AS name_out, duplicate_ordinal FROM r""",
    "table_preview": "SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN length(text) > 100 THEN text[1:100] || '…' ELSE text END AS text FROM documents d ORDER BY d.doc_id LIMIT 20",
    "table_slice": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "matrix_types": """
      WITH k AS (SELECT l_suppkey AS sheet, l_linenumber::BIGINT AS col, CASE l_linenumber % 4 WHEN 0 THEN 'integer' WHEN 1 THEN CASE WHEN l_quantity > 25 THEN 'float' ELSE 'integer' END WHEN 2 THEN 'date' ELSE CASE WHEN l_quantity > 40 THEN 'integer' ELSE 'string' END END AS k FROM lineitem)
      SELECT sheet, col, CASE WHEN count(DISTINCT k) = 1 THEN min(k) WHEN bool_and(k IN ('integer', 'float')) THEN 'float' ELSE 'string' END AS kind FROM k GROUP BY 1, 2""",
    "table_profile_lineitem": "SELECT column_name, n, n_null, round(n_null / n, 6) AS null_ratio, n_distinct, min_value, max_value, mean_value, median_value, n > n_null AND n_distinct <= 1 AS constant, (n - n_null >= 10 AND n_distinct >= 0.9 * (n - n_null)) AS high_cardinality FROM ("
    + " UNION ALL ".join(_profile(c, c not in ("l_returnflag", "l_shipdate")) for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"))
    + ")",
    "table_profile": """SELECT count(*) AS row_count, 3::BIGINT AS column_count, count(*) FILTER (doc_id % 3 = 0) AS null_count, round(count(*) FILTER (doc_id % 3 = 0) / (count(*) * 3), 6) AS empty_cell_ratio,
      round(count(*) FILTER (doc_id % 3 > 0 AND length(text) > 200) / (count(*) * 3), 6) AS long_text_cell_ratio, sum(length(doc_id::VARCHAR) + length(lang) + CASE WHEN doc_id % 3 > 0 THEN length(text) ELSE 0 END)::BIGINT AS chars FROM documents""",
    "column_samples": """SELECT 'p_brand' AS column_name, string_agg(v, '|' ORDER BY k) AS samples FROM (SELECT p_brand AS v, p_partkey AS k FROM part ORDER BY p_partkey LIMIT 5)
      UNION ALL SELECT 'p_size', string_agg(v, '|' ORDER BY k) FROM (SELECT p_size::VARCHAR AS v, p_partkey AS k FROM part ORDER BY p_partkey LIMIT 5)""",
    "time_ranges": "SELECT 'l_shipdate' AS column_name, min(l_shipdate)::DATE::VARCHAR AS first_value, max(l_shipdate)::DATE::VARCHAR AS last_value FROM lineitem",
    "table_quality": """
      WITH g AS (SELECT l_suppkey AS k, CASE WHEN l_suppkey % 6 = 0 THEN 1 ELSE count(*) END AS rows, round(count(*) FILTER (l_discount = 0) / count(*), 6) AS e, round(avg(l_tax) * 10, 6) AS c FROM lineitem GROUP BY 1),
      i AS (SELECT *, CASE WHEN k % 5 = 0 THEN ['empty_table'] ELSE list_sort(list_filter([CASE WHEN k % 11 = 0 THEN 'incomplete_table_provenance' END, CASE WHEN e >= 0.5 AND rows * (k % 5) >= 4 THEN CASE WHEN k % 3 = 0 THEN 'sparse_ocr' ELSE 'sparse_table' END END,
          CASE WHEN k % 3 = 0 THEN 'possible_table_structure_loss' END, CASE WHEN k % 7 = 0 THEN 'irregular_row_width' END, CASE WHEN k % 3 = 0 AND k % 5 = 1 THEN 'suspicious_single_column' END,
          CASE WHEN k % 3 = 0 AND rows = 1 THEN 'suspicious_single_row' END, CASE WHEN c < 0.65 THEN 'low_ocr_confidence' END, CASE WHEN k % 4 = 0 THEN 'possible_title_row' END], lambda x: x IS NOT NULL)) END AS x FROM g),
      s AS (SELECT *, CASE WHEN x[1] = 'empty_table' THEN 'unusable' WHEN len(x) > 0 OR k % 3 = 0 THEN 'needs_review' ELSE 'ready' END AS status FROM i)
      SELECT k AS l_suppkey, rows, array_to_string(x, ',') AS issues, status, CASE WHEN status = 'unusable' THEN 'unusable' WHEN k % 3 = 0 THEN 'candidate_only' WHEN status = 'ready' THEN 'confirmed' ELSE 'best_effort' END AS trust FROM s""",
    "percentile_nearest_rank": "WITH o AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) SELECT share::DOUBLE AS share, value FROM o JOIN (VALUES (0.5), (0.9), (0.95), (0.99)) s(share) ON r = round_even(((n - 1) * share)::DOUBLE, 0)",
    "catalog_view": registry(*VIEW) + "SELECT * FROM catalog",
    "catalog_summary": registry(*VIEW)
    + """SELECT (SELECT count(*) FROM files WHERE state = 'present') AS files, (SELECT count(*) FROM files WHERE state = 'present' AND support = 'supported') AS supported_files, (SELECT count(*) FROM files WHERE state = 'present' AND support <> 'supported') AS unsupported_files,
      count(*) AS assets, count(*) FILTER (asset_type = 'table') AS asset_type_table, coalesce(sum("rows") FILTER (asset_type = 'table'), 0)::BIGINT AS table_rows, count(*) FILTER (asset_type = 'text') AS asset_type_text, coalesce(sum(chunks), 0)::BIGINT AS text_chunks,
      count(*) FILTER (quality = 'ready') AS quality_ready, count(*) FILTER (quality = 'needs_review') AS quality_needs_review, count(*) FILTER (quality = 'unusable') AS quality_unusable,
      count(*) FILTER (semantic_status = 'pending') AS semantic_status_pending, count(*) FILTER (semantic_status = 'enriched') AS semantic_status_enriched,
      count(*) FILTER (cleaning_status = 'successful') AS cleaning_status_successful, count(*) FILTER (cleaning_status = 'failed') AS cleaning_status_failed, count(*) FILTER (cleaning_status = 'not_run') AS cleaning_status_not_run,
      (SELECT count(*) FROM seen i WHERE status IN ('open', 'accepted') AND EXISTS (SELECT 1 FROM catalog c WHERE c.asset_id = i.asset_id AND (i.run_id IS NULL OR i.run_id = c.cleaning_run))) AS visible_issues,
      (SELECT count(*) FROM seen i WHERE status = 'open' AND EXISTS (SELECT 1 FROM catalog c WHERE c.asset_id = i.asset_id AND (i.run_id IS NULL OR i.run_id = c.cleaning_run))) AS open_issues FROM catalog""",
    "catalog_page": registry(*VIEW)
    + """, m AS (SELECT * FROM catalog WHERE quality = 'ready' AND (display_name ILIKE '%supplier%' OR fallback_name ILIKE '%supplier%' OR source_file ILIKE '%supplier%'))
      SELECT source_file, asset_type, asset_id, display_name, total, total > 105 AS has_next FROM (SELECT count(*) AS total FROM m) LEFT JOIN (SELECT source_file, asset_type, asset_id, display_name FROM m ORDER BY 1, 2, 3 LIMIT 100 OFFSET 5) ON true""",
    "catalog_empty_page": registry(*VIEW) + "SELECT NULL::VARCHAR AS asset_id, count(*) AS total, false AS has_next FROM catalog WHERE display_name ILIKE '%a_b%c%' OR fallback_name ILIKE '%a_b%c%' OR source_file ILIKE '%a_b%c%'",
    "file_rollup": registry(*ROLLUP) + "SELECT * FROM rollup",
    "files_page": registry(*ROLLUP)
    + """, m AS (SELECT * FROM rollup WHERE state = 'present' AND support = 'supported' AND source_format IN ('pdf', 'docx', 'txt', 'doc', 'ppt', 'pptx') AND (filename ILIKE '%dir_/%' OR relative_path ILIKE '%dir_/%'))
      SELECT file_id, relative_path, processing_status, quality_status, total, total > 32 AS has_next FROM (SELECT count(*) AS total FROM m) LEFT JOIN (SELECT file_id, relative_path, processing_status, quality_status FROM m ORDER BY 2, 1 LIMIT 30 OFFSET 2) ON true""",
    "processing_counts": statements("files", "runs")
    + f""", own AS (SELECT r.* FROM runs r JOIN files f ON f.file_id = r.file_id AND f.sha256 = r.content WHERE f.state = 'present'),
      by_route AS (SELECT * FROM own {NEWEST.format('file_id, content, route')}), pic AS (SELECT * FROM own WHERE route IN ('ocr_rapidocr', 'vision_llm') {NEWEST.format('file_id, content')}),
      s AS (SELECT f.*, (SELECT status FROM by_route r WHERE r.file_id = f.file_id AND route = 'structured_native') AS st, (SELECT status FROM by_route r WHERE r.file_id = f.file_id AND route = 'pdf_native_text') AS pd, (SELECT status FROM by_route r WHERE r.file_id = f.file_id AND route = 'ocr_rapidocr') AS oc,
        (SELECT status FROM by_route r WHERE r.file_id = f.file_id AND route = 'text_plain') AS pl, (SELECT status FROM by_route r WHERE r.file_id = f.file_id AND route = 'docx_native') AS dx, (SELECT status FROM pic r WHERE r.file_id = f.file_id) AS im FROM files f WHERE state = 'present'),
      z AS (SELECT CASE WHEN support <> 'supported' THEN 'unsupported' WHEN sha256 IS NULL THEN 'failed' ELSE CASE source_format WHEN 'csv' THEN st WHEN 'tsv' THEN st WHEN 'xlsx' THEN st WHEN 'jpeg' THEN im WHEN 'png' THEN im WHEN 'txt' THEN pl WHEN 'docx' THEN dx
        WHEN 'pdf' THEN CASE WHEN 'failed' IN (coalesce(pd, ''), coalesce(oc, '')) THEN 'failed' WHEN pd IN ('successful', 'partial') OR oc IN ('successful', 'partial') THEN 'successful' ELSE coalesce(pd, oc) END END END AS s FROM s)
      SELECT count(*) FILTER (s IN ('successful', 'partial')) AS processed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IS NULL OR s = 'running') AS deferred, count(*) FILTER (s IN ('successful', 'partial', 'failed')) AS terminal FROM z""",
    "issue_page": registry(*VIEW)
    + """, m AS (SELECT * FROM seen WHERE status = 'open'), p AS (SELECT issue_id, asset_id, issue_type, created FROM m ORDER BY created DESC, issue_id LIMIT 60 OFFSET 3)
      SELECT issue_id, p.asset_id, issue_type, created, display_name, (SELECT count(*) FROM m) AS total FROM p LEFT JOIN catalog c ON c.asset_id = p.asset_id""",
    "values_left_join_counts": statements("issues") + ", " + SEEN + """
      SELECT w.a AS asset_id, count(issue_id) AS issues FROM (VALUES ('t2', 'r101'), ('t4', NULL), ('x7', 'r8'), ('x9', NULL), ('nothing', NULL)) w(a, r)
      LEFT JOIN seen i ON i.asset_id = w.a AND status IN ('open', 'accepted') AND (i.run_id IS NULL OR i.run_id = w.r) GROUP BY 1""",
    "correlated_chunk_count": chunks_of("documents", "doc_id") + "SELECT doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id AND d.doc_id % 5 > 0) AS chunks FROM documents d",
    "asset_details": registry(*VIEW)
    + """SELECT asset_id, display_name, quality, coalesce((SELECT string_agg(issue_type || ':' || status, ',' ORDER BY issue_type, status) FROM seen i WHERE i.asset_id = c.asset_id AND status IN ('open', 'accepted') AND (i.run_id IS NULL OR i.run_id = c.cleaning_run)), '') AS open_issues,
      coalesce((SELECT string_agg(run_id, ',' ORDER BY generated, run_id) FROM semantic s WHERE s.asset_id = c.asset_id), '') AS semantic_runs FROM catalog c WHERE asset_id = 't2'""",
    "issue_updates": statements("issues")
    + """, e AS (SELECT 'i' || (event_id % 4000) AS issue_id, event_id AS at, CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'accepted' END AS s FROM events WHERE event_id % 9 = 0 AND (event_id % 2 = 0 OR event_id % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY event_id % 4000 ORDER BY event_id DESC) = 1)
      SELECT issue_type, coalesce(e.s, status) AS status, count(*) AS n FROM issues LEFT JOIN e USING (issue_id) GROUP BY 1, 2""",
    "issue_upserts": statements("issues")
    + """SELECT status, count(*) AS n FROM (SELECT CASE WHEN issue_id[2:]::BIGINT % 6 = 0 THEN 'resolved' ELSE status END AS status FROM issues UNION ALL SELECT status FROM issues WHERE issue_id[2:]::BIGINT % 50 = 0) GROUP BY 1""",
    "file_upserts": """
      WITH o AS (SELECT user_id, max(value) AS size, min(ts) AS a, max(ts) AS b FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, min(value) AS size, max(ts) AS t FROM events WHERE event_id % 2 = 1 AND user_id % 3 > 0 GROUP BY 1)
      SELECT user_id, CASE WHEN t > b OR b IS NULL OR (t = b AND n.size > o.size) THEN n.size ELSE o.size END AS size, least(a, t) AS first_seen, greatest(b, t) AS last_seen FROM o FULL JOIN n USING (user_id)""",
    "missing_paths": statements("files") + "SELECT relative_path AS path FROM files WHERE state <> 'missing' AND relative_path NOT LIKE '%.csv' AND relative_path NOT LIKE '%.pdf' AND relative_path NOT LIKE 'dir3/%'",
    "runs_to_do": statements("files", "runs")
    + "SELECT file_id, sha256 AS content FROM files f WHERE sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.file_id = f.file_id AND r.content = f.sha256 AND route = 'text_plain' AND status IN ('successful', 'partial'))",
    "reusable_runs": statements("files", "runs")
    + f", g AS (SELECT * FROM runs WHERE status IN ('successful', 'partial') {NEWEST.format('file_id, content')}) SELECT f.file_id, run_id, route, status FROM files f JOIN g ON g.file_id = f.file_id AND g.content = f.sha256",
    "interrupted_runs": statements("runs") + "SELECT route, replace(status, 'running', 'interrupted') AS status, count(*) AS n FROM runs GROUP BY 1, 2",
    "root_snapshot": registry(names=("files", "tables", "texts", "cleaning", "issues", "semantic")) + "SELECT source_file, coalesce(sum(\"rows\"), 0)::BIGINT AS \"rows\", coalesce(sum(chars), 0)::BIGINT AS chars FROM assets WHERE source_root = 'root1' GROUP BY 1",
    "insight_statuses": RECORDS.replace("WITH r", statements("files") + ", r", 1)
    + """ SELECT f.file_id, CASE WHEN source_format = 'png' THEN 'no_evidence' WHEN l.state = 'queued' THEN 'queued' WHEN l.state = 'running' THEN CASE p WHEN 0 THEN 'calling' WHEN 1 THEN 'preparing' ELSE 'running' END WHEN l.state = 'failed' THEN 'failed' WHEN l.state = 'completed' THEN 'ready' ELSE 'not_started' END AS insight
      FROM files f LEFT JOIN l ON l.file_id = f.file_id""",
    "insight_queue": RECORDS
    + """ SELECT count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
      count(*) FILTER (state = 'running' AND p = 1) AS running_preparing, count(*) FILTER (state = 'running' AND p = 0) AS running_calling, 0::BIGINT AS running_saving, count(*) AS total FROM l""",
    "stale_insights": RECORDS.replace("WITH r", statements("files") + ", r", 1)
    + " SELECT CASE WHEN r.state = 'queued' AND content IS DISTINCT FROM f.sha256 THEN 'cancelled' WHEN r.state = 'running' THEN 'queued' ELSE r.state END AS state, count(*) AS n FROM r LEFT JOIN files f ON f.file_id = r.file_id GROUP BY 1",
    "page_types": """
      SELECT CASE WHEN starts_with(s, '<!doctype html') OR starts_with(s, '<html') OR starts_with(s, '<head') OR starts_with(s, '<body') OR contains(s[1:4096], '<html') THEN 'html' WHEN starts_with(s, '<?xml') THEN 'xml' ELSE 'plain_text' END AS kind, count(*) AS n, sum(length(html))::BIGINT AS chars
      FROM (SELECT html, lower(ltrim(html, ' ' || chr(9) || chr(10) || chr(13))) AS s FROM pages) GROUP BY 1""",
    "benchmark_mentions": r"""
      WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
      i AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda k: w[k:k + least(8, len(w)) - 1])) AS g FROM w WHERE len(w) > 0),
      d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k:k + n - 1])) AS g FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
      SELECT DISTINCT doc_id, item_id FROM g JOIN i USING (g)""",
    "budgeted_context": "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(length(text)) OVER w::BIGINT AS used, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE used <= 12000 AND r <= 500",
    "context_in_budget": """
      WITH c AS (SELECT conv_id, turn, text, 300 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL)
      SELECT conv_id, turn, sha256(text[1:room::BIGINT]) AS text_sha256, least(length(text), room)::BIGINT AS chars FROM c WHERE room > 0 AND r <= 500""",
    "current_runs": """
      WITH r AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, event_id % 4 AS c FROM events),
      g AS (SELECT * FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT user_id, event_id FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = g.user_id AND NOT r.ok AND (r.ts, r.event_id) > (g.ts, g.event_id) AND r.c <> g.c)""",
    "table_regions": """
      WITH c AS (SELECT sheet, r, k, CASE WHEN r % 6 < 2 OR sheet % 4 = 0 THEN 's' ELSE 'n' END AS t FROM (SELECT DISTINCT l_suppkey AS sheet, l_orderkey % 29 AS r, l_partkey % 11 AS k FROM lineitem) WHERE r % 6 <> 5 AND k % 4 <> 3 AND (r % 6 <> 0 OR sheet % 3 > 0 OR k % 4 = 0)),
      rb AS (SELECT sheet, r, r - row_number() OVER (PARTITION BY sheet ORDER BY r) AS i FROM (SELECT DISTINCT sheet, r FROM c)),
      c2 AS (SELECT c.*, i FROM c JOIN rb USING (sheet, r)),
      cb AS (SELECT sheet, i, k, k - row_number() OVER (PARTITION BY sheet, i ORDER BY k) AS j FROM (SELECT DISTINCT sheet, i, k FROM c2)),
      b AS (SELECT sheet, i, min(r) AS row_start, max(r) + 1 AS row_end FROM rb GROUP BY 1, 2),
      c3 AS (SELECT c2.*, j, row_start, row_end FROM c2 JOIN cb USING (sheet, i, k) JOIN b USING (sheet, i)),
      l AS (SELECT sheet, i, j, r, count(*) AS n FROM c3 GROUP BY 1, 2, 3, 4),
      g AS (SELECT sheet, i, j, row_start, row_end, min(k) AS column_start, max(k) + 1 AS column_end, count(*) FILTER (r = row_start) AS n1,
        coalesce(bool_and(t = 's') FILTER (r = row_start), true) AS t1, coalesce(bool_and(t = 's') FILTER (r < row_start + 2), true) AS t2, coalesce(bool_or(t <> 's') FILTER (r >= row_start + 2), false) AS o FROM c3 GROUP BY ALL),
      w AS (SELECT g.*, n1 = 1 AND coalesce((SELECT max(n) FROM l WHERE l.sheet = g.sheet AND l.i = g.i AND l.j = g.j AND l.r > g.row_start), 0) > 1 AS title, row_end - row_start >= 3 AND t2 AND o AS double, count(*) OVER (PARTITION BY sheet) > 1 AS several FROM g)
      SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY row_start, column_start) - 1 AS region, row_start, row_end, column_start, column_end,
        concat_ws(',', CASE WHEN title THEN 'possible_title_row,ambiguous_table_boundary' END, CASE WHEN double THEN 'possible_multirow_header' END, CASE WHEN several THEN 'multiple_table_regions' END) AS warnings, n1 >= 2 AND t1 AND NOT title AND NOT double AS header FROM w""",
    "spatial_lines": BOXES
    + """, n AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) <= 5 AND x0 >= lag(x0) OVER w - 2 THEN 0 ELSE 1 END AS new FROM boxes WINDOW w AS (PARTITION BY page ORDER BY seq)),
      l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY seq)::BIGINT AS line FROM n) SELECT page, line, string_agg(seq::VARCHAR, ' ' ORDER BY seq) AS line_text FROM l GROUP BY 1, 2""",
    "page_profiles": PAGE_PROFILES,
    "page_table_hints": """
      WITH RECURSIVE b AS (SELECT user_id AS doc, event_id % 2 AS page, event_id * 7 % 5 * 60 AS x, event_id * 13 % 31 * 6 AS y, event_id % 53 AS e FROM events),
      ys AS (SELECT doc, page, y, count(*) AS n FROM b GROUP BY 1, 2, 3), r AS (SELECT b.*, n, y AS line FROM b JOIN ys USING (doc, page, y) WHERE n >= 3),
      f AS (SELECT doc, page, min(line) AS first, count(DISTINCT line) AS lines FROM r GROUP BY 1, 2),
      k AS (SELECT r.doc, r.page, count(*) FILTER (EXISTS (SELECT 1 FROM r z WHERE z.doc = r.doc AND z.page = r.page AND z.line > r.line AND abs(z.x - r.x) <= 12)) AS again FROM r JOIN f ON f.doc = r.doc AND f.page = r.page AND r.line = f.first GROUP BY 1, 2),
      p AS (SELECT doc, page, count(*) AS n, count(*) FILTER (e <= 40) AS short FROM b GROUP BY 1, 2)
      SELECT p.doc, p.page, coalesce(lines >= 2 AND again >= 3, false) AS aligned, coalesce(lines >= 2 AND again >= 3, false) AND short >= 8 AND short / n >= 0.7 AS many_short FROM p LEFT JOIN f USING (doc, page) LEFT JOIN k USING (doc, page)""",
    "document_classes": CLASSES,
    "table_pages": f"SELECT p.doc, p.page, c.class FROM ({PAGE_PROFILES}) p JOIN ({CLASSES}) c USING (doc) WHERE (class IN ('native_text', 'mixed') AND grid_lines >= 4) OR class = 'unknown'",
    "ocr_pages": f"SELECT p.doc, p.page, CASE WHEN suspected_scan THEN 'suspected_scanned_page' ELSE 'mixed_page_without_native_text' END AS reason FROM ({PAGE_PROFILES}) p JOIN ({CLASSES}) c USING (doc) WHERE NOT native_text AND (suspected_scan OR class <> 'native_text')",
    "vision_pages": f"SELECT doc, page FROM ({PAGE_PROFILES}) WHERE suspected_scan AND effective = 0",
    "layout_hints": f"SELECT doc, page, CASE WHEN grid_lines % 2 > 0 THEN CASE WHEN effective >= 25 THEN 'webpage_like' ELSE 'table_dominant' END WHEN effective > 0 THEN 'document' ELSE 'other' END AS hint FROM ({PAGE_PROFILES})",
    "image_table_flags": READ_CELLS
    + """SELECT t AS table_id, concat_ws(',', CASE WHEN hi <= 1 THEN 'suspicious_single_column' END, CASE WHEN n <= 1 THEN 'suspicious_single_row' END, CASE WHEN hi <> lo THEN 'possible_column_shift' END, CASE WHEN n >= 3 AND hi >= 3 AND lo <= greatest(1, hi // 2) THEN 'severe_raggedness' END,
      CASE WHEN filled < greatest(2, (cells + 1) // 2) OR t % 9 = 0 THEN 'sparse_ocr' END, CASE WHEN filled > 0 AND long >= 0.6 * filled THEN 'possible_table_structure_loss' END, CASE WHEN head = 0 AND filled > 0 THEN 'possible_header_loss' END,
      CASE WHEN boxes >= 4 AND ((mw > 0 AND xw > mw * 1.6) OR (mh > 0 AND xh > mh * 1.8)) THEN 'possible_merged_cells' END, CASE WHEN t % 9 > 0 AND sure < 0.65 THEN 'low_ocr_confidence' END) AS flags FROM g JOIN s USING (t)""",
    "native_table_flags": READ_CELLS
    + """SELECT t AS table_id, concat_ws(',', CASE WHEN hi = 1 AND n >= 2 THEN 'suspicious_single_column' END, CASE WHEN n = 1 AND hi >= 2 THEN 'suspicious_single_row' END, CASE WHEN hi <> lo THEN 'possible_column_shift' END, CASE WHEN boxes >= 4 AND mw > 0 AND xw > mw * 1.6 THEN 'possible_merged_cells' END) AS flags FROM g JOIN s USING (t)""",
    "scaled_boxes": BOXES + "SELECT seq, CASE WHEN k THEN x0 / 4 END AS x0, CASE WHEN k THEN y0 / 4 END AS y0, CASE WHEN k THEN x1 / 4 END AS x1, CASE WHEN k THEN y1 / 4 END AS y1 FROM (SELECT *, seq % 4 = 0 AND seq % 5 > 0 AS k FROM boxes)",
    "read_table_warnings": """SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey % 3 = 0 THEN 'duplicate_column_names' END, CASE WHEN n_regionkey = 0 THEN 'empty_table' END, CASE WHEN n_nationkey % 4 = 0 THEN 'empty_column_header' END) AS warnings FROM nation""",
    "table_scores": SCORED.replace("p AS (", "p0 AS (", 1)
    + """, q AS (SELECT e AS e, f AS f, en, fn FROM p0),
      t AS (SELECT count(*) AS expected_tables, (SELECT count(*) FROM f) AS detected_tables, count(f) AS true_positives, count(*) FILTER (f IS NULL) AS false_negatives, (SELECT count(*) FROM f) - count(f) AS obvious_false_positives,
        count(*) FILTER (en = fn) AS exact_shape_matches, count(*) FILTER (en = fn) AS row_count_matches, count(f) AS column_count_matches, sum(en)::BIGINT AS expected_cells, (SELECT sum(n) FROM f)::BIGINT AS detected_cells FROM q),
      x AS (SELECT q.e, ec.r, ec.v FROM q JOIN ec ON ec.id = q.e), y AS (SELECT coalesce(q.e, -1 - fc.id) AS e, fc.r, fc.v FROM fc LEFT JOIN q ON q.f = fc.id),
      c AS (SELECT count(*) FILTER (x.v = y.v) AS exact_cell_matches, count(*) FILTER (trim(x.v) = trim(y.v)) AS normalized_cell_matches, count(*) FILTER (y.v IS NULL) AS missing_cells, count(*) FILTER (x.v IS NULL) AS extra_cells FROM x FULL JOIN y ON x.e = y.e AND x.r = y.r)
      SELECT * FROM t, c""",
    "cell_overlaps": SCORED + "SELECT ec.id, count(*) FILTER (ec.v = fc.v) AS overlap, greatest(max(ec.r), max(fc.r)) + 1 AS cells FROM ec LEFT JOIN fc ON fc.id = ec.id AND fc.r = ec.r GROUP BY 1",
    "half_sample": """
      WITH r AS (SELECT doc_id, quality, quality = 1 AS p, row_number() OVER (PARTITION BY quality = 1 ORDER BY doc_id) AS k FROM labels), n AS (SELECT least(10, count(*) FILTER (p)) AS a, least(count(*) FILTER (NOT p), 20 - least(10, count(*) FILTER (p))) AS b FROM r),
      t AS (SELECT doc_id, quality, CASE WHEN p AND k <= a THEN 0 WHEN NOT p AND k <= b THEN 1 WHEN p THEN 2 ELSE 3 END AS tier, k FROM r, n)
      SELECT doc_id, quality, place FROM (SELECT *, row_number() OVER (ORDER BY tier, k) AS place FROM t) WHERE place <= 20""",
    "rates": """SELECT user_id, round(CASE WHEN s > 0 THEN n / s ELSE 0 END, 6) AS files_s, round(CASE WHEN s > 0 THEN b / s ELSE 0 END, 6) AS bytes_s FROM (SELECT user_id, count(*) AS n, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END) AS b, CASE WHEN user_id % 4 = 0 THEN 0 ELSE round(avg(value), 3) END AS s FROM events GROUP BY 1)""",
    "corpus_distribution": f"SELECT class, count(*) AS documents, sum(pages)::BIGINT AS pages, min(pages) AS least, max(pages) AS most, string_agg(pages::VARCHAR, ',' ORDER BY pages) AS sizes FROM ({CLASSES}) GROUP BY 1",
    "run_rollup": statements("runs") + f", l AS (SELECT * FROM runs {NEWEST.format('file_id, route')}) SELECT route, count(*) AS files, min(started) AS first_start, max(finished) AS last_finish, count(*) FILTER (status = 'failed') AS failed FROM l GROUP BY 1",
    "first_reuse": """
      WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
      SELECT user_id, coalesce(min_by(event_id, n) FILTER (n > 1 AND event_type = 'error'), min_by(event_id, n)) AS event_id FROM n GROUP BY 1""",
    "text_excerpts": r"""
      WITH b AS (SELECT doc_id, text, encode(text) AS r, strlen(text) AS n FROM documents),
      p AS (SELECT *, [0, greatest(0, (n - 600) // 2), greatest(0, n - 600)] AS pos FROM b),
      h AS (SELECT *, list_transform(pos, lambda a: hex(r)[2 * a + 1:2 * a + 1200]) AS w FROM p),
      c AS (SELECT *, list_transform(w, lambda x: regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '(C[2-9A-F]|D[0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-4]([89AB][0-9A-F]){0,2})$', '')) AS v FROM h)
      SELECT doc_id, sha256(CASE WHEN n <= 3600 THEN text[1:900] ELSE array_to_string(list_transform(v, lambda x: decode(unhex(x))), E'\n...[deterministic excerpt boundary]...\n')[1:900] END) AS sha256 FROM c""",
    "safe_paths": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 >= 2 THEN 'dir/' || s_name END AS path FROM supplier",
    "safe_metadata": "SELECT n_nationkey, 'k,pathology' AS keys FROM nation",
    "evidence_snapshot": """
      WITH o AS (SELECT o_custkey AS run, o_orderkey AS place, o_orderstatus AS v FROM orders WHERE o_custkey < 40),
      m AS (SELECT run, place, 'e' || (place % 300) AS id, v FROM o), c AS (SELECT run, place, 'e' || (place % 90) AS id FROM o),
      k AS (SELECT id, min({'t': t, 'r': run, 'p': place}) AS k FROM (SELECT 0 AS t, run, place, id FROM c UNION ALL SELECT 1, run, place, id FROM m) GROUP BY 1),
      j AS (SELECT k.id, k.k, (SELECT v FROM m WHERE m.id = k.id ORDER BY run, place LIMIT 1) AS v FROM k WHERE k.id IN (SELECT id FROM m))
      SELECT id AS evidence_id, v AS value, row_number() OVER (ORDER BY k, id) AS place FROM j QUALIFY place <= 128""",
    "citations_outside": """
      WITH c AS (SELECT DISTINCT 't' || (event_id % 300) AS a, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS p, CASE WHEN event_id % 2 = 0 THEN '' END AS s FROM events),
      w AS (SELECT 't' || p_partkey AS a, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 END AS p FROM part)
      SELECT a AS asset_id, p AS page_number, coalesce(s, '-') AS sheet FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = c.a AND w.p IS NOT DISTINCT FROM c.p)""",
    "insight_contexts": statements("tables", "texts")
    + f""", b AS (SELECT file_id, '0' || asset_id AS place, text FROM texts UNION ALL SELECT file_id, '1' || asset_id, CASE WHEN {IS_CANDIDATE} THEN '[a candidate table; its cells are not confirmed]' ELSE 'rows ' || "rows" END FROM tables),
      u AS (SELECT *, 6000 - coalesce(sum(length(text)) OVER (PARTITION BY file_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, row_number() OVER (PARTITION BY file_id ORDER BY place) AS r FROM b)
      SELECT file_id, place, sha256(text[1:room::BIGINT]) AS sha256 FROM u WHERE room > 0 AND r <= 500""",
    "files_selected": statements("files") + "SELECT file_id, 'all' AS how FROM (SELECT * FROM files WHERE state = 'present' AND source_format <> 'png' ORDER BY relative_path, file_id LIMIT 1024) UNION ALL SELECT file_id, 'ids' FROM files WHERE state = 'present' AND file_id IN ('3', '17', '5')",
    "evidence_collected": statements("tables", "texts")
    + f""", r AS (SELECT 0 AS t, s_suppkey::VARCHAR AS file_id, 'file_insight' AS kind, NULL AS asset_id, s_name AS text FROM supplier WHERE s_suppkey % 4 = 0
      UNION ALL SELECT 1, file_id, 'text', asset_id, sha256(text) FROM texts WHERE page_number IS NULL UNION ALL SELECT CASE WHEN {IS_CANDIDATE} THEN 3 ELSE 2 END, file_id, CASE WHEN {IS_CANDIDATE} THEN 'table_candidate' ELSE 'table' END, asset_id, CASE WHEN NOT {IS_CANDIDATE} THEN quality END FROM tables)
      SELECT file_id, kind, asset_id, text, row_number() OVER (ORDER BY t, file_id, coalesce(asset_id, '')) AS place FROM r QUALIFY place <= 128""",
    "read_page_texts": BOXES + """SELECT page, sha256(string_agg(seq::VARCHAR, E'\\n\\n' ORDER BY y0, x0, seq)) AS sha256, round(avg(CASE WHEN seq % 3 > 0 THEN x0 / 100 END), 6) AS confidence, length(string_agg(seq::VARCHAR, E'\\n\\n')) AS chars, 'needs_review' AS quality FROM boxes WHERE seq % 7 > 0 GROUP BY 1""",
    "processing_policies": """
      WITH m AS (SELECT d, e FROM (SELECT unnest(['pdf', 'jpeg', 'png', 'xlsx', 'docx', 'pptx', 'zip', 'ole_compound', 'delimited_text', 'plain_text', 'html', 'unknown', 'odd']) AS d), (SELECT unnest(['.pdf', '.xlsx', '.docx', '.csv', '.tsv', '.xls', '.doc', '.txt', '.md', '.bin']) AS e)),
      f AS (SELECT *, CASE WHEN d IN ('pdf', 'jpeg', 'png') THEN d WHEN e = '.xlsx' AND d IN ('xlsx', 'zip', 'unknown') THEN 'xlsx' WHEN e = '.docx' AND d IN ('docx', 'zip', 'unknown', 'plain_text') THEN 'docx' WHEN d = 'pptx' THEN NULL
        WHEN e IN ('.csv', '.tsv') AND d IN ('delimited_text', 'plain_text', 'unknown') THEN e[2:] WHEN e = '.xls' AND d IN ('ole_compound', 'unknown', 'plain_text', 'zip') THEN 'xls' WHEN e = '.txt' AND d = 'plain_text' THEN 'txt' END AS f FROM m)
      SELECT d AS detected, e AS ext, CASE WHEN f IS NULL THEN 'unsupported' ELSE 'supported' END AS support, f AS source_format,
        CASE WHEN f IN ('pdf', 'jpeg', 'png', 'docx') THEN 'supported_' || f || '_table_and_text' WHEN f = 'txt' THEN 'supported_txt_text' WHEN f IS NOT NULL THEN 'supported_' || f || '_table' WHEN d = 'pptx' THEN 'deferred_pptx'
          WHEN d = 'ole_compound' THEN CASE e WHEN '.doc' THEN 'deferred_doc' ELSE 'unsupported_ambiguous_ole_container' END WHEN d = 'plain_text' THEN CASE e WHEN '.md' THEN 'unsupported_business_format' ELSE 'unsupported_plain_text_extension' END
          WHEN d IN ('zip', 'html', 'unknown') THEN 'unsupported_business_format' ELSE 'unsupported_unknown_type' END AS reason,
        CASE WHEN f IN ('pdf', 'jpeg', 'png') THEN 'xxxx' WHEN f = 'docx' THEN 'xx--' WHEN f = 'txt' THEN '-x--' WHEN f IS NULL THEN '----' ELSE 'x---' END AS tried FROM f""",
    "content_health": """
      WITH c AS (SELECT lang AS sheet, doc_id % 50 AS part, doc_id % 3 AS k, least(300, length(text)) AS n, length(text[1:300]) - length(replace(text[1:300], chr(10), '')) AS nl FROM documents),
      g AS (SELECT sheet, part, count(*) AS n_values, sum(n + CASE k WHEN 0 THEN 40 WHEN 1 THEN 3 ELSE 0 END)::BIGINT AS chars, sum(nl + CASE k WHEN 0 THEN 40 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS controls, sum(CASE k WHEN 0 THEN 40 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS unprintable, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::BIGINT AS replacement FROM c GROUP BY 1, 2)
      SELECT *, round((controls + unprintable + replacement) / chars, 4) AS bad_ratio, controls < 0.01 * chars AND (controls + unprintable + replacement) / chars < 0.15 AS valid FROM g""",
    "files_excluded": statements("files") + "SELECT file_id FROM files WHERE relative_path NOT LIKE 'dir1/%' AND relative_path NOT LIKE 'dir2/%' AND relative_path NOT LIKE '%.png'",
    "files_without_packages": """
      WITH p AS (SELECT DISTINCT 'd' || (s_suppkey % 3) || CASE s_suppkey % 5 WHEN 0 THEN '/[Content_Types].xml' WHEN 1 THEN '/xl/' || s_name ELSE 'x/' || s_name END AS path FROM supplier)
      SELECT path FROM p WHERE path NOT LIKE 'd1/xl/%' AND NOT (path[1:3] IN ('d0/', 'd2/') AND EXISTS (SELECT 1 FROM p z WHERE z.path = p.path[1:3] || '[Content_Types].xml') AND EXISTS (SELECT 1 FROM p z WHERE starts_with(z.path, p.path[1:3] || 'xl/')))""",
    "newest_records": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "stable_ids": """SELECT n_nationkey, 'tbl_' || sha256('{"n_regionkey":' || n_regionkey || ',"n_name":"' || n_name || '"}')[1:32] AS id FROM nation""",
    "sheet_orders": """SELECT p_partkey % 50 AS file, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY CASE WHEN p_size % 6 > 0 THEN p_size % 3 END NULLS LAST, p_size % 4, CASE WHEN p_size % 5 > 0 THEN p_size % 2 END NULLS LAST, p_brand, p_partkey) - 1 AS place FROM part""",
    "document_orders": "SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 > 0 THEN event_id % 20 END NULLS LAST, event_type = 'view', event_id) - 1 AS place FROM events",
    "insight_preview": registry(*ROLLUP, RECORDS.replace("WITH r AS", "rec AS", 1).split("\nl AS")[0].rstrip().rstrip(","))
    + """, lr AS (SELECT file_id, content, state FROM rec QUALIFY row_number() OVER (PARTITION BY file_id, content ORDER BY t0 DESC) = 1)
      SELECT count(*) AS ready, count(*) FILTER (lr.state = 'completed') AS cached, count(*) FILTER (lr.state IN ('queued', 'running')) AS active, count(*) - count(*) FILTER (lr.state IN ('completed', 'queued', 'running')) AS pending
      FROM rollup f LEFT JOIN lr ON lr.file_id = f.file_id AND lr.content = f.sha256 WHERE processing_status = 'ready' AND sha256 IS NOT NULL""",
    "file_details": registry(*ROLLUP)
    + """, b AS (SELECT asset_id, page_number, text, 12000 - coalesce(sum(length(text)) OVER (ORDER BY page_number NULLS LAST, asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM texts WHERE file_id = '3' AND is_current),
      k AS (SELECT 'text' AS kind, asset_id, page_number, sha256(text[1:room::BIGINT]) AS text_sha256 FROM b WHERE room > 0 UNION ALL SELECT 'table', asset_id, page_number, NULL FROM tables WHERE file_id = '3' AND is_current)
      SELECT file_id, processing_status, kind, asset_id, page_number, text_sha256 FROM (SELECT file_id, processing_status FROM rollup WHERE file_id = '3') LEFT JOIN k ON true""",
    "reprocess_checks": statements("files") + "SELECT file_id, CASE WHEN state <> 'present' THEN 'missing' WHEN file_id LIKE '%7' THEN 'outside_root' WHEN file_id LIKE '%4' THEN 'content_changed' END AS refusal FROM files",
    "search_counts": registry(VIEW[0], names=("files", "tables", "texts", "cleaning", "issues", "semantic")) + "SELECT count(*) FILTER (asset_type = 'table') AS tables, count(*) FILTER (asset_type = 'text') AS texts, (SELECT count(*) FROM chunks) AS chunks FROM assets",
    "asset_selection": statements("tables")
    + f""", g AS (SELECT asset_id FROM tables WHERE quality = 'pass' AND NOT {IS_CANDIDATE} ORDER BY asset_id DESC LIMIT 3)
      SELECT 0::BIGINT AS request, string_agg(asset_id, ',' ORDER BY asset_id DESC) AS answer FROM g UNION ALL SELECT * FROM (VALUES (1, 'duplicate_asset_id'), (2, 'table_asset_not_trusted'), (3, 'table_asset_not_found'), (4, 'assets_required'), (5, 'invalid_asset_id'), (6, 'too_many_assets'))""",
    "page_consistency": SCORED + "SELECT page, count(*) = count(f) AS count_equal, count(*) FILTER (en = fn) AS shapes_equal FROM (SELECT e.page, p.* FROM p JOIN e ON e.id = p.e) GROUP BY 1",
    "task_progress": "SELECT n_nationkey, round(CASE WHEN n_regionkey = 0 THEN 1.0 ELSE least(1.0, n_nationkey / (n_regionkey * 5)) END, 6) AS progress FROM nation",
    "layout_upgrade": "SELECT *, 'native' AS r_source, 0::BIGINT AS r_rank FROM region",
}
ORACLES["processing_counts_fallback"] = ORACLES["processing_counts"].replace("pic AS (SELECT * FROM own WHERE route IN ('ocr_rapidocr', 'vision_llm') QUALIFY row_number() OVER (PARTITION BY file_id, content ORDER BY ", "pic AS (SELECT * FROM own WHERE route IN ('ocr_rapidocr', 'vision_llm') QUALIFY row_number() OVER (PARTITION BY file_id, content ORDER BY route = 'vision_llm' DESC, ")
