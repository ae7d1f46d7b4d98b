"""Descriptions, evidence, reports, isolated statements, tasks and files: what has no table to be checked against."""

import io
import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.operators import evidence, safe_sql, semantic, tables
from sievework.sources import documents, files, sinks
from sievework.streaming import ingest

GOOD = {"display_name": "Sales", "category": "data", "description": "d", "keywords": ["a"], "summary": "s", "confidence": 0.5}
FIELD = {"source_column": "x", "semantic_name": "X", "description": "d", "semantic_type": "text", "unit": None, "aliases": [], "confidence": 1}


def test_descriptions_are_checked():
    table = GOOD | {"semantic_fields": [FIELD]}
    assert semantic.checked_description(json.dumps(GOOD), "text").value and semantic.checked_description(table, "table", ["x"]).value
    twice = semantic.checked_description(GOOD | {"semantic_fields": [FIELD, FIELD]}, "table", ["x"])
    assert twice.value and len(twice.warnings) == 2
    bad = [GOOD | {"more": 1}, {k: v for k, v in GOOD.items() if k != "summary"}, GOOD | {"summary": " "}, GOOD | {"confidence": 1.2}, GOOD | {"confidence": True}, GOOD | {"keywords": "a"}, GOOD | {"quality_suggestions": [{"issue_type": "x"}]}, "[]", "{", 3]
    assert all(semantic.checked_description(b, "text").value is None for b in bad)
    assert semantic.checked_description(table, "table", ["y"]).value is None
    assert semantic.checked_description(GOOD, "table", ["x"]).value is None


def test_descriptions_are_used_again(spark):
    df = spark.createDataFrame([(i, "v" * 500, i % 70) for i in range(200)], "k long, x string, y long")
    ref = semantic.table_reference({"asset_id": "t1", "name": "T"}, df, "k", [{"detected_by": "semantic"}, {"detected_by": "rules"}])
    assert 6 <= len(ref["rows"]) <= 18 and ref["row_count"] == 200 and len(ref["issues"]) == 1 and len(ref["rows"][0]["x"]) == semantic.CELL_CHARS
    request = semantic.request_for("table", ref, "hash", "describe")
    known = {}
    answer, again = semantic.describe(request, semantic.StaticModel(), ["x", "y"], known.get)
    assert answer.value and not again
    known[semantic.identity(request, "static")] = answer.value
    assert semantic.describe(request, semantic.StaticModel(), ["x", "y"], known.get)[1]
    assert semantic.identity(request, "static") != semantic.identity(request | {"version": "2"}, "static")

    class Broken:
        name = "broken"

        def describe(self, request):
            raise OSError

    assert semantic.describe(request, Broken(), ["x"])[0].errors == ["model: OSError"]


def test_references_fit():
    big = {"asset_id": "t", "name": "n", "rows": [{"c": "x" * 5000}] * 50, "profile": ["p" * 900] * 400, "columns": ["c"] * 900}
    for most in (48 * 1024, 9000, 3000, 60, 2):
        ref, less = semantic.fitted(big, most)
        assert less and len(json.dumps(ref, separators=(",", ":")).encode()) <= most
    assert semantic.fitted({"a": 1}) == ({"a": 1}, False)


def test_read_pages_are_checked(spark):
    page = {"page_type": "table", "title": "", "useful_text": [{"text": "a", "role": "body"}], "tables": [{"title": "", "columns": ["a", "b"], "rows": [[1, None], ["x", 2.5]]}]}
    assert semantic.checked_page(page).value
    for change in ({"page_type": "odd"}, {"title": "x" * 2001}, {"useful_text": [{"text": "a", "role": "odd"}]}, {"tables": [{"title": "", "columns": ["a"], "rows": [[1, 2]]}]}, {"tables": [{"title": "", "columns": ["a"], "rows": [[float("nan")]]}]}, {"confidence": 2}, {"more": 1}):
        assert semantic.checked_page(page | change).value is None

    class Reader:
        def read(self, content):
            return {"blocks": [(w, (0.0, float(i), 9.0, i + 1.0), 0.5 + i / 10) for i, w in enumerate(content.decode().split())]}

    df = spark.createDataFrame([("a", 1, b"two words"), ("a", 2, b"\xff"), ("b", 1, b"")], "path string, page long, content binary")
    blocks = semantic.read_pages(df, Reader())
    assert {(r.path, r.page, r.status) for r in blocks.collect()} == {("a", 1, "ok"), ("a", 2, "failed: UnicodeDecodeError"), ("b", 1, "empty")}
    assert [(r.text, r.confidence, r.quality) for r in semantic.page_texts(blocks).collect()] == [("two\n\nwords", 0.55, "needs_review")]


def test_confidences_add_up_in_order_of_blocks(spark):
    rng = random.Random(1)
    sure = [rng.randint(0, 96) / 100 for _ in range(32)]
    rows = [("a", 1, i, "x", 0.0, float(i), 1.0, i + 1.0, c, "ok") for i, c in enumerate(sure)]
    shape = "path string, page long, block long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, status string"
    got = {semantic.page_texts(spark.createDataFrame(r, shape)).first().confidence for r in (rows, rows[::-1], [(*r[:5], -r[5], *r[6:]) for r in rows])}
    assert got == {0.415312}


def test_reports_fall_back():
    known = {"e1": {"kind": "text", "text": "t", "api_key": "s", "source": {"fileId": "f"}}, "e2": {"kind": "table", "rows": [{"a": 1}] * 200, "columns": ["a"]}}
    shown = evidence.projected(known)
    assert "api_key" not in shown[0] and len(shown[1]["rows"]) == 100
    findings = [{"statement": "s1", "evidence_ids": ["e1", "e9"]}, {"statement": "s2", "evidence_ids": ["e9"]}]
    own, origin = evidence.report("T", ["answer"], findings, ["fact"], known)
    assert origin == "deterministic" and own["key_findings"] == [{"statement": "s1", "evidence_ids": ["e1"]}] and own["limitations"] == ["unconfirmed: s2"]
    assert evidence.report("T", [], findings, [], known, lambda _: own)[1] == "model"
    forged = own | {"key_findings": [{"statement": "s", "evidence_ids": ["e9"]}]}
    for bad in (forged, own | {"more": 1}, {}, None):
        assert evidence.report("T", [], findings, [], known, lambda _, bad=bad: bad)[1] == "deterministic"
    large = evidence.projected({f"e{i}": {"text": "x" * 4000, "kind": "text"} for i in range(128)})
    assert all(len(e["snippet"]) == 500 and "text" not in e for e in large)


def test_models_see_bounded_values():
    value = {"Secret-Key": 1, "path": 2, "a": [{"b": "x" * 9000}] * 300, "n": float("nan"), "r": b"ab", "d": {"d": {"d": {"d": {"d": {"d": {"d": 1}}}}}}}
    out = evidence.bounded(value)
    assert set(out) == {"a", "n", "r", "d"} and len(out["a"]) == 128 and len(out["a"][0]["b"]) == 4000 and out["n"] is None and out["r"] == "6162"
    assert "[nested value omitted]" in json.dumps(out["d"])
    repeated = evidence.without_repeats([{"source": {"fileId": 1, "x": 2}, "text": "t", "snippet": "t", "rows": [{"a": 1}, {"a": 1}]}, {"source": {"fileId": 1, "x": 2}}])
    assert repeated == [{"source": {"fileId": 1, "x": 2}, "text": "t", "rows": [{"a": 1}]}, {"source": {"fileId": 1}}]
    assert len(evidence.model_reference([{"action": "sql", "text": "x"}] * 200)) == 96
    assert evidence.model_reference([{"action": "sql", "text": "x" * 4000}] * 96)[0] == {"action": "sql", "truncated": True}
    assert evidence.statistics_text({"rows": None}) == ([], ["no table to count"])
    found, lacking = evidence.statistics_text({"rows": {"n": 3}, "category": {"value": "a", "frequency": 2}})
    assert len(found) == 2 and lacking == ["no numeric column", "no column of time"]
    assert len(evidence.all_facts("T", {"row_count": 1, "column_count": 1, "null_count": 2, "empty_cell_ratio": 0.5, "duplicate_rows": 2}, [{"column_name": "c", "mean_value": 1, "min_value": 1, "max_value": 1}], {"value": "a", "frequency": 1})) == 5
    assert evidence.stored_name("run_0123456789ab")
    with pytest.raises(ValueError, match="id"):
        evidence.stored_name("../run_0123456789ab")


def test_statements_run_in_a_session_of_their_own(spark):
    spark.range(3).createOrReplaceTempView("t1")
    other = spark.range(9).selectExpr("id as x", "cast(null as double) as y").where("x >= 0")
    assert safe_sql.query({"t1": other, "t2": other}, "SELECT count(*) AS n FROM t1 JOIN t2 USING (x)").first().n == 9
    assert spark.table("t1").count() == 3
    with pytest.raises(safe_sql.SqlRefused) as e:
        safe_sql.query({"t9": other}, "SELECT * FROM t1")
    assert e.value.code == "unknown_relation"
    assert safe_sql.schema({"t1": other})["relations"][0]["columns"] == [{"name": "x", "type": "bigint"}, {"name": "y", "type": "double"}]


def test_statements_are_stopped_in_time(spark):
    df = spark.range(100_000).repartition(4)
    began = time.time()
    with pytest.raises(safe_sql.SqlRefused) as e:
        safe_sql.execute({"t1": df, "t2": df}, "SELECT count(*) FROM t1 JOIN t2 ON t1.id * 7 % 1013 < t2.id * 3 % 1019", timeout_s=2, max_input_rows=None)
    assert e.value.code == "query_timeout" and time.time() - began < 30
    assert safe_sql.execute({"t1": df}, "SELECT 1 AS one FROM t1", max_input_rows=10, counts={"t1": 5})[1]


def test_responses_are_bounded():
    import datetime
    from decimal import Decimal

    rows = [(i, "x" * 100) for i in range(100)]
    out = safe_sql.response(rows, False, 1000)
    assert out["truncated"] and 0 < len(out["rows"]) < 10
    with pytest.raises(safe_sql.SqlRefused):
        safe_sql.response([("x" * 2000,)], False, 1000)
    assert safe_sql.response([], False) == {"rows": [], "truncated": False}
    assert safe_sql.json_safe([Decimal("1.50"), datetime.date(2024, 1, 2), b"a", float("inf"), 2.5, "y" * 10_001]) == ["1.50", "2024-01-02", "61", None, 2.5, "y" * 10_000 + "\u2026"]


def test_tasks_end_once():
    task, stop = ingest.Task(), ingest.Cancellation()
    done = []
    assert task.run([lambda: done.append(1), stop.request, lambda: done.append(2)], stop) == "cancelled"
    assert done == [1] and not task.move("running") and task.state == "cancelled" and task.done == 2
    assert ingest.Task().run([lambda: 1 / 0], ingest.Cancellation()) == "failed"
    assert ingest.Task().run([], ingest.Cancellation()) == "succeeded"
    assert ingest.first_then(100) == [16, 32, 32, 20] and ingest.first_then(0) == [] and ingest.first_then(5) == [5]


def test_broken_files_stop_no_stream(spark, tmp_path):
    src, out, ck = (tmp_path / x for x in ("in", "out", "ck"))
    src.mkdir()
    (src / "a.txt").write_text("A text that is long enough to be ready.")
    (src / "b.txt").write_bytes(b"\xff\xfe\x00broken")
    for _ in range(2):  # the second run has nothing to do
        ingest.ingest_files(spark, str(src), str(out), str(ck)).awaitTermination()
    rows = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in spark.read.parquet(str(out)).collect()}
    assert rows == {"a.txt": ("ready", None), "b.txt": ("failed", "undecodable")}


def test_discovery(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "l").symlink_to(tmp_path / "d")
    (tmp_path / "p.html").write_text("<p>no</p><HTML>")
    (tmp_path / "j.json").write_text("[1]")
    (tmp_path / "f.bin").write_bytes(bytes(range(256)))
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("[Content_Types].xml", "")
        z.writestr("word/document.xml", "")
    (tmp_path / "c.xlsx").write_bytes(b"PK\x03\x04broken")
    assert set(files.discover(str(tmp_path))) == {("d/a.csv", "file", None), ("l", "skipped", "symlink"), *((n, "file", None) for n in ("p.html", "j.json", "f.bin", "w.docx", "c.xlsx"))}
    got = {r.path.rsplit("/", 1)[1]: (r.detected, r.support, r.reason) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got["a.csv"] == ("delimited_text", "supported", "supported_csv_table") and got["p.html"][0] == "html" and got["j.json"][0] == "json" and got["f.bin"][0] == "unknown"
    assert got["w.docx"] == ("docx", "supported", "supported_docx_table_and_text") and got["c.xlsx"] == ("zip", "supported", "supported_xlsx_table")
    assert files.inventory(spark, str(tmp_path), ["[dl]/*", "*.html"]).count() == 4
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1)], "path string, size int, modified int")
    assert files.changed_while_read(a, a.withColumn("size", F.when(F.col("path") == "x", 2).otherwise(1))).first().issue == "changed_during_scan"


def test_merged_cells_of_documents(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    start, more, two = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    rows = [cell("a", start) + cell("b", two), cell("", more) + cell("c") + cell("d"), cell("e") + cell("f") + cell("g")]
    body = f"<w:document {ns}><w:body><w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {(r.row, r.col, r.row_span, r.column_span, r.value) for r in documents.word_table_cells(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b"), (1, 1, 1, 1, "c"), (1, 2, 1, 1, "d"), (2, 0, 1, 1, "e"), (2, 1, 1, 1, "f"), (2, 2, 1, 1, "g")}
    whole, issues = documents.text_assets(documents.blocks(spark, str(tmp_path), "docx"))
    assert whole.count() == 1 and [r.issue for r in issues.collect()] == ["corrupt"]


def test_layout_of_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"><alignment horizontal="center"/></xf></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><cols><col min="1" max="2" width="9.5"/></cols><sheetData><row r="1" ht="20" hidden="1"><c r="B1" s="1"><f>A1*2</f><v>4</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    row = files.workbook_layout(spark, str(tmp_path)).first()
    assert (row.sheet, row.merged, row.hidden_rows, row.row_heights, row.column_widths) == ("One", ["A1:B2"], [1], {1: 20.0}, {1: 9.5, 2: 9.5})
    assert [tuple(c) for c in row.cells] == [(0, 1, "0.0%", "center", "A1*2")]


def test_regions_are_published(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, v) for r, row in enumerate([["Name", "name", None], ["a", "1", "x"], ["b", "2", None]], 3) for c, v in enumerate(row, 1) if v], "row long, col long, value string")
    meta = sinks.publish_region(cells, {"row_start": 3, "row_end": 6, "column_start": 1, "column_end": 4, "header": True, "warnings": ["possible_title_row"]}, str(tmp_path))
    out = spark.read.parquet(f"{tmp_path}/normalized").orderBy("row")
    assert out.columns == ["row", "Name", "name__2", "column_0003"] and [tuple(r) for r in out.collect()] == [(4, "a", "1", "x"), (5, "b", "2", None)]
    assert meta["status"] == "review" and meta["first_data_row"] == 4 and spark.read.parquet(f"{tmp_path}/raw").count() == 3
    with pytest.raises(ValueError, match="newer"):
        sinks.upgraded(cells, 9, {}, 3)
    sinks.write_result({"runs": cells.limit(1), "assets": cells}, str(tmp_path / "h"), "r1")
    sinks.write_result({"runs": cells.limit(1), "assets": cells.limit(2)}, str(tmp_path / "h"), "r1")
    assert spark.read.parquet(f"{tmp_path}/h/assets").count() == 2
    assert tables.with_headers(cells, [{"normalized": "row", "original": "Row"}, {"normalized": "col", "original": "row"}]).columns == ["Row", "row (2)", "value"]
