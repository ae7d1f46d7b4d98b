"""Edge cases of the research-data operators."""

import io
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.functions.inference import infer_types, typed
from sievework.operators import chunking, history, profiling, safe_sql
from sievework.sources import files
from sievework.streaming import ingest


def test_cell_tokens_and_space(spark):
    df = spark.createDataFrame([("　a ",), ("N/a",), ("  ",), ("x\r\ny",), ("-",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.cell(F.col("v"))).collect()] == ["a", None, None, "x\ny", "-", None]


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("plain",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.nfc(F.col("v"))).collect()] == ["é", "plain", None]


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["true", "FALSE"], "boolean_candidate"),
        (["1", "-2", None], "integer"),
        (["01", "2"], "string"),
        (["12345678"], "string"),
        (["1.5", "2"], "float_candidate"),
        (["1d"], "string"),
        (["2024-02-29", "2024/1/2"], "date"),
        (["2024-02-30"], "string"),
        (["2024-01-02 03:04", "2024-01-02T03:04:05.5"], "string"),
        (["2024-01-02 03:04", "2024/1/2T3:4"], "datetime"),
        (["2024-01-02 03:04:05", "2024-01-02T03:04:05.5", "2024-01-02 03:04:05.123456789"], "datetime"),
        ([None, None], "string"),
        ([], "string"),
    ],
)
def test_inference(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer_types(df).first().inferred == kind
    assert typed(df).count() == len(values)


def test_chunks_cut_after_newlines(spark):
    text = "a" * 1500 + "\n" + "b" * 3000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.chunks(df, "doc_id").orderBy("chunk").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 1501), (1501, 3501), (3501, 4501)]
    assert "".join(r.chunk_text for r in rows) == text


def test_latest_and_changes(spark):
    runs = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, 5), (2, 4, None)], "k int, id int, t int")
    got = history.latest_by(runs, ["k"], [F.desc_nulls_last("t"), F.desc("id")])
    assert sorted((r.k, r.id) for r in got.collect()) == [(1, 3), (2, 4)]
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, m int")
    b = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 4)], "k int, m int")
    got = {r.k: r.change for r in history.classify_changes(a, b, "k", ["m"]).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "new"}


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert sorted(r.is_duplicate for r in profiling.duplicate_marks(df).collect()) == [False, True, True]


def test_safe_sql(spark):
    df = spark.range(600).withColumnRenamed("id", "x")
    rows, more = safe_sql.execute({"t1": df}, "SELECT x FROM t1 ORDER BY x")
    assert len(rows) == 500 and more and rows[0].x == 0
    rows, more = safe_sql.execute({"t1": df}, "WITH a AS (SELECT x FROM t1), b AS (SELECT x FROM a) SELECT count(*) AS n FROM b;")
    assert rows[0].n == 600 and not more
    with pytest.raises(safe_sql.SqlRefused) as e:
        safe_sql.execute({"t1": df}, "SELECT 1", max_input_rows=10)
    assert e.value.code == "input_rows_too_large"
    with pytest.raises(safe_sql.SqlRefused) as e:
        safe_sql.validate(spark, "SELECT * FROM t1 WHERE x IN (SELECT y FROM elsewhere)", {"t1"})
    assert e.value.code == "unknown_relation"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,X,y\n1,"a, b",2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("x,y\n1\n")
    (tmp_path / "c.csv").write_bytes("名,y\n中,1\n".encode("gb18030"))
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("x,y\n\n1,2\n")
    (tmp_path / "f.csv").write_text("\nx,y\n")
    rows = files.delimited(spark, str(tmp_path))
    status = {r.path.rsplit("/", 1)[1]: r.status for r in rows.collect()}
    assert {k: v for k, v in status.items() if k != "d.csv"} == {"a.csv": "ok", "b.csv": "ragged", "c.csv": "ok", "e.csv": "ragged", "f.csv": "no_header"}
    path = next(r.path for r in rows.collect() if r.path.endswith("a.csv"))
    got = files.as_table(rows, path)
    assert got.columns == ["x", "X__2", "y"] and tuple(got.first()) == ("1", "a, b", "2")
    kinds = {r.path.rsplit("/", 1)[1]: (r.detected, r.route) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert kinds["a.csv"] == ("delimited_text", "table") and kinds["c.csv"] == ("unknown", "table")


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    got = {(r.status, r.sheet, r.row, r.col, r.value) for r in files.workbook_cells(spark, str(tmp_path)).collect()}
    assert got == {("ok", "sheet1", 2, 2, "hello"), ("ok", "sheet1", 2, 27, "7"), ("corrupt", None, None, None, None)}


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = "doc_id long, text string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n, rows in enumerate([[(1, "a \r\nb")], [(1, "new text that is long enough"), (2, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(spark, src, schema, out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == [1, 3][n]
    got = {r.doc_id: r.status for r in ingest.latest_state(spark, out, "doc_id").collect()}
    assert got == {1: "ready", 2: "unusable"}


def test_folding_and_normal_form(spark):
    texts = ["Cafe\u0301", "STRASSE \u00df \u0130", "\ufb01x", "plain", "", None, "\u1100\u1161"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(tx.nfc(F.col("v")).alias("n"), tx.folded(F.col("v")).alias("f")).collect()
    import unicodedata

    nfc = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [r.n for r in got] == nfc and [r.f for r in got] == [None if t is None else t.casefold() for t in nfc]
    assert "Python" not in df.select(tx.folded(F.col("v")))._jdf.queryExecution().executedPlan().toString()


def test_search_requests(spark):
    from sievework.operators import search

    assert search.Request("  Cafe\u0301 ", source_format=" CSV ").checked() == search.Request("Caf\u00e9", source_format="csv")
    for bad in ({"query": "x" * 513}, {"query": "a\0b"}, {"query": "a", "limit": 0}, {"query": "a", "offset": -1}, {"query": "a", "mode": "any"}, {"query": "a", "file_id": " "}, {"query": "a", "quality": "good"}):
        with pytest.raises(search.SearchRefused):
            search.Request(**bad).checked()
    assets = spark.createDataFrame(
        [("t1", "table", "1", "ready", "sheet", "native", "csv", "Stra\u00dfe 1"), ("t2", "table", "1", "needs_review", "sheet", "native", "csv", "strasse"), ("t3", "table", "1", "ready", "page", "native", "pdf", "strasse"), ("t4", "table", "1", "unusable", "page", "native", "pdf", "strasse")],
        "asset_id string, asset_type string, file_id string, quality_status string, source_kind string, extractor string, source_format string, effective_display_name string",
    )
    found = lambda **k: {r.asset_id: r.match_kind for r in search.ranked(assets, None, search.Request("STRASSE", **k)).collect()}
    assert found() == {"t1": "effective_display_name_contains"}
    assert found(quality="needs_review") == {"t2": "effective_display_name_exact"} and found(quality="unusable").keys() == {"t4"}
    assert search.ranked(assets, None, search.Request(" ")).count() == 0


def test_snippets_start_where_the_text_does(spark):
    from sievework.operators import search

    text = "Stra\u00dfe \ufb01n \U0001d11e " + "x " * 200 + "the " + "y " * 300
    cases = ((text, "the", text.index("the")), ("\u00df\u00df stra\u00dfe", "strasse", 3), ("a\u0301 the", "the", 2), ("\u00dft", "st", 0), ("\u00dft", "\u00df", 0))
    for value, query, start in cases:
        hit = search.with_snippets(spark.createDataFrame([(value,)], "v string"), "v", query, "all").first()
        composed = unicodedata.normalize("NFC", value)
        begin = max(0, min(len(composed), max(0, start - 166) + 500) - 500)
        assert hit.start == start and hit.snippet.strip("\u2026") == composed[begin : begin + 500]


def test_occurrences_do_not_overlap(spark):
    from sievework.operators import search

    df = spark.createDataFrame([("a", 2, "s", 0, "aXaaXaa\\Eaa"), ("a", None, None, 0, "aa"), ("b", 1, None, 0, None)], "asset_id string, page long, section string, block int, text string")
    got = [(r.asset_id, r.page, r.start, r.occurrence) for r in search.text_occurrences(df, "aa").orderBy("occurrence").collect()]
    assert got == [("a", 2, 2, 0), ("a", 2, 5, 1), ("a", 2, 9, 2), ("a", None, 0, 3)]
    assert search.text_occurrences(df, "\\E").count() == 1


def test_confidences_of_a_table_add_up_in_order(spark):
    from sievework.operators import layout

    cells = spark.createDataFrame([(1, r, "x") for r in (0, 0, 1, 1)], "t int, row int, value string")
    sure = [0.0, 0.9, 1.0, 0.7]
    for values, low in ((sure, True), (sure[::-1], False)):  # 2.5999999999999996 and 2.6
        rows = [(1, i, c) for i, c in enumerate(values)]
        for dealt in (rows, rows[::-1]):
            blocks = spark.createDataFrame(dealt, "t int, place int, confidence double").coalesce(1)
            assert ("low_ocr_confidence" in layout.table_flags(cells, ["t"], blocks).first().flags) == low


def test_clean_tables(spark):
    from sievework.operators import tables

    rows = [(1, " a ", "1", None), (2, "a", "1", " "), (3, " ", "n/a", None), (4, "b", "2", "null"), (5, "a", "1", None)]
    df = spark.createDataFrame(rows, "k int, x string, y string, z string")
    out = tables.clean_table(df, ["Name", "name ", None], "k", drop_duplicates=True)
    assert sorted(map(tuple, out.table.collect())) == [(1, "a", 1), (4, "b", 2)] and out.table.columns == ["k", "Name", "name__2"]
    counts = {a["type"]: a["count"] for a in out.actions}
    assert counts["mark_exact_duplicate_rows"] == out.duplicate_rows == 3 and counts["drop_exact_duplicate_rows"] == 2
    assert counts["trim_empty_rows"] == 1 and counts["trim_empty_columns"] == 1 and out.empty_columns_before == ["column_0003"]
    assert tables.clean_table(df.limit(0), order="k").table.count() == 0
    assert tables.clean_table(df.select("k"), order="k").table.columns == ["k"]
    done, issues = tables.clean_each({"good": df, "bad": None})
    assert set(done) == {"good"} and [i["asset_id"] for i in issues] == ["bad"]


def test_ranks_against_sorted_values(spark):
    import random

    rng = random.Random(3)
    for values in ([5.0], [2.0, 2.0, 2.0, 9.0], [rng.choice([rng.random(), 0.5]) for _ in range(3001)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = {r.share: r.value for r in profiling.nearest_rank(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()}
        assert got == {s: sorted(values)[round((len(values) - 1) * s)] for s in (0.0, 0.5, 0.9, 1.0)}
    assert profiling.nearest_rank(df.limit(0), "v", [0.5]).count() == 0
    small = spark.createDataFrame([(i, "x") for i in range(10)], "k long, v string")
    assert profiling.head_middle_tail(small, "k").count() == 10 and profiling.head_middle_tail(small.limit(0), "k").count() == 0


def test_failures_retire_for_good(spark):
    runs = [(1, 1, "A", True), (1, 2, "B", False), (1, 3, "A", False), (2, 1, "A", True), (2, 2, "A", False), (3, 1, "A", True), (3, 2, "B", True), (3, 3, "A", False)]
    df = spark.createDataFrame(runs, "k int, t int, content string, ok boolean")
    got = history.current_flags(df, ["k"], "content", "ok", [F.desc("t")]).where("is_current").collect()
    assert {(r.k, r.t) for r in got} == {(2, 1)}


def test_profiles_of_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a string, b double")
    got = {r.column_name: r for r in profiling.column_profile(df).collect()}
    assert not got["a"].constant and got["a"].n_null == 2 and got["b"].median_value == 2.0 and not got["b"].constant
    assert profiling.column_profile(df.limit(0)).count() == 0


def test_tables_match_in_order(spark):
    """Against the greedy rule: by page and index, the first free candidate wins."""
    import random

    rng = random.Random(4)
    e = [(i, rng.randint(1, 4), rng.choice([None, None, 1, 2, 3])) for i in range(40)]
    e = [x for k, x in enumerate(e) if x[2] is None or (x[1], x[2]) not in {(y[1], y[2]) for y in e[:k]}]
    f = [(100 + 10 * page + idx, page, idx) for page in range(1, 5) for idx in range(1, rng.randint(2, 6))]
    free, want = sorted(f, key=lambda x: (x[1], x[2])), set()
    for i, page, idx in sorted(e, key=lambda x: (x[1], x[2] or 0, x[0])):
        hit = next((c for c in free if c[1] == page and idx in (None, c[2])), None)
        if hit:
            free.remove(hit)
            want.add((i, hit[0]))
    kind = "id long, page long, idx long"
    got = {(r.e_id, r.f_id) for r in profiling.match_tables(spark.createDataFrame(e, kind), spark.createDataFrame(f, kind)).collect()}
    assert got == want
