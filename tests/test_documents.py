"""Document readers, sinks, evidence and layout on small inputs."""

import io
import zipfile

import pytest

from sievework.operators import evidence, layout
from sievework.sources import documents, sinks


def word_file(body):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_word_files(spark, tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>".format
    body = f"<w:p>{run('Hello')}{run(' world')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p></w:tc><w:tc><w:p>{run('b')}</w:p></w:tc></w:tr></w:tbl><w:p>{run('end')}</w:p>"
    (tmp_path / "a.docx").write_bytes(word_file(body))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.docx").write_bytes(word_file(""))
    found = documents.blocks(spark, str(tmp_path), "docx")
    assert sorted({(r.path.rsplit("/", 1)[1], r.status) for r in found.collect()}) == [("a.docx", "ok"), ("b.docx", "corrupt"), ("c.docx", "empty")]
    rows = documents.with_offsets(found.where("status = 'ok'")).orderBy("sequence").collect()
    assert [(r.kind, r.text, r.start, r.end) for r in rows] == [("paragraph", "Hello world", 0, 11), ("row", "a\tb", 12, 15), ("paragraph", "end", 16, 19)]
    whole = documents.joined_text(found).first()
    assert whole.text == "Hello world\na\tb\nend" and whole.text[12:15] == "a\tb"


def test_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿héllo".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xff\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in documents.blocks(spark, str(tmp_path), "txt").collect()}
    assert got == {"a.txt": ("ok", "héllo"), "b.txt": ("ok", "中文"), "c.txt": ("undecodable", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.append_history(df, str(tmp_path / "h"), "r1")
    sinks.append_history(df.limit(1), str(tmp_path / "h"), "r1")
    sinks.append_history(df, str(tmp_path / "h"), "r2")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3
    sinks.write_artifact(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_artifact(df, str(tmp_path / "x"))
    ids = [r[0] for r in df.select(sinks.stable_id("tbl_", "k", "v")).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)
    facts = [{"text": "1 < 2", "evidence": ["e1"]}]
    assert sinks.markdown("T", facts) == "# T\n\n- 1 < 2 (e1)\n" and "1 &lt; 2" in sinks.html_page("T", facts)


def test_actions_and_analysis():
    steps = iter([{"action": "search", "query": "x"}, {"action": "final", "findings": [{"evidence": ["e1"]}, {"evidence": ["e9"]}, {"evidence": []}, {"evidence": ["e1"], "status": "unconfirmed"}]}])
    found, status = evidence.run_analysis(lambda seen: next(steps), {"search": lambda a: ("hit", ["e1"])})
    assert found == [{"evidence": ["e1"]}] and status == "completed"
    assert evidence.run_analysis(lambda seen: {"action": "search", "query": "x"}, {"search": lambda a: (None, [])}) == ([], "insufficient_evidence")
    for bad in ({"action": "drop"}, {"action": "search"}, {"action": "search", "query": " "}, {"action": "sql", "sql": "x", "asset_ids": ["a", "a"]}):
        with pytest.raises(evidence.ActionRefused):
            evidence.checked_action(bad)


def test_lines_and_repeats(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 10.0, "a"), (1, 1, 6.0, 1.0, 9.0, 11.0, "b"), (1, 2, 0.0, 20.0, 5.0, 30.0, "c")], "page int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(r.line_text for r in layout.join_lines(words, "page", "seq").collect()) == ["a b", "c"]
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "x y"), (1, 1, 0.0, 0.0, 10.0, 10.1, "x y"), (1, 2, 0.0, 0.0, 10.0, 10.0, "other"), (1, 3, None, None, None, None, "x y")], "img int, k int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(r.k for r in layout.drop_repeats(boxes, "img", "k").collect()) == [0, 2, 3]
