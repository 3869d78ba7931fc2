"""Files of several formats, and whole-text cleaning."""

import io
import zipfile

import pytest

from ferrule.functions.clean import clean_text
from ferrule.operators import answers, evaluate, ingest
from ferrule.sources import parse

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def document():
    p = lambda t, style="": f"<w:p>{style and f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>'}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    return archive({"word/document.xml": f"<w:document {W}><w:body>{p('before')}{p('Rules', 'Heading1')}{p('one')}{p('two')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>{p('Empty', 'Heading2')}</w:body></w:document>"})


def workbook():
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    return archive({"xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
                    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
                    "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/s.xml": sheet})


def test_office_files():
    assert parse.segments("a.docx", document()) == [("正文", "before", "text"), ("Rules", "one\ntwo", "text"), ("Rules", "| a | b |\n| --- | --- |\n| 1 | 2 |", "table")]
    assert parse.segments("a.xlsx", workbook()) == [("One", "| head | | 7 |\n| --- | --- | --- |\n| | x | |", "table")]
    for name in ("a.docx", "a.xlsx"):
        with pytest.raises(ValueError):
            parse.segments(name, b"no archive")
    with pytest.raises(ValueError):
        parse.segments("a.docx", archive({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"}))


def test_read_files(spark, tmp_path):
    for name, raw in (("a.docx", document()), ("b.md", b"x\n  ## Head\nbody"), ("c.txt", b"  "), ("d.pdf", b"%PDF"), ("e.csv", b"h,i\n1,2\n")):
        (tmp_path / name).write_bytes(raw)
    rows = parse.read_files(spark, str(tmp_path), "http://x").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5:], []).append((r.section, r.content_type, r.source_url, r.error is None))
    assert by["/b.md"] == [("正文", "text", "http://x", True), ("Head", "text", "http://x", True)] and "c.txt" not in by
    assert len(by[".docx"]) == 3 and by["d.pdf"] == [(None, None, "http://x", False)] and by["e.csv"][0][1] == "table"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in parse.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]


def test_clean_text():
    assert clean_text("ＡＢ１，２\r\n\r\n\r\nCopyright 2020\n\x07x  y\n") == "AB1，2\n\nx y"
    long = "A line that is long enough"
    assert clean_text(f"{long}\n{long.upper()}\nshort\nshort") == f"{long}\nshort\nshort"
    assert clean_text(f"{long}\n{long}", deduplicate=False) == f"{long}\n{long}"
    assert clean_text(None) == clean_text("") == ""


def test_moves_that_are_not_allowed_are_refused(spark):
    moves = [("a", 1, "queued"), ("a", 2, "ready"), ("a", 3, "parsing"), ("b", 1, "parsing"), ("c", 1, None)]
    df = spark.createDataFrame(moves, "job_id string, at long, to_status string").selectExpr("job_id", "timestamp_seconds(at) as at", "to_status")
    got = {(r.job_id, r.to_status): r.status for r in ingest.advanced(df).collect()}
    assert got == {("a", "queued"): "queued", ("a", "ready"): "queued", ("a", "parsing"): "parsing", ("b", "parsing"): "uploaded", ("c", None): "uploaded"}
    assert ingest.advanced(df.limit(0)).count() == 0


def test_model_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('so: {"score": 4.5} ok',), ("none",), (None,), ('{"score": "x"}',)], "t string")
    assert [r.n for r in df.select(answers.json_number(F.col("t"), "score").alias("n")).collect()] == [4.5, None, None, None]
    assert [r.n for r in df.select(answers.has_shape(F.col("t"), "score double").alias("n")).collect()] == [False, False, False, False]


def test_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0), ("b", None)], "k string, v double")
    assert {r.k: r.v for r in evaluate.percentile(df, "k", "v", 0.95).collect()} == {"a": 19.0, "b": 5.0}
