"""The `documents` format: units of files, filters before files are opened, parts by size, a stream that is resumed."""

import os
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.sources import datasource, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet(*rows):
    return f"<worksheet {S}><sheetData>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("first line\nsecond\n" * 400 + "the end")
    (tmp_path / "b.md").write_bytes("标题\n正文".encode("gbk"))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,4\n5,6\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="{R}"><sheets><sheet name="Late" r:id="r2"/><sheet name="Early" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(["name", "n"], ["apple", "7"]))
        z.writestr("xl/worksheets/sheet2.xml", sheet(["only"]))
    (tmp_path / "f.docx").write_bytes(b"no archive")
    (tmp_path / "g.png").write_bytes(b"\x89PNG")
    (tmp_path / "h.TXT").write_text("")
    (tmp_path / "i.bin").write_bytes(b"x")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "j.txt").write_text("deep")
    return tmp_path


def read(spark, path, **options):
    datasource.register(spark)
    return spark.read.format("documents").options(**options).load(str(path))


def rows_of(df):
    out = {}
    for r in df.orderBy("path", "number").collect():
        out.setdefault(os.path.basename(r.path), []).append(r)
    return out


def test_units(spark, folder):
    got = rows_of(read(spark, folder, blockBytes="1000", blockRows="2"))
    assert set(got) == {"a.txt", "b.md", "c.csv", "d.docx", "e.xlsx", "f.docx", "g.png"}  # an empty file has no unit
    assert "".join(r.text for r in got["a.txt"]) == (folder / "a.txt").read_text() and len(got["a.txt"]) > 5
    assert all(r.text.endswith("\n") for r in got["a.txt"][:-1]) and [r.number for r in got["a.txt"]] == list(range(1, len(got["a.txt"]) + 1))
    assert "".join(r.text for r in got["b.md"]) == "标题\n正文"
    assert [(r.unit, r.text.split()) for r in got["c.csv"]] == [("rows", ["x", "y", "1", "2", "3", "4"]), ("rows", ["x", "y", "5", "6"])]
    assert [(r.unit, r.text) for r in got["d.docx"]] == [("paragraph", "One"), ("paragraph", "Two"), ("table", "k | v")]
    assert [(r.unit, r.name) for r in got["e.xlsx"]] == [("sheet", "Late"), ("sheet", "Early")]
    assert got["e.xlsx"][1].text == files.parse_xlsx((folder / "e.xlsx").read_bytes()) and "apple" in got["e.xlsx"][1].text
    assert got["f.docx"][0].error and got["f.docx"][0].text is None and got["f.docx"][0].unit is None
    assert got["g.png"][0].error == "ValueError: no OCR function is given"
    seen = rows_of(read(spark, folder, ocr="builtins:repr", recursive="true"))
    assert seen["g.png"][0].text == repr(b"\x89PNG") and seen["j.txt"][0].text == "deep" and ".hidden.txt" not in seen
    assert files.parse_docx((folder / "d.docx").read_bytes()) == "\n\n".join(r.text for r in got["d.docx"])


def test_filters_choose_files(spark, folder):
    df = read(spark, folder).filter(F.col("suffix").isin(".txt", ".md", ".docx") & (F.col("size") <= 100) & (F.col("unit") == "block"))
    assert list(rows_of(df)) == ["b.md"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    after = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert not any("suffix" in x or "size" in x for x in after) and any("unit" in x for x in after), plan
    reader = datasource.Reader({"path": str(folder)})
    left = list(reader.pushFilters([datasource.ds.EqualTo(("suffix",), ".csv"), datasource.ds.IsNotNull(("size",)), datasource.ds.EqualTo(("text",), "x"), datasource.ds.GreaterThan(("size",), 3)]))
    assert left == [datasource.ds.EqualTo(("text",), "x")] and [os.path.basename(f.path) for b in reader.partitions() for f in b.files] == ["c.csv"]
    assert read(spark, folder).filter("size > 1000000000").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        read(spark, folder / "none").count()


def test_parts_by_size():
    made = datasource.bins([datasource.Found(str(i), ".txt", n, 0) for i, n in enumerate([1, 1, 50_000, 9_000, 1, 8_000])], 20_000)
    assert [[f.path for f in b.files] for b in made] == [["0", "1"], ["2"], ["3", "4"], ["5"]] and datasource.bins([], 10) == []


@given(st.text(max_size=200), st.integers(1, 40), st.sampled_from(["utf-8", "gbk"]))
def test_blocks_join_to_the_text(text, block, encoding):
    import io

    data = text.encode(encoding, "ignore")
    assert "".join(datasource.text_blocks(lambda: io.BytesIO(data), block)) == files.decode(data)


def test_stream_goes_on(spark, folder, tmp_path_factory):
    """Two runs with one checkpoint: each file once, then only what is new."""
    datasource.register(spark)
    out, checkpoint = (str(tmp_path_factory.mktemp(n)) for n in ("out", "checkpoint"))

    def run():
        s = spark.readStream.format("documents").option("settle", "0").load(str(folder)).filter("suffix = '.txt'").select("path", "number", "text")
        s.writeStream.option("checkpointLocation", checkpoint).trigger(once=True).format("parquet").start(out).awaitTermination()
        return sorted({os.path.basename(r.path) for r in spark.read.parquet(out).collect()}), spark.read.parquet(out).count()

    assert run() == (["a.txt"], 1)
    (folder / "k.txt").write_text("new")
    assert run() == (["a.txt", "k.txt"], 2)
    assert run() == (["a.txt", "k.txt"], 2)
