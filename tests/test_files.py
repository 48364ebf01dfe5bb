"""Files on disk and streams."""

import zipfile

from pyspark.sql import functions as F

from docloom.sources import files
from docloom.streaming import incremental

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi\nthere")
    (tmp_path / "copy.md").write_text("# hi\nthere")
    (tmp_path / "t.csv").write_bytes("名,n\n甲,1\n".encode("gbk"))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.bin").write_bytes(b"1")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} {R}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    read = files.read_files(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.sheet): r.text for r in files.parsed(read).collect()}
    assert got[("a.md", None)] == "# hi\nthere" and got[("bad.docx", None)] is None
    assert got[("d.docx", None)] == "## Title\n\nBody\n\n## Table 1\n| c |\n|---|"
    assert got[("s.xlsx", "One")].startswith("| head |  | 5 |")
    assert "甲" in got[("t.csv", None)]
    assert files.duplicates(read, "path", "file_hash").count() == 1
    assert read.where("family IS NULL").count() == 1


def test_incremental(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    step = lambda d: d.select("doc_id", F.upper("text").alias("text"))
    rows.coalesce(1).write.parquet(source)
    incremental.compile_incrementally(spark, source, rows.schema, step, out, cp, "doc_id").awaitTermination()
    spark.createDataFrame([(2, "again"), (3, "c"), (3, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    incremental.compile_incrementally(spark, source, rows.schema, step, out, cp, "doc_id").awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_stream_windows(spark, tmp_path):
    from conftest import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, incremental.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))
