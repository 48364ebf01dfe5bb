"""Files as documents: text, CSV, DOCX and XLSX read from bytes with the standard library, inside tasks."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which reader takes a file.
FAMILIES = {"pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "sheet", "xls": "sheet", "csv": "sheet", "jpg": "image", "jpeg": "image", "png": "image", "webp": "image", "txt": "text", "md": "text"}
CSV_ENCODINGS = ["utf-8-sig", "gbk", "gb2312", "utf-8"]
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def family(path: Column) -> Column:
    """The reader of a file by its extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(extension == e, f) for e, f in FAMILIES.items()])


def pdf_route(chars_per_page: Column) -> Column:
    """Fewer than 100 characters a page go to the vision model, 2000 or more are text, others go to the layout model."""
    return F.when(chars_per_page < 100, "vision").when(chars_per_page >= 2000, "text").otherwise("layout")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, family, file_hash, content) of every file under a path that Spark can read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", family(F.col("path")).alias("family"), F.sha2("content", 256).alias("file_hash"), "content")


def docx_markdown(data: bytes) -> str:
    """Headings as ``#``, paragraphs, then all tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    out, tables = [], []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_WORD}p" and text(e).strip():
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            m = re.match(r"[Hh]eading\s*(\d)", style.get(f"{_WORD}val", "") if style is not None else "")
            out.append(("#" * int(m[1]) + " " if m else "") + text(e))
        elif e.tag == f"{_WORD}tbl":
            tables.append([[text(c).strip() for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")])
    for i, rows in enumerate(tables, 1):
        out.append(f"## Table {i}\n" + "\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + "---|" * len(rows[0])] + ["| " + " | ".join(r) + " |" for r in rows[1:]]))
    return "\n\n".join(out)


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet, rows) with every cell as text; the top left cell of a merged range keeps its value."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = links[s.get(f"{_REL}id")].lstrip("/")
        rows: list[list[str | None]] = []
        for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            row: list[str | None] = []
            for c in r.iter(f"{_SHEET}c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(row)
                row += [None] * (at - len(row))
                v, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                value = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else v.text if v is not None else None
                row.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
            rows.append(row)
        out.append((s.get("name"), rows))
    return out


def csv_rows(data: bytes) -> list[list[str]]:
    """Rows of the first encoding that decodes the bytes; the last resort replaces what it can't."""
    for e in CSV_ENCODINGS:
        try:
            return list(csv.reader(io.StringIO(data.decode(e))))
        except UnicodeDecodeError:
            continue
    return list(csv.reader(io.StringIO(data.decode("utf-8", "replace"))))


def plain_text(data: bytes) -> str:
    """Lines of three characters or more that are mostly printable, in the first encoding with over ten CJK characters."""
    wide = lambda s: sum("一" <= c <= "鿿" for c in s)
    for e in ("utf-8", "utf-16-le", "gbk", "gb2312", "big5"):
        text = data.decode(e, "ignore")
        if wide(text) > 10:
            lines = [x.strip() for x in text.splitlines()]
            return "\n".join(x for x in lines if len(x) >= 3 and (sum(c.isprintable() for c in x) / len(x) > 0.6 or wide(x) > 5))
    return data.decode("utf-8", "replace")


def parsed(files: DataFrame) -> DataFrame:
    """(path, sheet, text): the text of text and DOCX files, and each sheet of tables as Markdown. A bad file gives its
    name and null text, so that one file does not end a job; PDF and image files need a model and are left to a seam."""

    def markdown(rows: list[list]) -> str:
        rows = [r for r in rows if any(c not in (None, "") for c in r)]
        if not rows:
            return ""
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join("" if c is None else str(c) for c in [*r, *[None] * (width - len(r))]) + " |"
        return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    if kind == "docx":
                        out.append((path, None, docx_markdown(data)))
                    elif kind == "sheet" and path.lower().endswith(".csv"):
                        out.append((path, None, markdown(csv_rows(data))))
                    elif kind == "sheet":
                        out += [(path, name, markdown(rows)) for name, rows in xlsx_sheets(data)]
                    elif kind == "doc":
                        out.append((path, None, plain_text(data)))
                    else:
                        out.append((path, None, data.decode("utf-8")))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError):
                    out.append((path, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["path", "sheet", "text"])

    return files.where(F.col("family").isin("text", "docx", "doc", "sheet")).select("path", "family", "content").mapInArrow(run, "path string, sheet string, text string")


def duplicates(files: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, original): files whose content came earlier, by order of key."""
    first = files.groupBy(digest).agg(F.min(key).alias("original"))
    return files.join(first, digest).where(F.col(key) != F.col("original")).select(key, "original")
