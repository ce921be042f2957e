"""Files as sources: folders of documents, word-processor files, CSV with untidy headers."""

from __future__ import annotations

import html
import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number_or_zero
from ..functions.text import html_to_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def find_files(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """Files under the folder, with content, but for editors' temporary ones (``~$``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


#: Styles of paragraphs that become headings of these levels, and what else is known.
_HEADINGS, _PLAIN = {f"heading{n}": n for n in (1, 2, 3)}, ("", "normal", "listparagraph", "title", "bodytext")


def docx_html(data: bytes) -> tuple[str | None, list[str]]:
    """The body of a word-processor file as HTML, and warnings; null for a file that cannot be read.

    Read element by element, so only the open paragraph and cell are held beside
    the result. Headings 1 to 3, paragraphs, list items, tables, tabs and breaks
    are kept; paragraphs without text are not. Other styles are paragraphs, with a
    warning, and so are pictures left out.
    """
    out: list[str] = []
    warnings: list[str] = []
    text: list[str] = []
    style, listed = "", False
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open("word/document.xml") as body:
            for event, e in ElementTree.iterparse(body, events=("start", "end")):
                tag = e.tag.removeprefix(_W)
                if event == "start":
                    if tag == "p":
                        text, style, listed = [], "", False
                    elif tag in ("tbl", "tr", "tc"):
                        out.append({"tbl": "<table>", "tr": "<tr>", "tc": "<td>"}[tag])
                    continue
                if tag == "pStyle":
                    style = e.get(f"{_W}val", "")
                elif tag == "numPr":
                    listed = True
                elif tag == "t":
                    text.append(html.escape(e.text or "", quote=False))
                elif tag == "tab":
                    text.append("\t")
                elif tag in ("br", "cr"):
                    text.append("<br />")
                elif tag in ("drawing", "pict"):
                    warnings.append("a picture was left out")
                elif tag == "p":
                    level = _HEADINGS.get(style.lower().replace(" ", ""))
                    if level is None and style.lower().replace(" ", "") not in _PLAIN:
                        warnings.append(f"no style is known as {style}")
                    name = f"h{level}" if level else "li" if listed else "p"
                    if text:
                        out.append(f"<{name}>{''.join(text)}</{name}>")
                    e.clear()
                elif tag in ("tbl", "tr", "tc"):
                    out.append({"tbl": "</table>", "tr": "</tr>", "tc": "</td>"}[tag])
                    e.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as e:
        return None, [f"not a word-processor file: {type(e).__name__}"]
    return "".join(out), warnings


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """path, html, warnings and text of every word-processor file under the folder; a broken file has null html and text and a warning."""

    @F.arrow_udf("html string, warnings array<string>")
    def read(content: pa.Array) -> pa.Array:
        pages = [docx_html(c.as_py()) for c in content]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in pages], pa.string()), pa.array([w for _, w in pages], pa.list_(pa.string()))], ["html", "warnings"])

    return find_files(spark, folder).select("path", read("content").alias("_page")).select("path", "_page.html", "_page.warnings", html_to_text(F.col("_page.html")).alias("text"))


def read_numbers_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV file whose headers are trimmed and whose ``numbers`` columns are numbers, 0 where they are none."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.withColumns({c: number_or_zero(F.col(c)) for c in numbers})


def write_files(spark: SparkSession, folder: str, named: dict[str, bytes]) -> None:
    """Writes a few small files by name, wherever the folder is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in named.items():
        out = fs.create(at(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()


def docx(parts: list[tuple[str, str | None] | list[list[str]]]) -> bytes:
    """A word-processor file of (text, style) paragraphs and tables (rows of cells)."""
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")

    def paragraph(at: ElementTree.Element, text: str, style: str | None) -> None:
        p = ElementTree.SubElement(at, f"{_W}p")
        if style:
            ElementTree.SubElement(ElementTree.SubElement(p, f"{_W}pPr"), f"{_W}pStyle", {f"{_W}val": style})
        run = ElementTree.SubElement(p, f"{_W}r")
        for i, part in enumerate(text.split("\t")):
            if i:
                ElementTree.SubElement(run, f"{_W}tab")
            ElementTree.SubElement(run, f"{_W}t").text = part

    for part in parts:
        if isinstance(part, list):
            table = ElementTree.SubElement(body, f"{_W}tbl")
            for row in part:
                at = ElementTree.SubElement(table, f"{_W}tr")
                for cell in row:
                    paragraph(ElementTree.SubElement(at, f"{_W}tc"), cell, None)
        else:
            paragraph(body, *part)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root))
    return data.getvalue()


def content_by_label(labels: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """The content of the file named like each label in lower case, else null."""
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("_name"), F.col("content").alias("file_content"))
    return labels.join(named, F.lower(labels[label]) == named["_name"], "left").drop("_name")
