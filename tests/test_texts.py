"""Text functions, model replies, files."""

import io
import zipfile

from pyspark.sql import functions as F

from larkspur.functions import scalars, text
from larkspur.sources import files, tables


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_trim_and_fold(spark):
    assert one(spark, text.full_trim, " \t x y \r\n﻿") == "x y"
    assert one(spark, text.ascii_fold, "ÉAb") == "Éab"
    assert one(spark, lambda x: text.contains_fold(x, "O_D W"), "cold widget") is True
    assert one(spark, lambda x: text.contains_fold(x, "\\"), "a\\b") is True
    assert one(spark, text.comma_list, " a, ,b ,") == ["a", "b"]
    assert one(spark, text.lines, "a\r\nb\rc\n") == ["a", "b", "c", ""]


def test_html(spark):
    cases = {
        "<p>a<br>b</p>": "ab",
        "a<br>b<BR/>c": "a\nb\nc",
        "<h1> T <b>x</b></h1><h2>s</h2><p>1</p><p>2</p>": "# T x\n\ns\n1\n2",
        "<table><tr><td><p>a</p><p>b</p></td><td>c</td></tr></table>": "ab\nc",
        "x &amp;lt; y&nbsp;&quot;&#39;": "x < y \"'",
        "<ul><li>a</li><li>b</li></ul>": "ab",
        "<pre>x</pre>y</p>z": "xy\nz",
        "<script>var t = 1</script>ok": "var t = 1ok",
        "a<br><br><br><br>b": "a\n\nb",
        "": "",
    }
    for html, want in cases.items():
        assert one(spark, text.html_to_text, html) == want, html
    assert one(spark, text.html_to_text, None) is None


def test_split_documents(spark):
    assert one(spark, text.split_documents, "pre\n# a\nx\n#no\n## b\n# c") == ["# a\nx\n#no\n## b", "# c"]
    assert one(spark, text.split_documents, "nothing") == []
    assert one(spark, text.split_documents, "# only") == ["# only"]


def test_tolerant_json(spark):
    good = '{"a": {"b": 1}}'
    for reply in (good, f"<think>{{no}}</think>{good}", f"```json\n{good}\n```", f"Sure! {good} Bye."):
        assert one(spark, lambda x: F.get_json_object(text.tolerant_json(x), "$.a.b"), reply) == "1", reply
    for reply in ("{broken", "", "no braces", None, "[1]"):
        assert one(spark, text.tolerant_json, reply) is None, reply


def test_handoff(spark):
    block = "x <done>\n- **learned:** a b\n- **next**: c\n</done>"
    assert one(spark, lambda x: text.handoff_fields(x, "done"), block) == {"learned": "a b", "next": "c"}
    assert one(spark, lambda x: text.handoff_fields(x, "other"), block) is None


def test_bands(spark):
    scores = spark.createDataFrame([(s,) for s in (-1, 0, 34, 35, 69, 70, 100, 101)], "s int")
    assert [r[0] for r in scores.select(scalars.verdict(F.col("s"))).collect()] == [None, "unc", "unc", "mid", "mid", "bussin", "bussin", None]
    stages = spark.createDataFrame([(s,) for s in (1, 2, 3, 7, 8)], "s int").select(scalars.route(F.col("s"))).collect()
    assert [r[0] for r in stages] == ["safe", "safe", "spouse_warning", "spouse_warning", "friend_intervention"]


def docx(paragraphs):
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>" if h else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for h, t in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.docx").write_bytes(docx([(True, "Title"), (False, "line")]))
    (tmp_path / "in" / "b.docx").write_bytes(b"broken")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    got = {r.path.rpartition("/")[2]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "# Title\nline", "b.docx": None}
    (tmp_path / "n.csv").write_text(" Name ,Sugar \nx, 3.5\ny,none\nz,\n")
    rows = files.read_numbers_csv(spark, str(tmp_path / "n.csv"), ["Sugar"]).collect()
    assert [(r.Name, r.Sugar) for r in rows] == [("x", 3.5), ("y", 0.0), ("z", 0.0)]
    found = files.content_by_label(spark.createDataFrame([("A",), ("q",)], "mood string"), files.find_files(spark, str(tmp_path)), "mood").collect()
    assert {r.mood: r.file_content is not None for r in found} == {"A": True, "q": False}


def test_catalogue_round_trip(spark, tmp_path):
    folder = str(tmp_path / "cat")
    empty = tables.open_catalogue(spark, folder)
    assert set(empty) == set(tables.SCHEMAS) and all(t.count() == 0 for t in empty.values())
    tags = spark.createDataFrame([(1, "Rock", "Genre", None)], tables.SCHEMAS["tags"])
    tables.write_snapshot({"tags": tags}, folder)
    tables.append_log(tables.empty_table(spark, "import_log"), folder)
    again = tables.open_catalogue(spark, folder)
    assert tables.first_row(again["tags"])["name"] == "Rock" and tables.first_row(again["songs"]) is None
