import io
import zipfile

from pyspark.sql import functions as F

from sparkloom.operators.store import VersionedTable
from sparkloom.sources import clean, loaders
from sparkloom.streaming import ingest


def test_html():
    text, title = loaders.parse_html("<html><head><title>T</title></head><body><nav>no</nav><h1>Head</h1><p>a <b>b</b>c</p><ul><li>x</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1|2</td><td>3</td></tr></table><script>no()</script></body></html>")
    assert title == "T" and text == "# Head\n\na bc\n\n- x\n\n| k | v |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert loaders.parse_html(None) == ("", None)


def test_csv_and_text():
    assert loaders.load_csv("﻿a;b\n1;2\n".encode())[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert loaders.load_text(b"# Top\n\nbody \xff") == ("# Top\n\nbody �", "Top")


def test_docx():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    assert loaders.load_docx(raw.getvalue()) == ("# Head\n\nBody", "Head")


def test_discover_and_load(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    for name, body in {"a.md": "# A\n\ntext", "b.txt": "b", "~$c.docx": "x", ".hidden/d.txt": "x", "e.bin": "x", "bad.docx": "not a zip", "skip.txt": "x"}.items():
        (tmp_path / name).write_text(body)
    files = loaders.discover(spark, str(tmp_path), exclude=("skip*",))
    docs = {r.rel: r for r in loaders.load(files).collect()}
    assert set(docs) == {"a.md", "b.txt", "bad.docx"}
    assert docs["a.md"].title == "A" and docs["bad.docx"].error and docs["bad.docx"].text is None


def test_repeated_lines_go(spark):
    pages = "\f".join(f"Company report\nbody {'abcdef'[i]} stays\nPage {i}" for i in range(5))
    got = clean.strip_repeated_lines(spark.createDataFrame([(1, pages), (2, "one page\nonly")], "id int, text string"))
    out = {r.id: r.text for r in got.collect()}
    assert "Company report" not in out[1] and "Page" not in out[1] and out[1].count("stays") == 5 and out[2] == "one page\nonly"


def test_headings(spark):
    text = "1.2 Scope\nSECTION II general\nALL CAPS LINE\nplain text.\n"
    assert spark.range(1).select(clean.promote_headings(F.lit(text)).alias("t")).first().t == "### 1.2 Scope\n## SECTION II general\n## ALL CAPS LINE\nplain text.\n"


def test_streamed_files_are_ingested_once(spark, tmp_path):
    landing, index = tmp_path / "in", VersionedTable(spark, str(tmp_path / "index"), "id string, doc_id string, ordinal int, text string, heading_path string, heading string, context string, page int, page_end int, parent_id string, parent_text string")
    landing.mkdir()
    for k, name in enumerate(["a.md", "b.md"]):
        (landing / name).write_text(f"# H{k}\n\nbody {k}")
        ingest.ingest(spark, ingest.read_files(spark, str(landing)), index, str(tmp_path / "cp")).awaitTermination()
        assert index.read().count() == k + 1
