import random

from pyspark.sql import functions as F

from sparkloom.sources import layout
from sparkloom.sources.layout import Word, find_tables, page_text


def line(text, x, top, size=10.0, bold=False):
    out = []
    for w in text.split(" "):
        out.append(Word(w, float(x), float(x + 5 * len(w)), float(top), float(top + size), float(size), bold))
        x += 5 * len(w) + 4
    return out


def two_columns():
    words = line("A Title Over Both Columns Of This Page Which Is Quite Long Really Yes", 40, 20, 16)
    for i in range(6):
        words += line(f"left words {i}", 180, 60 + 14 * i) + line(f"right words {i}", 340, 60 + 14 * i)
    return words


def table():
    words = line("Some words before the table.", 40, 20)
    for i, row in enumerate([("Name", "Rent", "Due"), ("Ann Lee", "100", "May"), ("Bo", "2500", "June"), ("Nakamura", "30", "July")]):
        for x, cell in zip((40, 200, 330), row):
            words += line(cell, x, 60 + 14 * i)
    return words + line("Some words after it.", 40, 200)


def frame(spark, words, page=0, doc="d"):
    return spark.createDataFrame([(doc, page, *w, 600.0) for w in words], "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean, width double")


def test_columns_headings_and_order(spark):
    text = page_text(two_columns(), 600.0).split("\n")
    assert text[0].startswith("# A Title") and text[1:7] == [f"left words {i}" for i in range(6)] and text[7:] == [f"right words {i}" for i in range(6)]
    words = frame(spark, two_columns())
    found = layout.in_reading_order(layout.lines(words)).join(layout.body_sizes(layout.lines(words)), ["doc_id", "page"])
    found = found.withColumn("h", layout.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body"))).orderBy("place").collect()
    assert [("# " if x.h else "") + x.text for x in found] == text and {x.body for x in found} == {10.0}
    assert [r.text for r in layout.layout(words).collect()] == ["\n".join(text)]


def test_tables_without_rules_and_the_words_they_may_not_lose(spark):
    text = page_text(table(), 600.0)
    assert "| Name | Rent | Due |\n| --- | --- | --- |\n| Ann Lee | 100 | May |" in text and text.index("before") < text.index("| Name") < text.index("after")
    r = random.Random(1)
    prose = [w for i in range(8) for w in [*line("some words that run on here", 40, 20 + 14 * i), *line("and others over there as well", 230, 20 + 14 * i), *line("with a third column of them", 420, 20 + 14 * i)]]
    assert find_tables(prose) == []
    ragged = [w for i in range(8) for x in (40, 200, 330) for w in line("ab", x + r.uniform(-60, 60), 20 + 14 * i)]
    assert len(find_tables(ragged)) <= 1
    raw = " ".join(w.text for w in table())
    pages = spark.createDataFrame([("d", 0, raw, text), ("d", 1, "a a b", "a b")], "doc_id string, page int, raw string, rendered string")
    assert {(x.page, round(x.share, 6)) for x in layout.lost_words(pages).collect()} == {(0, 0.0), (1, 0.333333)}


def test_recognition_and_forms(spark):
    df = spark.createDataFrame([(" ", "seen text here", ["a", "b"], [("N", "1"), ("M", None)]), ("a page with text enough for all", "x", [], [("N", "1")]), ("short", None, ["a"], [])], "page string, seen string, pages array<string>, fields array<struct<name string, value string>>")
    got = df.select(layout.with_recognised(F.col("page"), F.col("seen")).alias("t"), layout.with_form_fields(F.col("pages"), F.col("fields")).alias("f")).collect()
    assert [x.t for x in got] == ["seen text here", "a page with text enough for all", "short"]
    assert [x.f for x in got] == [["a", "b\n\n## Form fields\n\n- **N:** 1"], ["## Form fields\n\n- **N:** 1"], ["a"]]
    assert layout.recognised_text([(2, 0, "b", 0.9), (1, 5, "a2", 0.6), (1, 0, "a1", 0.8), (3, 0, "no", 0.2)]) == "a1\na2\nb"
