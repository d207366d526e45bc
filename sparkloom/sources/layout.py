"""Pages as words with positions, to text in reading order with headings and tables.

Lines, headings and order are expressions over a table of words (doc_id, page, text, x0, x1, top, bottom,
size, bold, width; points, from the upper left corner). Tables without rules are found page by page, as a
page is bounded; page_texts() does all for the pages of one file, layout() for a table of words."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loaders import markdown_table

# fixed values: points, ratios and counts that decide what a page looks like
COLUMN_GAP, MIDDLE_SLACK, MIDDLE_MARGIN = 30.0, 60.0, 18.0
CELL_GAP, CELL_EDGE, TABLE_ROWS, TABLE_COLUMNS, TABLE_SHARE = 15.0, 6.0, 3, 3, 0.6
PROSE_WORDS, PROSE_SHARE, MAX_LOST = 5, 0.6, 0.02
LARGER, AS_LARGE, HEADING_CHARS, BLANK_CHARS = 1.15, 0.95, 90, 20


# -- expressions

def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, top, x0, x1, text, size, bold, width): words of one height are a line; a line whose
    widest gap is a column's and lies about the middle of the page is two."""
    row = Window.partitionBy("doc_id", "page", "row").orderBy("x0")
    w = words.withColumn("row", F.round("top")).withColumn("gap", F.col("x0") - F.lag("x1").over(row)).withColumn("mid", (F.col("x0") + F.lag("x1").over(row)) / 2)
    widest = F.max(F.struct("gap", -F.col("x0"))).over(Window.partitionBy("doc_id", "page", "row"))
    here = (F.struct("gap", -F.col("x0")) == widest) & (F.col("gap") >= COLUMN_GAP) & (F.abs(F.col("mid") - F.col("width") / 2) <= MIDDLE_SLACK)
    w = w.withColumn("cut", F.coalesce(here, F.lit(False)).cast("int")).withColumn("part", F.sum("cut").over(row))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("doc_id", "page", "row", "part").agg(
        F.min("top").alias("top"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"), F.percentile("size", F.lit(0.5)).alias("size"), (F.avg(F.col("bold").cast("int")) > 0.5).alias("bold"), F.max("width").alias("width")
    ).drop("row", "part")


def body_sizes(lines_: DataFrame) -> DataFrame:
    """(doc_id, page, body): the most common size of a page's lines, to half a point; of equals the smallest."""
    sizes = lines_.where("size > 0").groupBy("doc_id", "page", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("doc_id", "page").agg((-F.max(F.struct("n", -F.col("s")))["col2"]).alias("body"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Larger than the page's body text, or bold and about as large; short, of two words at least, no sentence."""
    s = F.trim(text)
    fit = (F.length(s) <= HEADING_CHARS) & ~s.rlike("[.:,]$") & (F.size(F.split(s, r"\s+")) >= 2) & (s != "")
    return fit & (F.coalesce(body, F.lit(0.0)) > 0) & ((size >= body * LARGER) | (bold & (size >= body * AS_LARGE)))


def in_reading_order(lines_: DataFrame) -> DataFrame:
    """lines with place, their number on the page. A page counts as two columns if it has six lines, three on
    either side of the middle, and at most half across it; then a line across ends both columns before it."""
    page = Window.partitionBy("doc_id", "page")
    mid = F.col("width") / 2
    side = F.when(F.col("x1") <= mid + MIDDLE_MARGIN, 1).when(F.col("x0") >= mid - MIDDLE_MARGIN, 2).otherwise(0)
    x = lines_.withColumn("side", side)
    n = lambda k: F.count_if(F.col("side") == k).over(page)
    all_ = F.count(F.lit(1)).over(page)
    x = x.withColumn("two", (all_ >= 6) & (n(1) >= 3) & (n(2) >= 3) & (n(0) <= all_ * 0.5))
    above = F.sum((F.col("side") == 0).cast("int")).over(page.orderBy("top", "x0"))
    x = x.withColumn("block", F.when(F.col("two"), above).otherwise(0)).withColumn("column", F.when(F.col("two"), F.col("side")).otherwise(0))
    return x.withColumn("place", F.row_number().over(page.orderBy("block", "column", "top", "x0"))).drop("side", "two", "block", "column")


def lost_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page, share): of the words of a page, as a bag, what its rendered text lacks.
    pages: (doc_id, page, raw, rendered), both texts."""
    bag = lambda c: pages.select("doc_id", "page", F.explode(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^\s|]+)"), F.lit(1))).alias("w")).groupBy("doc_id", "page", "w").agg(F.count(F.lit(1)).alias("n"))
    both = bag("raw").join(bag("rendered").withColumnRenamed("n", "m"), ["doc_id", "page", "w"], "left")
    return both.groupBy("doc_id", "page").agg((F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("share"))


# -- page by page

class Word(NamedTuple):
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    size: float = 0.0
    bold: bool = False


def _cells(row: list[Word]) -> list[list[Word]]:
    cells = [[row[0]]]
    for a, b in zip(row, row[1:]):
        if b.x0 - a.x1 >= CELL_GAP:
            cells.append([])
        cells[-1].append(b)
    return cells


def _aligned(rows: list[list[list[Word]]]) -> bool:
    """Whether enough rows have three edges (left, right or middle) in common places."""
    need = max(TABLE_ROWS, int(np.ceil(len(rows) * TABLE_SHARE)))
    spots = lambda f: [{int(round(f(c) / CELL_EDGE)) for c in row} for row in rows]
    for hits in (spots(lambda c: c[0].x0), spots(lambda c: c[-1].x1), spots(lambda c: (c[0].x0 + c[-1].x1) / 2)):
        near = Counter(s for row in hits for s in {t + d for t in row for d in (0, 1)})  # an edge counts for two places side by side
        if sum(n >= need for n in near.values()) >= 2 * TABLE_COLUMNS:
            return True
    return False


def find_tables(words: list[Word]) -> list[tuple[tuple[float, float, float, float], list[list[str]]]]:
    """((x0, top, x1, bottom), cells) of tables without rules: rows under each other of three cells or more
    whose edges stand in line, unless most cells are as long as running text."""
    rows: dict[int, list[Word]] = {}
    for w in words:
        rows.setdefault(round(w.top), []).append(w)
    cut = [_cells(sorted(rows[t], key=lambda w: w.x0)) for t in sorted(rows)]
    wide = [len(c) >= TABLE_COLUMNS for c in cut]
    starts = [i for i in range(len(cut) - TABLE_ROWS + 1) if all(wide[i : i + TABLE_ROWS]) and _aligned(cut[i : i + TABLE_ROWS])]
    runs: list[list[int]] = []
    for i in starts:  # starts side by side make one table
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    out = []
    for a, b in runs:
        part = cut[a : b + TABLE_ROWS]
        cells = [c for row in part for c in row]
        if not _aligned(part) or sum(len(c) >= PROSE_WORDS for c in cells) / len(cells) >= PROSE_SHARE:
            continue
        middle = lambda c: (c[0].x0 + c[-1].x1) / 2
        columns = np.array([middle(c) for c in max(part, key=len)])
        table = []
        for row in part:
            line = [""] * len(columns)
            for c in row:
                k = int(np.argmin(np.abs(columns - middle(c))))
                line[k] = " ".join([*filter(None, [line[k]]), *(w.text for w in c)])
            table.append(line)
        every = [w for c in cells for w in c]
        out.append(((min(w.x0 for w in every), min(w.top for w in every), max(w.x1 for w in every), max(w.bottom for w in every)), table))
    return out


def _line_list(words: list[Word], width: float, split: bool) -> list[Word]:
    """The page's lines, each as one long word."""
    rows: dict[int, list[Word]] = {}
    for w in words:
        rows.setdefault(round(w.top), []).append(w)
    out = []
    for row in rows.values():
        row.sort(key=lambda w: w.x0)
        gaps = [b.x0 - a.x1 for a, b in zip(row, row[1:])]
        at = int(np.argmax(gaps)) if gaps else 0
        parts = [row]
        if split and gaps and gaps[at] >= COLUMN_GAP and abs((row[at].x1 + row[at + 1].x0) / 2 - width / 2) <= MIDDLE_SLACK:
            parts = [row[: at + 1], row[at + 1 :]]
        out += [Word(" ".join(w.text for w in p), p[0].x0, p[-1].x1, min(w.top for w in p), max(w.bottom for w in p), float(np.median([w.size for w in p])), sum(w.bold for w in p) * 2 > len(p)) for p in parts]
    return out


def _heading_or_text(line: Word, body: float) -> str:
    s = line.text.strip()
    fit = s and len(s) <= HEADING_CHARS and s[-1] not in ".:," and len(s.split()) >= 2 and body > 0
    return "# " + s if fit and (line.size >= body * LARGER or (line.bold and line.size >= body * AS_LARGE)) else line.text


def _order(found: list[Word], width: float) -> list[Word]:
    mid = width / 2
    side = lambda w: 1 if w.x1 <= mid + MIDDLE_MARGIN else 2 if w.x0 >= mid - MIDDLE_MARGIN else 0
    sides = Counter(map(side, found))
    found = sorted(found, key=lambda w: (w.top, w.x0))
    if len(found) < 6 or sides[1] < 3 or sides[2] < 3 or sides[0] > len(found) * 0.5:
        return found
    block, keyed = 0, []
    for w in found:
        block += side(w) == 0
        keyed.append((block, side(w), w.top, w.x0, w))
    return [k[-1] for k in sorted(keyed, key=lambda k: k[:4])]


def page_text(words: list[Word], width: float) -> str:
    """A page's text. What tables are found is kept only if no more than a fiftieth of the words would go."""

    def render(tables) -> str:
        boxes = [box for box, _ in tables]
        free = [w for w in words if not any(w.x0 >= x0 - 1 and w.x1 <= x1 + 1 and w.top >= top - 1 and w.bottom <= bottom + 1 for x0, top, x1, bottom in boxes)]
        found = _line_list(free, width, not tables)
        sizes = Counter(round(w.size * 2) / 2 for w in found if w.size > 0)
        body = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0.0
        if not tables:
            return "\n".join(_heading_or_text(w, body) for w in _order(found, width)).strip()
        items = [(w.top, _heading_or_text(w, body)) for w in found] + [(box[1], f"\n{m}\n") for box, cells in tables if (m := markdown_table(cells))]
        return "\n".join(t for _, t in sorted(items, key=lambda x: x[0])).strip()

    if tables := find_tables(words):
        text = render(tables)
        raw = Counter(w.text for w in words)
        if (raw - Counter(text.replace("|", " ").split())).total() <= MAX_LOST * raw.total():
            return text
    return render([])


def page_texts(words: pd.DataFrame, pages: int) -> list[str]:
    """The texts of a file's pages from its words (page, text, x0, x1, top, bottom, size, bold, width)."""
    out = [""] * pages
    for page, part in words.groupby("page"):
        out[int(page)] = page_text([Word(*r) for r in part[["text", "x0", "x1", "top", "bottom", "size", "bold"]].itertuples(index=False)], float(part["width"].iloc[0]))
    return out


def layout(words: DataFrame) -> DataFrame:
    """(doc_id, page, text) of a table of words; one page is one group."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        text = page_text([Word(*r) for r in page[["text", "x0", "x1", "top", "bottom", "size", "bold"]].itertuples(index=False)], float(page["width"].iloc[0]))
        return pd.DataFrame({"doc_id": page["doc_id"].iloc[:1], "page": page["page"].iloc[:1], "text": [text]})

    kind = {f.name: f.dataType.simpleString() for f in words.schema}
    return words.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, text string")


# -- what recognition adds

def needs_recognition(page: Column) -> Column:
    """Pages with next to no text: scanned ones, perhaps."""
    return F.length(F.trim(F.coalesce(page, F.lit("")))) < BLANK_CHARS


def with_recognised(page: Column, seen: Column) -> Column:
    """The recognised text of a page where it needed it and gives more than there was."""
    better = needs_recognition(page) & (F.length(F.trim(F.coalesce(seen, F.lit("")))) > F.length(F.trim(F.coalesce(page, F.lit("")))))
    return F.when(better, F.trim(seen)).otherwise(page)


def recognised_text(boxes: list[tuple[float, float, str, float]], least: float = 0.5) -> str:
    """Text boxes (top, left, text, confidence) as lines, from the top, then from the left, the sure ones alone."""
    return "\n".join(t for _, _, t, sure in sorted(boxes, key=lambda b: (b[0], b[1])) if sure >= least and t.strip())


def with_form_fields(pages: Column, fields: Column) -> Column:
    """Pages (array) with the filled fields of a form (array of name, value) as a list on the last one."""
    said = F.array_join(F.transform(F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != ""), lambda f: F.concat(F.lit("- **"), f["name"], F.lit(":** "), f["value"])), "\n")
    note = F.concat(F.lit("## Form fields\n\n"), said)
    last = F.when(F.size(pages) > 0, F.concat(F.element_at(pages, -1), F.lit("\n\n"), note)).otherwise(note)
    return F.when(said == "", pages).otherwise(F.concat(F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0))), F.array(last)))


