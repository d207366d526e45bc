"""Files and raw pages to documents (rel, text, title, file_type). Office files are read with the
standard library alone; PDF and images need a plug-in, see the registry."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestError, MissingDependency
from ..tables import union_all

SKIP = {"script", "style", "noscript", "nav", "footer", "aside", "form", "svg", "template", "head"}
BLOCK = {"p", "div", "section", "article", "main", "header", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "dl", "dt", "dd", "figure", "hr", "br", "body", "html", *(f"h{i}" for i in range(1, 7))}


def decode(raw: bytes) -> str:
    """UTF-8 with replacement signs, no byte-order mark, plain line ends."""
    return raw.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def markdown_table(rows: list[list[str]]) -> str:
    clean = [[re.sub(r"\s+", " ", c or "").strip().replace("|", "\\|") for c in row] for row in rows]
    clean = [row for row in clean if any(row)]
    if not clean:
        return ""
    width = max(map(len, clean))
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in clean]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Html(HTMLParser):
    """Blocks of a page's visible text as Markdown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.run: list[str] = []
        self.prefix, self.skipped, self.title, self.in_title, self.h1 = "", [], "", False, ""
        self.table: list[list[str]] | None = None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.blocks.append(self.prefix + text)
            if self.prefix == "# " and not self.h1:
                self.h1 = text
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIP:
            self.skipped.append(tag)
        if self.skipped:
            return
        if tag == "table":
            self.flush()
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th"):
                self.run = []
        elif tag in BLOCK:
            self.flush()
            self.prefix = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
            return
        if self.skipped:
            return
        if tag == "table" and self.table is not None:
            if text := markdown_table(self.table):
                self.blocks.append(text)
            self.table, self.run = None, []
        elif self.table is not None:
            if tag in ("td", "th"):
                if not self.table:
                    self.table.append([])
                self.table[-1].append(" ".join("".join(self.run).split()))
                self.run = []
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.run.append(data)


def parse_html(html: str | None) -> tuple[str, str | None]:
    """(text, title) of a page."""
    p = _Html()
    p.feed(html or "")
    p.close()
    p.flush()
    return "\n\n".join(p.blocks), " ".join(p.title.split()) or p.h1 or None


def _heading(text: str) -> str | None:
    found = re.search(r"^#\s+(.+?)\s*#*\s*$", text, re.M)
    return found[1] if found else None


def load_text(raw: bytes) -> tuple[str, str | None]:
    text = decode(raw)
    return text, _heading(text)


def load_csv(raw: bytes) -> tuple[str, str | None]:
    text = decode(raw)
    try:
        delimiter = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    return markdown_table(list(csv.reader(io.StringIO(text), delimiter=delimiter))), None


def load_html(raw: bytes) -> tuple[str, str | None]:
    return parse_html(decode(raw))


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _words(e: ET.Element) -> str:
    return "".join("\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else x.text or "" for x in e.iter() if _local(x) in ("t", "tab", "br"))


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, name of the part) of what a part of an office file refers to."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for e in ET.fromstring(z.read(path)):
        target = e.attrib.get("Target", "")
        full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[e.attrib.get("Id", "")] = (e.attrib.get("Type", "").rpartition("/")[2], full)
    return out


def _ref(e: ET.Element) -> str:
    """The relationship that an element names."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def load_docx(raw: bytes) -> tuple[str, str | None]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e) == "body")
        related = _related(z, "word/document.xml")
        named = [related[r][1] for e in body.iter() if _local(e) in ("headerReference", "footerReference") and (r := _ref(e)) in related]
        named += [part for kind, part in related.values() if kind in ("header", "footer")]
        furniture = [_words(ET.fromstring(z.read(n))).strip() for n in dict.fromkeys(named) if n in z.namelist()]
    blocks, title = [], None
    for e in body:
        if _local(e) == "tbl":
            rows = [[_words(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            blocks.append(markdown_table(rows))
        elif _local(e) == "p" and (text := _words(e).strip()):
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = 1 if style == "Title" else int(m[1]) if (m := re.fullmatch(r"[Hh]eading\s?(\d)", style)) else 0
            title = title or (text if level == 1 else None)
            blocks.append("#" * level + " " * bool(level) + ("- " if "List" in style else "") + text)
    return "\n\n".join([b for b in blocks if b] + [f for f in dict.fromkeys(furniture) if f]), title


def load_pptx(raw: bytes) -> tuple[str, str | None]:
    blocks, first = [], None
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        # slides in the order that the presentation lists them, whatever their files are called
        related = _related(z, "ppt/presentation.xml")
        listed = [related[_ref(e)][1] for e in ET.fromstring(z.read("ppt/presentation.xml")).iter() if _local(e) == "sldId" and _ref(e) in related]
        for k, n in enumerate(listed, 1):
            root, title, body = ET.fromstring(z.read(n)), "", []
            for e in root.iter():
                if _local(e) == "tbl":
                    body.append(markdown_table([[_words(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
                elif _local(e) == "sp":
                    text = "\n".join(t for p in e.iter() if _local(p) == "p" and (t := _words(p).strip()))
                    kind = next((x.attrib.get("type", "") for x in e.iter() if _local(x) == "ph"), "")
                    if kind in ("title", "ctrTitle") and not title:
                        title = text
                    elif text:
                        body.append(text)
            note = next((part for kind, part in _related(z, n).values() if kind == "notesSlide" and part in z.namelist()), None)
            if note and (said := _words(ET.fromstring(z.read(note))).strip()):
                body.append("Notes: " + said)
            first = first or title or None
            blocks.append("\n\n".join([f"## Slide {k}" + (f": {title}" if title else ""), *[b for b in body if b]]))
    return "\n\n".join(blocks), first


def load_xlsx(raw: bytes) -> tuple[str, str | None]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [_words(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        related = _related(z, "xl/workbook.xml")
        sheets = [(e.attrib, related[_ref(e)][1]) for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet" and _ref(e) in related]
        blocks = []
        for k, (sheet, part) in enumerate(sheets, 1):
            rows: list[list[str]] = []
            for r in (e for e in ET.fromstring(z.read(part)).iter() if _local(e) == "row"):
                cells: dict[int, str] = {}
                for c in (e for e in r if _local(e) == "c"):
                    col = 0
                    for ch in re.match("[A-Z]+", c.attrib.get("r", "A"))[0]:
                        col = col * 26 + ord(ch) - 64
                    value = next((x.text or "" for x in c if _local(x) == "v"), None)
                    formula = next((x.text or "" for x in c if _local(x) == "f"), None)
                    if c.attrib.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.attrib.get("t") == "inlineStr":
                        value = _words(c)
                    cells[col - 1] = value if value is not None else "=" + formula if formula else ""
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            hidden = " (hidden)" if sheet.get("state") in ("hidden", "veryHidden") else ""
            if text := markdown_table(rows):
                blocks.append(f"## {sheet.get('name', k)}{hidden}\n\n{text}")
    return "\n\n".join(blocks), None


def load_pdf(raw: bytes) -> tuple[str, str | None]:
    """Text of a PDF by its layout; needs pdfplumber. See layout.py for what is done with the words."""
    try:
        import pdfplumber
    except ImportError as e:
        raise MissingDependency("pdfplumber", "pdf") from e
    from .layout import page_texts

    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        words = [
            (k, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w.get("size", 0.0), bool(re.search("bold|black|heavy", w.get("fontname", ""), re.I)), float(page.width))
            for k, page in enumerate(pdf.pages) for w in page.extract_words(extra_attrs=["size", "fontname"])
        ]
        pages = page_texts(pd.DataFrame(words, columns=["page", "text", "x0", "x1", "top", "bottom", "size", "bold", "width"]), len(pdf.pages))
    return chr(12).join(pages), None


def load_image(raw: bytes) -> tuple[str, str | None]:
    """Text of each frame of an image; needs an engine that recognises text, see ocr in the registry."""
    raise MissingDependency("a text recogniser", "ocr")


LOADERS: dict[str, Callable[[bytes], tuple[str, str | None]]] = {"text": load_text, "csv": load_csv, "html": load_html, "docx": load_docx, "pptx": load_pptx, "xlsx": load_xlsx, "pdf": load_pdf, "image": load_image}
EXTENSIONS = {"txt": "text", "md": "text", "markdown": "text", "rst": "text", "log": "text", "json": "text", "yaml": "text", "yml": "text", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "xhtml": "html", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image"}


@dataclass(frozen=True)
class Source:
    """A folder, file or pattern with what to do with its files. loader: by extension where None."""

    location: str
    exclude: tuple[str, ...] = ()
    loader: str | None = None
    metadata: tuple[tuple[str, str], ...] = ()

    def settings(self) -> str:
        return json.dumps([self.loader, self.metadata])


def discover(spark: SparkSession, location: str | Sequence[str | Source], exclude: tuple[str, ...] = (), warnings: bool = False):
    """(rel, path, loader, content, hash, metadata) of the files of one or several sources, in the order of
    their paths when collected by rel. Hidden files, files in hidden folders and office lock files are left
    out, and so are files of unknown types; with warnings=True the result is (files, the latter as a table
    (path, warning)). A file that two sources reach with equal settings counts once, with different ones it
    is an error. Of files with one rel, those of later sources get their source's folder before it."""
    given = [location] if isinstance(location, str | Source) else list(location)
    sources = [x if isinstance(x, Source) else Source(x, exclude) for x in given]
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    parts = []
    for n, source in enumerate(sources):
        if re.match(r"https?://", source.location):
            raise IngestError("addresses can't be sources; give a path")
        plain = re.sub(r"^[a-z]+:/*", "/", source.location).rstrip("/")
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source.location)
        except AnalysisException as e:
            raise IngestError(f"nothing at {source.location}") from e
        path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
        rel = F.regexp_replace(path, f"^{re.escape(plain)}/", "")
        rel = F.when(rel == path, F.substring_index(path, "/", -1)).otherwise(rel)
        rows = files.select(rel.alias("rel"), path.alias("path"), F.lit(source.loader).cast("string").alias("given"), "content", F.lit(source.settings()).alias("settings"), F.lit(n).alias("source"), F.lit(plain.rpartition("/")[2]).alias("folder"))
        rows = rows.where(~F.col("rel").rlike(r"(^|/)(\.|~\$)"))
        for pattern in {*source.exclude, *exclude}:
            rows = rows.where(~F.col("rel").rlike(glob_regex(pattern)))
        parts.append(rows)
    rows = union_all(parts).withColumn("loader", F.coalesce("given", kinds[F.lower(F.substring_index("path", ".", -1))]))
    unknown = rows.where("loader is null").select("path", F.lit("no loader for files of this type").alias("warning")).distinct()
    rows = rows.where("loader is not null")
    if len(sources) > 1:
        # names first, without contents: which source has each file, and under what rel
        names = rows.select("path", "rel", "source", "folder", "settings")
        differ = F.raise_error(F.concat(F.lit("two sources give different settings to "), F.col("path")))
        once = names.groupBy("path").agg(F.min("source").alias("source"), F.countDistinct("settings").alias("n"))
        once = once.select("path", F.when(F.col("n") > 1, differ.cast("int")).otherwise(F.col("source")).alias("source"))
        names = names.join(once, ["path", "source"])
        later = F.row_number().over(Window.partitionBy("rel").orderBy("source", "path")) > 1
        names = names.select("path", "source", F.when(later, F.concat_ws("/", "folder", "rel")).otherwise(F.col("rel")).alias("rel"))
        rows = rows.drop("rel").join(names, ["path", "source"])
    metadata = F.element_at(F.from_json("settings", "array<string>"), 2)
    out = rows.select("rel", "path", "loader", "content", F.sha2(F.concat_ws(chr(31), F.sha2("content", 256), "loader", "settings"), 256).alias("hash"), metadata.alias("metadata"))
    return (out, unknown) if warnings else out


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON Lines, or from JSON (a list, or an object whose cases are one). Columns that
    a file lacks are null; a case without a question is an error when the result is read."""
    schema = "id string, question string, gold_answer string, gold_sources array<struct<source string, section string, quote string>>, answerable boolean, split string, tags array<string>, history array<struct<role string, content string>>"
    if path.endswith(".jsonl"):
        rows = spark.read.schema(schema).json(path)
    else:
        whole = spark.read.text(path, wholetext=True)
        found = F.coalesce(F.from_json("value", f"struct<cases array<struct<{schema.replace(' string', ':string').replace(' array<', ':array<').replace(' boolean', ':boolean')}>>>")["cases"], F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' array<', ':array<').replace(' boolean', ':boolean')}>>"))
        rows = whole.select(F.explode(found).alias("c")).select("c.*")
    asked = F.when(F.coalesce(F.trim("question"), F.lit("")) == "", F.raise_error(F.lit("a case has no question")).cast("string")).otherwise(F.col("question"))
    ident = F.coalesce("id", F.concat(F.lit("case-"), F.substring(F.sha2(F.col("question").cast("binary"), 256), 1, 12)))
    return rows.withColumns({"question": asked, "id": ident, "answerable": F.coalesce("answerable", F.lit(True)), "split": F.coalesce("split", F.lit("dev")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def load(files: DataFrame) -> DataFrame:
    """Documents (id, rel, text, title, file_type, error) of discovered files; an unreadable one has an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for rel, loader, content in zip(f["rel"], f["loader"], f["content"]):
                try:
                    rows.append((rel, *LOADERS[loader](content), loader, None))
                except Exception as e:  # one bad file mustn't stop the others
                    rows.append((rel, None, None, loader, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["rel", "text", "title", "file_type", "error"])

    loaded = files.select("rel", "loader", "content").mapInPandas(run, "rel string, text string, title string, file_type string, error string")
    return loaded.select(F.substring(F.sha2(F.col("rel").cast("binary"), 256), 1, 16).alias("id"), "*")


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("title", T.StringType()))
def html_text(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_html(h) for h in html], columns=["text", "title"])
