"""Normalisation of loaded texts, by expressions over lines and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = chr(12)


def promote_headings(text: Column) -> Column:
    """Lines that look like headings get marks: dotted numbers by depth, named parts, lines of capitals."""

    def line(x: Column) -> Column:
        s = F.trim(x)
        fit = (F.length(s) > 0) & (F.length(s) <= 90) & ~s.rlike(r"[.:,]$") & ~s.rlike(r"^[#|>-]")
        dots = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\.?\s+\p{L}", 1)
        depth = F.least(F.lit(6), F.size(F.split(dots, r"\.")) + 1)
        return (
            F.when(fit & (dots != ""), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), s))
            .when(fit & s.rlike(r"(?i)^(section|article|chapter|part)\s+[0-9ivxlc]+\b"), F.concat(F.lit("## "), s))
            .when(fit & s.rlike(r"^[^\p{Ll}]*\p{Lu}{2,}[^\p{Ll}]*\s+[^\p{Ll}]*\p{Lu}{2,}[^\p{Ll}]*$"), F.concat(F.lit("## "), s))
            .otherwise(x)
        )

    pages = F.split(text, PAGE)
    return F.array_join(F.transform(pages, lambda p: F.array_join(F.transform(F.split(p, "\n"), line), "\n")), PAGE)


def boilerplate_key(line: Column) -> Column:
    """What makes two lines the same furniture; null for lines too short or too long for that."""
    s = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    digits, signs = F.regexp_count(s, F.lit(r"[0-9]")), F.regexp_count(s, F.lit(r"[\p{L}\p{N}]"))
    key = F.when(digits * 5 >= signs, F.regexp_replace(s, r"\d+", "#")).otherwise(s)
    return F.when((F.length(s) >= 4) & (F.length(s) <= 120), key)


def strip_repeated_lines(docs: DataFrame, least_pages: int = 4) -> DataFrame:
    """docs (id, text) without lines that stand on at least half of a document's pages (three at least)."""
    rows = docs.select("id", F.posexplode(F.split("text", PAGE)).alias("page", "p"), F.size(F.split("text", PAGE)).alias("pages"))
    lines = rows.select("id", "page", "pages", F.posexplode(F.split("p", "\n")).alias("n", "line")).withColumn("key", boilerplate_key(F.col("line")))
    on = lines.where("key is not null").groupBy("id", "key", "pages").agg(F.countDistinct("page").alias("c"))
    gone = on.where((F.col("pages") >= least_pages) & (F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2)))).select("id", "key")
    left = lines.join(gone, ["id", "key"], "left_anti").unionByName(lines.where("key is null")).dropDuplicates(["id", "page", "n"])
    pages = left.groupBy("id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return pages.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), PAGE).alias("text"))


def first_of(df: DataFrame, *keys: str, order: Column) -> DataFrame:
    """One row of each key, the first by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
