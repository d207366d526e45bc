"""Document quality: figures for every document, flags by threshold, duplicates and version families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import family_key

PAGE = chr(12)


def repeated_share(docs: DataFrame, least: int = 3, least_chars: int = 12) -> DataFrame:
    """(id, share): of the characters in lines, what lines of least_chars or more that stand least times take."""
    lines = docs.select("id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("id", F.trim("line").alias("line")).where("line != ''")
    counts = lines.groupBy("id", "line").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("line") * F.col("n")
    hit = (F.col("n") >= least) & (F.length("line") >= least_chars)
    return counts.groupBy("id").agg(F.round(F.sum(F.when(hit, size).otherwise(0)) / F.sum(size), 6).alias("share"))


def figures(docs: DataFrame) -> DataFrame:
    """One row a document (id, text): counts and ratios, all from one pass over the text."""
    t = F.coalesce("text", F.lit(""))
    visible = F.length(F.regexp_replace(t, r"[\x09-\x0D\x20]", ""))
    letters = F.regexp_count(t, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]"))
    words = F.regexp_count(t, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"))
    single = F.size(F.filter(F.regexp_extract_all(t, F.lit(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1)), lambda w: (F.length(w) == 1) & ~F.lower(w).isin("a", "i")))
    return docs.select(
        "id",
        F.length(t).cast("long").alias("chars"),
        words.cast("long").alias("words"),
        (F.length(t) - F.length(F.replace(t, F.lit(PAGE), F.lit(""))) + 1).cast("long").alias("pages"),
        F.regexp_count(t, F.lit(r"(?m)^#{1,6} ")).cast("long").alias("headings"),
        F.regexp_count(t, F.lit(r"(?m)^\|[ :|-]*-[ :|-]*\|$")).cast("long").alias("tables"),
        visible.cast("long").alias("visible"),
        F.round(letters / F.greatest(visible, F.lit(1)), 6).alias("letter_ratio"),
        F.round(single / F.greatest(words, F.lit(1)), 6).alias("single_ratio"),
        F.round(letters / F.greatest(words, F.lit(1)), 6).alias("word_length"),
        F.round(F.regexp_count(t, F.lit("�")) / F.greatest(visible, F.lit(1)), 6).alias("bad_ratio"),
    )


def flags(x: DataFrame) -> Column:
    """Flags of figures() joined with a column share (of repeated lines), sorted."""
    noise = F.col("visible") >= 200
    tests = {
        "empty": F.col("chars") == 0,
        "short": (F.col("chars") > 0) & (F.col("pages") == 1) & (F.col("chars") < 300) & (F.col("tables") == 0),
        "sparse_pages": (F.col("pages") > 1) & (F.col("chars") / F.col("pages") < 150),
        "no_headings": (F.col("chars") > 4000) & (F.col("headings") == 0) & (F.col("tables") == 0),
        "undecodable": noise & (F.col("bad_ratio") > 0.002),
        "few_letters": noise & (F.col("letter_ratio") < 0.55),
        "single_letters": noise & (F.col("single_ratio") > 0.15),
        "odd_words": noise & ((F.col("word_length") < 2.5) | (F.col("word_length") > 12)),
        "repeated_lines": noise & (F.coalesce("share", F.lit(0.0)) > 0.1),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()])))


def health(docs: DataFrame) -> DataFrame:
    x = figures(docs).join(repeated_share(docs), "id", "left")
    return x.withColumn("share", F.coalesce("share", F.lit(0.0))).withColumn("flags", flags(x))


def chunk_health(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, median_chars, fragmented)."""
    out = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.percentile(F.length("text"), F.lit(0.5)).cast("long").alias("median_chars"))
    return out.withColumn("fragmented", (F.col("chunks") >= 5) & (F.col("median_chars") < 80))


def duplicates(docs: DataFrame) -> DataFrame:
    """(hash, n, ids): documents whose texts are equal but for space and case. ids of a group beyond a
    task's memory aren't gathered; keep to (hash, id) rows by duplicate_members() for those."""
    members = duplicate_members(docs)
    return members.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def duplicate_members(docs: DataFrame) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x09-\x0D\x20]+", " "))
    return docs.select("id", F.substring(F.sha2(plain.cast("binary"), 256), 1, 16).alias("hash"))


def families(files: DataFrame) -> DataFrame:
    """(family, n, names) of files (rel) whose names differ by version marks alone."""
    keyed = files.select("rel", family_key(F.substring_index("rel", "/", -1)).alias("family")).where("family != ''")
    return keyed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("rel")).alias("names")).where("n > 1")
