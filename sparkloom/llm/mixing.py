"""Operator 7, mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources share ``share`` times all sizes by their weights; a
target stops at ``most`` times its source's size and the excess is shared again, in closed form: sources
are taken in the order of cap over weight, and the capped ones come first. Every document of a source
gets the whole copies that the source's rate makes certain. The rest of the target is a Pareto sample:
documents are ranked by their random odds u / (1 - u) divided by their inclusion odds, and are taken in
that order while their sizes fit; three more turns over those that still fit close the gap that a long
document leaves. u is a hash of doc_id, so reruns agree.

The inclusion odds are the source's rate, times a document's importance where a column of it is named.
u is a hash of doc_id, text and, for rows that repeat both, of their number, so every row is drawn by
itself, null and repeated doc_ids included, and reruns agree.

No source is brought into one task: a rank is found from sums over buckets of the ranking value, and
only the bucket in which the target is reached is sorted. Repeated rows are numbered within each task
that reads them; only those found by several tasks get an offset, from a table of such repeats alone.

Rows: a null text has size 0, and documents of size 0 are taken 0 times. A null source is a source of
its own, the last. An empty table gives an empty result. Names of columns may be any: rows stay apart
from what is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SLICE, buffers, count_words, slices
from .workspace import Workspace, table

BUCKETS = 4096
TURNS = 4


def random_of(*key: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest of the key's parts."""
    said = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    bits = F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, source, doc_id, h, ...) -> the same without the text, with size, the number of words,
    and nth, the number of the row among the task's rows of one source, doc_id and h."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        size = [count_words(data, offsets[i : j + 1]) for i, j in slices(offsets, 4 * SLICE)]
        nth = np.zeros(batch.num_rows, np.int64)
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            key = hash(key)  # of texts' digests; rows that collide are numbered apart, no more
            nth[i] = seen.get(key, 0)
            seen[key] = int(nth[i]) + 1
        names = batch.schema.names[1:]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(np.concatenate(size) if size else [], pa.int64()), pa.array(nth)], [*names, "size", "nth"])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, whole (certain copies), gap (words left to sample), rate (gap by size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))  # one row a source
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("w"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    prior = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(prior), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("n", F.row_number().over(filling))
    by = by.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    by = by.withColumn("final", F.min_by("level", F.when(F.col("open"), F.col("n"))).over(whole))
    by = by.withColumn("target", F.when(F.col("open"), F.col("final") * F.col("w")).otherwise(F.col("cap")))
    by = by.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    by = by.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("gap") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.select("source", "source_size", "target", "whole", "gap", rate.alias("rate"))


def _ranked(rows: DataFrame) -> DataFrame:
    """v: the ranking value q / (1 + q) of q = random odds / inclusion odds, between 0 and 1."""
    chance = F.col("rate") * F.col("importance") if "importance" in rows.columns else F.col("rate")
    chance = F.greatest(F.least(chance, F.lit(1 - 1e-9)), F.lit(1e-12))
    q = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    return rows.withColumn("v", q / (1 + q))


def _join(rows: DataFrame, by: DataFrame) -> DataFrame:
    by = by.withColumnRenamed("source", "__source")
    return rows.join(by, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


_PLACE = ("v", "doc_id", "size", "h", "nth")


def _taken(turns: int) -> Column:
    """Whether one of the first turns took the row: it fitted into that turn's gap and stood before its cut."""
    out = F.lit(False)
    for k in range(turns):
        out = out | F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col(f"gap{k}")) & (F.struct(*_PLACE) <= F.col(f"cut{k}")), F.lit(False))
    return out


def _measured(ws: Workspace, docs: DataFrame, importance: str | None, whole: bool) -> DataFrame:
    """The written table of all rows (row: the document where whole, doc_id, source, size, h, nth, u, importance)."""
    extra = [F.col(importance).cast("double").alias("importance")] if importance else []
    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("h"), F.spark_partition_id().alias("part"), *extra, *([F.struct(*docs.columns).alias("row")] if whole else []),
    )
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("size", T.LongType()), T.StructField("nth", T.LongType())])
    rows = ws.save(rows.mapInArrow(_measure, schema), "sizes")
    # rows of one key that several tasks read: those of later tasks are numbered on from the earlier ones
    counts = rows.groupBy("source", "doc_id", "h", "part").agg(F.count(F.lit(1)).alias("m"))
    shared = counts.groupBy("source", "doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    before = F.sum("m").over(Window.partitionBy("a.source", "a.doc_id", "a.h").orderBy("part"))  # a row for each task
    repeats = counts.alias("a").join(shared.alias("b"), same("a", "b")).select("a.source", "a.doc_id", "a.h", "part", (before - F.col("m")).alias("offset"))
    repeats = ws.save(repeats.coalesce(8), "repeats")
    if not repeats.isEmpty():
        rows = rows.alias("a").join(repeats.alias("b"), same("a", "b") & (F.col("a.part") == F.col("b.part")), "left").select("a.*", "offset").withColumn("nth", F.col("nth") + F.coalesce("offset", F.lit(0))).drop("offset")
    return rows.withColumn("u", random_of(F.col("doc_id"), F.col("h"), F.col("nth"))).drop("part")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, importance: str | None = None, ws: Workspace | None = None, whole: bool = True) -> DataFrame:
    """docs (doc_id, text, source and whatever else) as row, with doc_id, size, source_size, target, copies
    and taken (copies x size). importance names a column that multiplies a document's inclusion chance;
    whole=False leaves row out."""
    ws = ws or Workspace(spark, "mixing")
    rows = _measured(ws, docs, importance, whole)
    by = ws.save(targets(rows, weights, share, most).withColumn("gap0", F.col("gap")).coalesce(1), "targets")
    for k in range(TURNS):
        left = _ranked(_join(rows.drop("row"), by)).where(~_taken(k) & (F.col("size") > 0) & (F.col("size") <= F.col(f"gap{k}")))
        left = left.select("source", *_PLACE, F.col(f"gap{k}").alias("gap"), F.floor(F.col("v") * BUCKETS).alias("b"))
        sums = left.groupBy("source", "b").agg(F.sum("size").alias("n"), F.min("gap").alias("gap"))
        upto = Window.partitionBy("source").orderBy("b")  # at most BUCKETS rows a source
        sums = sums.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        edge = sums.where((F.col("before") <= F.col("gap")) & (F.col("before") + F.col("n") > F.col("gap"))).select(F.col("source").alias("s"), F.col("b").alias("eb"), "before")
        inside = left.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("eb")))
        running = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0))
        sorted_ = inside.withColumn("upto", running).where(F.col("upto") <= F.col("gap")).groupBy("source").agg(F.max(F.struct(*_PLACE)).alias("cut"), F.max("upto").alias("upto"))
        full = sums.where(F.col("before") + F.col("n") <= F.col("gap")).groupBy("source").agg(F.max("b").alias("last"), F.max(F.col("before") + F.col("n")).alias("words"))
        both = full.join(sorted_.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "full")
        high = F.struct(((F.col("last") + 1) / F.lit(float(BUCKETS))).alias("v"), *[F.lit(None).cast(t).alias(c) for c, t in zip(_PLACE[1:], ("long", "long", "string", "long"))])
        found = both.select(F.when(F.col("words").isNotNull(), F.col("source")).otherwise(F.col("s2")).alias("source"), F.coalesce("cut", F.when(F.col("last").isNotNull(), high)).alias(f"cut{k}"), F.coalesce("upto", "words").alias("used"))
        by = _join(by, found).withColumn(f"gap{k + 1}", F.col(f"gap{k}") - F.coalesce("used", F.lit(0))).drop("used")
        by = ws.save(by.coalesce(1), f"targets{k}")
    by = by.drop("gap", f"gap{TURNS}")
    copies = F.coalesce(F.col("whole") + _taken(TURNS).cast("long"), F.lit(0))
    out = _ranked(_join(rows, by)).withColumn("copies", copies)
    return out.select(*(["row"] if whole else []), "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(spark, docs, whole=False).select("doc_id", "size", "source_size", "target", "taken")


def _sql_turn(k: int) -> str:
    """One turn: c{k} are the rows that fit, in order; t{k} those taken; g{k + 1} the gaps left."""
    before = "".join(f" AND NOT EXISTS (SELECT 1 FROM t{j} WHERE t{j}.n = r.n)" for j in range(k))
    return f"""
c{k} AS (
  SELECT r.n, r.source, r.size, g.gap,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.v, r.doc_id NULLS FIRST, r.size, r.h, r.nth ROWS UNBOUNDED PRECEDING) AS upto
  FROM r JOIN g{k} g ON g.source IS NOT DISTINCT FROM r.source
  WHERE r.size > 0 AND r.size <= g.gap{before}
), t{k} AS (SELECT n, source, size FROM c{k} WHERE upto <= gap
), g{k + 1} AS (
  SELECT g.source, g.gap - coalesce(x.used, 0) AS gap
  FROM g{k} g LEFT JOIN (SELECT source, sum(size) AS used FROM t{k} GROUP BY source) x ON x.source IS NOT DISTINCT FROM g.source
)"""


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, md5(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY source, doc_id, text) - 1 AS nth, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER o AS k,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s
  WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST),
         p AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT arg_min(level, k) AS final FROM l WHERE level * w < cap
), t AS (
  SELECT source, source_size, CASE WHEN level * w < cap THEN final * w ELSE cap END AS target FROM l, f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), g0 AS (SELECT source, target - whole * source_size AS gap FROM b
), r AS (
  SELECT n, doc_id, source, size, h, nth, source_size, target, whole, q / (1 + q) AS v FROM (
    SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS q FROM (
      SELECT d.n, d.doc_id, d.source, d.size, d.h, d.nth, b.source_size, b.target, b.whole,
             (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.h || ':' || CAST(d.nth AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
             greatest(least(CASE WHEN b.source_size > 0 THEN (b.target - b.whole * b.source_size) / b.source_size ELSE 0 END, 1::DOUBLE - 1e-9::DOUBLE), 1e-12::DOUBLE) AS chance
      FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source))
), {",".join(_sql_turn(k) for k in range(TURNS))}
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.whole + CASE WHEN x.n IS NULL THEN 0 ELSE 1 END) * r.size AS taken
FROM r LEFT JOIN ({" UNION ALL ".join(f"SELECT n FROM t{k}" for k in range(TURNS))}) x ON x.n = r.n
"""
