"""A training corpus from raw documents: language ID, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents as they came. Each works on all that its predecessor kept:

1. language_id drops documents without a letter, or too far from every language's centroids.
2. near_duplicates links documents whose sets of five-word runs are similar by 0.80 or more. It keeps
   of every component the document with the smallest doc_id; of rows that repeat both doc_id and text, one.
   Different texts under one doc_id are told apart (by a 64-bit hash). Rows without a doc_id stay.
3. mixing repeats and samples documents so that sources come near their target weights.
4. packing cuts the token ids into pieces and places them in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, mixing, neardup, packing
from sparkloom.llm.workspace import Workspace, table

#: From similarity 0.80 on. A pair at 0.80 agrees in 102.5 of 128 sketch places, 4.5 at one standard deviation; near = 0.65
#: is as many deviations below as 0.72 is at 0.85. Both ends of a pair are tied if star is at least stop + 1 - near.
NEAR = neardup.NearDup(num=80, near=0.65, stop=0.27, star=0.62)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    seen = neardup.near_duplicates(spark, keyed.select(F.col("__key").alias("doc_id"), "text"), NEAR)
    known = keyed.where("doc_id is not null")
    ids = known.select("__key", F.col("doc_id").alias("__id")).distinct()
    member = seen.where("doc_id is not null").select(F.col("doc_id").alias("__key"), "component_id").distinct().join(ids, "__key")
    first = member.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("m")).select("m.__key")
    # of rows that repeat doc_id and text one stays; each task keeps one of those it reads before any are shuffled
    once = known.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return once.join(first, "__key", "left_semi").select("row.*").select(*docs.columns).union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(spark, docs)
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    # the outer form keeps the optimiser from testing the copies by working them out a second time
    return taken.select("row", F.explode_outer(copies).alias("copy")).where("copy is not null").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the language model nor the tokenizer; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
