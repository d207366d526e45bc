"""Documents that keep arriving, as Structured Streaming queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk
from ..operators.store import VersionedTable


def read_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(id, rel, text) of the text files that land in a folder or below; each file is read once. rel is the
    path below the folder, so that files of one name in two folders are two documents."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    root = re.escape(re.sub("^[a-z]+:/*", "/", folder).rstrip("/"))
    rel = F.regexp_replace(plain(F.col("path")), f"^{root}/", "")
    return raw.select(F.substring(F.sha2(rel.cast("binary"), 256), 1, 16).alias("id"), rel.alias("rel"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def ingest(spark: SparkSession, docs: DataFrame, index: VersionedTable, checkpoint: str, method: str = "structure", **options) -> StreamingQuery:
    """Chunks every batch of docs (id, text) and replaces the chunks of the same documents in the index. An
    index bucketed by doc_id has only the buckets of a batch's documents rewritten; any other is written
    whole. A batch that is run again after a failure replaces its own rows: the outcome is the same."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["id"])
        gone, new = batch.select(F.col("id").alias("doc_id")), chunk(batch, method, **options)
        if index.bucket_by == "doc_id":
            index.replace(new, gone)
        else:
            index.write(index.read().join(gone, "doc_id", "left_anti").select(*new.columns).unionByName(new))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
