"""Tables that are written once and read again: scratch tables, and shared ones that are kept by version."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset on a local master (tests), one of our own is
    made and set; a cluster must name one that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, path object) for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def scratch(df: DataFrame, label: str) -> DataFrame:
    """df written under a fresh name in the shared folder and read again: later plans start from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version_of(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that df reads; it changes when they do."""
    spark, said = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, p = file_system(spark, name)
        status = fs.getFileStatus(p)
        said.append(f"{name}\x1f{status.getLen()}\x1f{status.getModificationTime()}")
    return hashlib.sha256("\x1e".join(said).encode()).hexdigest()[:24]


def ensure(spark: SparkSession, name: str, version: str, make: Callable[[], DataFrame], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The table of that name and version: made if it isn't there yet, else read as it is. It appears at
    once and whole, by a rename; of two makers the first wins."""
    path = f"{shared_dir(spark)}/shared/{name}-{version}"
    if not exists(spark, f"{path}/_SUCCESS"):
        part = f"{path}.{uuid.uuid4().hex[:8]}"
        prepare(make()).write.parquet(part)
        fs, p = file_system(spark, part)
        final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, True)
    return spark.read.parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
