"""The index as versioned Parquet, the manifest that makes ingestion incremental, caches.

A table's rows are dealt into buckets by a key. A version is one small file that names the folder of each
bucket; it is created under the next number by an operation that fails if the number is taken, and the
greatest number counts. So a reader sees one whole version or another, a crash leaves at most folders that
no version names, and of two writers one is told to try again. A change rewrites the buckets it touches."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..tables import file_system, scratch
from .filters import Filter, compile_filter


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel, state): new, changed, unchanged or removed, of files and manifest (rel, hash)."""
    f, m = files.select("rel", F.col("hash").alias("now")), manifest.select("rel", F.col("hash").alias("before"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed").otherwise("unchanged")
    return f.join(m, "rel", "full").select("rel", state.alias("state"))


def ingest_counts(states: DataFrame) -> DataFrame:
    """One row of counters."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged", "removed")])


def merge(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of old with the same key, the others are added."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def remove(old: DataFrame, ids: DataFrame | None = None, flt: Filter | None = None, key: str = "id") -> DataFrame:
    """old without the rows that have one of the ids and match the filter; one of both is needed."""
    if ids is None and not flt:
        raise IngestError("say what to delete: ids, a filter, or both")
    hit = old if ids is None else old.join(ids.select(key), key, "left_semi")
    gone = hit.where(compile_filter(flt, hit)).select(key)
    return old.join(gone, key, "left_anti").select(*old.columns)


def fetch(store: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """Rows by id in the order asked for; unknown ids are left out."""
    spark = store.sparkSession
    want = spark.createDataFrame(list(enumerate(ids)), f"pos int, {key} string")
    return store.join(want, key).orderBy("pos").select(*store.columns)


class VersionedTable:
    """bucket_by names the column by which rows are dealt into buckets (and documents are replaced)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: str = "id", buckets: int = 64):
        self.spark, self.path, self.schema, self.bucket_by, self.buckets = spark, path.rstrip("/"), schema, bucket_by, buckets

    def version(self) -> int:
        """The number of the version in use, 0 before the first."""
        fs, p = file_system(self.spark, f"{self.path}/_versions")
        return max((int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0

    def state(self) -> dict:
        """What the version in use says: the folder of each bucket, and info, which writers may add to."""
        n = self.version()
        if not n:
            return {"folders": {}, "info": {}}
        fs, p = file_system(self.spark, f"{self.path}/_versions/{n}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        folders = self.state()["folders"]
        paths = [f"{self.path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _publish(self, folders: Mapping[str, str], info: Mapping | None, before: int) -> int:
        fs, p = file_system(self.spark, f"{self.path}/_versions/{before + 1}")
        part = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps({"folders": folders, "info": dict(info or {})}, sort_keys=True).encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(part, p):
            fs.delete(part, False)
            raise IngestError(f"another writer has made version {before + 1} of {self.path}; read it and try again")
        return before + 1

    def _rows(self, df: DataFrame) -> dict[str, str]:
        """Writes rows to a new folder; returns the folder of each bucket that has any."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        home = f"d-{uuid.uuid4().hex[:16]}"
        rows = df.select(*names, self.bucket(F.col(self.bucket_by)).alias("__bucket"))
        rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{home}")
        fs, p = file_system(self.spark, f"{self.path}/{home}")
        found = [x.getPath().getName() for x in fs.listStatus(p)]
        return {f.split("=")[1]: f"{home}/{f}" for f in found if f.startswith("__bucket=")}

    def write(self, df: DataFrame, info: Mapping | None = None) -> int:
        """A version of these rows alone."""
        before = self.version()
        return self._publish(self._rows(df), info, before)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, info: Mapping | None = None) -> int:
        """Rows whose key (the bucket column) is among keys, or among those of rows, give way to rows.
        Only the buckets of these keys are read and written."""
        before, state = self.version(), self.state()
        gone = (rows if keys is None else keys.select(self.bucket_by).union(rows.select(self.bucket_by))).select(self.bucket_by).distinct()
        touched = [r.b for r in gone.select(self.bucket(F.col(self.bucket_by)).alias("b")).distinct().collect()]  # at most as many as buckets
        kept = self.read(touched).join(gone, self.bucket_by, "left_anti")
        new = self._rows(kept.unionByName(rows.select(*kept.columns)))
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched} | new
        return self._publish(folders, info if info is not None else state["info"], before)

    def upsert(self, rows: DataFrame, key: str = "id") -> int:
        return self.replace(rows) if key == self.bucket_by else self.write(merge(self.read(), rows, key), self.state()["info"])

    def delete(self, ids: DataFrame | None = None, flt: Filter | None = None, key: str = "id") -> int:
        return self.write(remove(self.read(), ids, flt, key), self.state()["info"])

    def clear(self) -> int:
        return self._publish({}, {}, self.version())

    def vacuum(self, keep: int = 2) -> None:
        """Removes all versions but the last few, and folders that none of these name."""
        fs, p = file_system(self.spark, f"{self.path}/_versions")
        last, named = self.version(), set()
        for n in range(max(1, last - keep + 1), last + 1):
            _, q = file_system(self.spark, f"{self.path}/_versions/{n}")
            if fs.exists(q):
                stream = fs.open(q)
                named |= {f.split("/")[0] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
                stream.close()
        for x in fs.listStatus(p):
            if x.getPath().getName().isdigit() and int(x.getPath().getName()) <= last - keep:
                fs.delete(x.getPath(), False)
        for x in fs.listStatus(p.getParent()):
            if x.getPath().getName().startswith("d-") and x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)


def fingerprint(settings: Mapping) -> str:
    """A digest of what an index depends on beside its files: chunking, embedding, extraction."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def must_rebuild(index: VersionedTable, settings: Mapping) -> str | None:
    """Why an index can't be updated in place: "empty", "settings" or None."""
    state = index.state()
    if not state["folders"]:
        return "empty"
    return "settings" if state["info"].get("fingerprint") != fingerprint(settings) else None


def ingest(files: DataFrame, documents: DataFrame, index: VersionedTable, manifest: VersionedTable, chunk, settings: Mapping) -> DataFrame:
    """Brings an index up to files (rel, hash): documents (id, rel, text) that are new or changed are chunked
    anew, those removed go, the rest stays. All is rebuilt where the settings have changed or the index is
    lost. index is bucketed by doc_id, manifest (rel, hash, doc_id) by rel. Returns the states (rel, state)."""
    known = manifest.read()
    if must_rebuild(index, settings):
        known = known.limit(0)
    states = diff(files.select("rel", "hash"), known)
    info = {"fingerprint": fingerprint(settings)}
    gone = known.join(states.where("state in ('changed', 'removed')").select("rel"), "rel", "left_semi").select("doc_id")
    states = scratch(states, "states")  # manifest and index change below: what was found is kept first
    gone, todo = scratch(gone, "gone"), documents.join(states.where("state in ('new', 'changed')").select("rel"), "rel", "left_semi")
    if known.limit(1).count() == 0:
        index.write(chunk(todo), info)
        manifest.write(todo.join(files.select("rel", "hash"), "rel").select("rel", "hash", F.col("id").alias("doc_id")), info)
    else:
        index.replace(chunk(todo), gone, info)
        changed = states.where("state != 'unchanged'").select("rel")
        manifest.replace(todo.join(files.select("rel", "hash"), "rel").select("rel", "hash", F.col("id").alias("doc_id")), changed, info)
    return states


def cached_apply(rows: DataFrame, cache: DataFrame, key: str, compute, max_age: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached or computed value, rows that the cache lacks, computed). cache: (key, value),
    with a timestamp column at if max_age (seconds) is given: older entries don't count."""
    if max_age is not None:
        cache = cache.where(F.col("at") >= F.current_timestamp() - F.make_interval(secs=F.lit(max_age)))
    keyed = rows.withColumn("__k", F.sha2(F.col(key).cast("string").cast("binary"), 256))
    misses = compute(keyed.join(cache.select(F.col("key").alias("__k")), "__k", "left_anti").dropDuplicates(["__k"])).select(F.col("__k").alias("key"), "value")
    known = cache.select("key", "value").unionByName(misses)
    return keyed.join(known.withColumnRenamed("key", "__k"), "__k", "left").drop("__k"), misses


def write_cache(cache: VersionedTable, misses: DataFrame) -> int:
    """Adds computed rows to a cache table (key, value, at), bucketed by key."""
    return cache.replace(misses.select("key", "value", F.current_timestamp().alias("at")))
