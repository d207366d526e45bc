"""Operator 8, token ids as word-aligned binary files.

Every document's ids, closed by an end id, are packed by Simple-8b where the text is read; only the
packed words are dealt out, by ranges of doc_id, and each task writes its range in ascending order as
shards of bounded size. A shard is one self-contained binary value in a Parquet table, so that any file
system Spark can reach will do and a lost executor costs only its own range again. Its layout, all
little-endian:

    4 bytes   S8B1
    3 int64   documents d, blocks b, words w
    d uint8   1 where the document has an id
    d int64   doc_id
    d int64   ids of each document, with the end id
    b uint16  words of each block of 128 ids (the per-block offsets, as differences)
    w uint64  the words

Rows: a null text counts as empty (the end id alone). Null doc_ids come first; rows of one doc_id are
in the order of their packed ids. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .tokens import word_bpe
from .words import buffers, slices
from .workspace import Workspace, range_bounds, shuffle_partitions, table

_MAGIC = b"S8B1"


def _pack(path: str, close: int, bounds: list[int]):
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                ids, sizes = bpe.encode([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()], close)
                words, block_words = simple8b.encode(ids, sizes)
                blocks = -(-sizes // simple8b.BLOCK)
                last = np.cumsum(blocks)
                word_at = np.r_[0, np.cumsum(block_words)][np.r_[0, last]]
                raw, lengths = words.astype("<u8").tobytes(), block_words.astype("<u2").tobytes()
                doc = batch.column(0).slice(i, j - i)
                part = np.searchsorted(cuts, np.array(doc.fill_null(-(2**63)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part),
                        doc,
                        pa.array(sizes.astype(np.int64)),
                        _binary(lengths, 2 * np.r_[0, last]),
                        _binary(raw, 8 * word_at),
                    ],
                    ["part", "doc_id", "n", "lengths", "words"],
                )

    return run


def _binary(raw: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def build_shard(doc_ids: list[int | None], sizes: list[int], lengths: list[bytes], words: list[bytes]) -> bytes:
    n, raw, packed = len(doc_ids), b"".join(lengths), b"".join(words)
    head = struct.pack("<3q", n, len(raw) // 2, len(packed) // 8)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([_MAGIC, head, known.tobytes(), ids.tobytes(), np.array(sizes, "<i8").tobytes(), raw, packed])


def read_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, all ids end to end)."""
    if shard[:4] != _MAGIC:
        raise ValueError("not a shard of token ids")
    n, b, w = struct.unpack_from("<3q", shard, 4)
    at = 28
    known = np.frombuffer(shard, np.uint8, n, at)
    ids = np.frombuffer(shard, "<i8", n, at + n)
    sizes = np.frombuffer(shard, "<i8", n, at + 9 * n)
    lengths = np.frombuffer(shard, "<u2", b, at + 17 * n).astype(np.int64)
    words = np.frombuffer(shard, "<u8", w, at + 17 * n + 2 * b)
    return [int(i) if k else None for i, k in zip(ids, known)], sizes, simple8b.decode(words, lengths, sizes)


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        before = weight = seq = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([before]), pa.array([sum(held[1])]), pa.array([build_shard(*held)], pa.binary())], ["part", "seq", "before", "n_ids", "shard"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for doc, n, lengths, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "lengths", "words"))):
                for h, x in zip(held, (doc, n, lengths, words)):
                    h.append(x)
                weight += len(words)
                if weight >= limit:
                    yield out()
                    before, seq, weight, held = before + sum(held[1]), seq + 1, 0, [[], [], [], []]
        if held[0]:
            yield out()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, close: int, ws: Workspace, shard_bytes: int = 1 << 18) -> DataFrame:
    """The written shards (part, seq, before: ids of the part's shards before it, n_ids, shard); parts
    and, in each, seqs ascend with doc_id. docs: (doc_id, text)."""
    parts = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = range_bounds(docs, "doc_id", parts)
    packed = docs.mapInArrow(_pack(path, close, bounds), "part int, doc_id long, n long, lengths binary, words binary")
    ordered = packed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "words")
    return ws.save(ordered.mapInArrow(_shards(shard_bytes), "part int, seq long, before long, n_ids long, shard binary"), "shards")


def _digest(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, shard in zip(*(batch.column(c) for c in ("part", "before", "shard"))):
                docs, sizes, ids = read_shard(shard.as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                start = base[part.as_py()] + before.as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a part, of which there are as many as shuffle partitions
    base, total = {}, 0
    for row in sorted(totals, key=lambda r: r.part):
        base[row.part] = total
        total += row.n
    return shards.select("part", "before", "shard").mapInArrow(_digest(base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, Workspace(spark, "tokenfile"))
    return read_digests(shards)
