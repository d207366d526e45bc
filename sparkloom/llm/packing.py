"""Operator 9, packing token sequences: non-negative least squares over length combinations.

A document's ids, closed by an end id, are cut into pieces of the window's size and one rest. The
histogram of rests (at most window lengths, however many documents there are) goes to the driver, which
enumerates shallow combinations of two or three lengths that fill a window, solves for their repeat
counts by non-negative least squares, rounds them within what the histogram has, and packs what is left
greedily. The outcome is a bounded table: the pieces of one length, in rank order, go to consecutive
runs of slots. A piece's rank is its place among the pieces of its length in its part plus the number
in the parts before, so no group of equal lengths is ever brought together.

Rows: a null text counts as empty (the end id alone). Repeated rows are documents of their own. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import byte_bpe
from .workspace import Workspace, table

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def _cut(json_path: str, ranks_path: str, close: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = byte_bpe(json_path, ranks_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows: list[tuple] = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = bpe.encode(text.as_py() or "")
                    n = len(ids) + 1
                    raw = np.append(ids, np.uint32(close)).astype("<u4").tobytes()
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, part, seen[length]))
                        seen[length] += 1
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def combinations(counts: np.ndarray, window: int, leads: int = 512, seconds: int = 48) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window, or come as near as the lengths at hand allow.
    counts: pieces of each length, counts[0] = 0. Leads and seconds bound how many are tried."""
    have = np.flatnonzero(counts)
    have = have[have < window]
    if not len(have):
        return np.zeros((0, 3), np.int64)
    below = np.zeros(window + 1, np.int64)  # the largest length at hand up to each length
    below[have] = have
    below = np.maximum.accumulate(below)
    a = have[np.argsort(-counts[have], kind="stable")][:leads]
    pairs = np.stack([have, below[window - have], np.zeros(len(have), np.int64)], axis=1)
    b = have[np.unique(np.linspace(0, len(have) - 1, min(seconds, len(have))).astype(np.int64))]
    x, y = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
    fits = x + y < window
    x, y = x[fits], y[fits]
    triples = np.stack([x, y, below[window - x - y]], axis=1)
    out = np.unique(np.sort(np.concatenate([pairs, triples]), axis=1)[:, ::-1], axis=0)
    return out[out.sum(axis=1) >= window - window // 128]


def solve(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradients."""
    p, n = len(patterns), len(counts)
    if not p:
        return np.zeros(0)
    flat = patterns.ravel()

    def forward(x):
        out = np.bincount(flat, np.repeat(x, patterns.shape[1]), n)
        out[0] = 0
        return out

    def back(r):
        return r[patterns].sum(axis=1)

    goal = counts.astype(float).copy()
    goal[0] = 0
    use = np.bincount(flat, minlength=n)
    use[0] = 0
    rate = 1.0 / max(1.0, patterns.shape[1] * float(use[patterns].max()))
    x = y = np.zeros(p)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(forward(y) - goal))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) that together use every piece once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        out.append((lengths, n))
        for k, m in Counter(lengths).items():
            left[k] -= n * m

    if left[window]:
        take((window,), int(left[window]))
    patterns = combinations(left, window)
    repeat = solve(patterns, left[: window + 1])
    for i in np.argsort(-repeat, kind="stable"):
        if repeat[i] < 0.5:
            break
        lengths = tuple(int(v) for v in patterns[i] if v)
        n = min([int(repeat[i] + 0.5), *(int(left[k]) // m for k, m in Counter(lengths).items())])
        if n > 0:
            take(lengths, n)
    while left[1:].any():  # each turn uses up one length at least
        have = np.flatnonzero(left)
        lengths = [int(have[-1])]
        room, used = window - lengths[0], Counter(lengths)
        while room > 0:
            fit = [int(v) for v in have[have <= room] if left[v] > used[v]]
            if not fit:
                break
            pick = _best(np.array(fit), room, left, used)
            lengths += pick
            used.update(pick)
            room -= sum(pick)
        take(tuple(lengths), min(int(left[k]) // m for k, m in used.items()))
    return out


def _best(fit: np.ndarray, room: int, left: np.ndarray, used: Counter) -> list[int]:
    """One or two lengths at hand that leave the least room."""
    below = np.zeros(room + 1, np.int64)
    below[fit] = fit
    below = np.maximum.accumulate(below)
    second = below[room - fit]
    same = (second == fit) & np.array([left[v] < used[int(v)] + 2 for v in fit])
    second[same] = below[np.maximum(np.minimum(room - fit[same], fit[same] - 1), 0)]
    i = int(np.argmax(fit + second))
    return [int(fit[i])] if not second[i] else [int(fit[i]), int(second[i])]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: runs of slots for the ranks of a length."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in packed:
        offset = 0
        for k in lengths:
            rows.append((k, rank[k], sequence, offset))
            rank[k] += n
            offset += k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(at: np.ndarray):
    key = (at[:, 0] << 44) + at[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run_ = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = at[run_, 2] + rank - at[run_, 1]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [batch.column(c) if c != "length" else pa.array(length) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(at[run_, 3])], [*keep, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, json_path: str, ranks_path: str, close: int = 1, window: int = 2048, ws: Workspace | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    ws = ws or Workspace(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = ws.save(docs.mapInArrow(_cut(json_path, ranks_path, close, window), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most window rows
        histogram[length] = n
    at = slots(plan(histogram, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(at), out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
