"""Operator 5, token counts: rank-synchronous merging over ragged arrays.

Distinct pre-tokens lie end to end as one array of symbols. In every round each pre-token finds its
pair of lowest rank, and all pre-tokens apply theirs at once, at every place where it occurs (of
overlapping places every second one, from the left); pre-tokens with no pair left drop out, and what
survives is counted. Counts of pre-tokens are kept in a bounded memo for each worker.

Rows: a null text counts as empty (0 bytes, 0 tokens). Strings of special tokens inside a text are one
token, as the library takes them by default. Repeated rows each get their own row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Memo, Pretokens, WordBpe, word_bpe
from .words import buffers, slices
from .workspace import table

_NONE = np.int64(2**40)


def surviving(bpe: WordBpe, raw: bytes, size: np.ndarray) -> np.ndarray:
    """How many symbols each pre-token ends with. raw: their bytes end to end; size: bytes of each."""
    symbol = bpe.byte_id[np.frombuffer(raw, np.uint8)]
    head = np.r_[0, np.cumsum(size)[:-1]]
    tail = head + size - 1
    symbol[tail] = bpe.last_id[np.frombuffer(raw, np.uint8)[tail]]
    out = np.array(size, np.int64)
    alive = np.flatnonzero(size > 1)
    keep = np.repeat(size > 1, size)
    symbol, size = symbol[keep], np.array(size)[alive]
    rank = _ranks(bpe, symbol, size)
    while len(alive):
        head = np.r_[0, np.cumsum(size)[:-1]]
        least = np.minimum.reduceat(rank, head)
        done = least == _NONE
        if done.any():
            out[alive[done]] = size[done]
            stay = np.repeat(~done, size)
            symbol, rank, alive, size, least = symbol[stay], rank[stay], alive[~done], size[~done], least[~done]
            if not len(alive):
                break
        hit = rank == np.repeat(least, size)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # overlaps: runs of adjacent places, of which every second one counts
            fresh = np.r_[True, at[1:] != at[:-1] + 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        symbol[at] = bpe.merged[rank[at]]
        gone = np.zeros(len(symbol), bool)
        gone[at + 1] = True
        owner = np.repeat(np.arange(len(size)), size)
        size = size - np.bincount(owner[at], minlength=len(size))
        place = np.cumsum(~gone) - 1
        symbol, rank = symbol[~gone], rank[~gone]
        at = place[at]
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(size) - 1] = True
        touched = np.unique(np.r_[at, at[at > 0] - 1])
        rank[touched] = _NONE
        touched = touched[~last[touched]]
        rank[touched] = _lookup(bpe, symbol[touched], symbol[touched + 1])
    return out


def _lookup(bpe: WordBpe, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a << 20) | b
    at = np.minimum(np.searchsorted(bpe.pair_key, key), len(bpe.pair_key) - 1)
    return np.where(bpe.pair_key[at] == key, bpe.pair_rank[at], _NONE)


def _ranks(bpe: WordBpe, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    rank = np.full(len(symbol), _NONE, np.int64)
    if len(symbol) > 1:
        rank[:-1] = _lookup(bpe, symbol[:-1], symbol[1:])
    rank[np.cumsum(size) - 1] = _NONE
    return rank


_memo: dict[str, Memo] = {}


def count_tokens(bpe: WordBpe, memo: Memo, texts: list[str]) -> np.ndarray:
    def make(found: Pretokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return surviving(bpe, *found.joined(which)), np.ones(len(which), np.int64)

    found = bpe.pretokens(texts)
    each, _ = memo.get(found, make)
    counts = np.diff(np.r_[0, np.cumsum(each, dtype=np.int64)][found.first])
    for i in found.odd:
        pieces = bpe.library_pretokens(texts[i])
        raw = [p for p in pieces if isinstance(p, bytes)]
        counts[i] = len(pieces) - len(raw) + (int(surviving(bpe, b"".join(raw), np.array([len(p) for p in raw])).sum()) if raw else 0)
    return counts


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = word_bpe(path), _memo.setdefault(path, Memo())
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                n = count_tokens(bpe, memo, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
