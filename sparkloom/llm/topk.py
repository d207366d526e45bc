"""Operator 2, exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Every component x becomes the integer floor(scale * x). Rows are dealt into blocks of bounded size; a
block holds, for each dimension, its rows in the order of that component. For a query the lists are
read from the end that its component favours, and rows that appear are scored in full. Lists are read
unevenly: each step goes down those whose next entries lower the bound most. The bound is the greatest
score of a row that stands, in every list, behind what was read, and is no longer than the block's
longest row; it is found exactly by filling components up to their places in the lists. Reading stops
when the bound can't beat the k-th score, or when no row is left unseen. Nothing else ends it. Queries
are a stated set and are dealt into blocks too; each pair of blocks is one task.

Rows: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
with a null vec_id. Rows of one vec_id count once, as the least vector. Vectors of another length than
the query's aren't its candidates. Scores beyond 64 bits are held at the ends of the range. Ties go
to the smaller vec_id. A query with fewer than k candidates returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neardup import _groups
from .workspace import table

#: Components up to here keep every partial sum of 2**13 products exact in 64 bits.
_SAFE = 2**25
_TOP = 2**63 - 1


class Lists:
    """One block's rows and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(rows, self.order, axis=0)
        # products that are exact as doubles are summed as such, which is several times faster
        self.exact = rows.astype(np.float64) if dims_fit(rows) else rows
        self.longest = float((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))  #: squared

    def best(self, query_id: int, query: np.ndarray, k: int, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with the query's id. Sets read, the entries read of
        all lists, and stopped, whether the bound ended it."""
        n, dims = self.rows.shape
        step, width = step or max(8, n // 32), max(1, dims // 4)
        up, weight, axis = query >= 0, np.abs(query).astype(np.float64), np.arange(dims)
        asked = query.astype(np.float64) if self.exact is not self.rows and np.abs(query).max(initial=0) <= 2**20 else query
        depth = np.zeros(dims, np.int64)
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, "right")] = True
        top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.read, self.stopped = 0, False
        edge = self._edge(depth, up, axis)
        while not seen.all():
            if len(top) == k and top[-1] > bound(weight, edge, self.longest):
                self.stopped = True
                break
            gain = weight * (edge - self._edge(np.minimum(depth + step, n - 1), up, axis))
            lists = np.argsort(-gain, kind="stable")[:width]
            place = np.minimum(depth[lists][:, None] + np.arange(step), n - 1)
            found = self.order[np.where(up[lists][:, None], n - 1 - place, place), lists[:, None]]
            new = np.zeros(n, bool)
            new[found.ravel()] = True
            at = np.flatnonzero(new & ~seen)
            seen[at] = True
            top_ids, top = _keep(np.r_[top_ids, self.ids[at]], np.r_[top, ((self.exact if asked is not query else self.rows)[at] @ asked).astype(np.int64)], k)
            after = np.minimum(depth[lists] + step, n - 1)
            self.read += int((after - depth[lists]).sum())
            depth[lists] = after
            edge = self._edge(depth, up, axis)
        return top_ids, top

    def _edge(self, depth: np.ndarray, up: np.ndarray, axis: np.ndarray) -> np.ndarray:
        """Of each list the next entry's component, in the direction that the query favours."""
        n = len(self.rows)
        value = self.sorted[np.where(up, n - 1 - depth, depth), axis].astype(np.float64)
        return np.where(up, value, -value)


def dims_fit(rows: np.ndarray) -> bool:
    """Whether inner products with components of up to 2**20 stay below 2**53."""
    return int(np.abs(rows).max(initial=0)) * (1 << 20) * max(1, rows.shape[1]) < 2**53


def bound(weight: np.ndarray, edge: np.ndarray, longest: float) -> float:
    """At least the greatest weight . x over all x <= edge with |x|^2 <= longest (weight >= 0): components
    grow in proportion to their weights until each meets its edge, or the length is used up."""
    low = edge <= 0
    sure = float((weight[low] * edge[low]).sum())
    left = longest - float((edge[low & (weight > 0)] ** 2).sum())
    w, e = weight[~low & (weight > 0)], edge[~low & (weight > 0)]
    order = np.argsort(e / w, kind="stable")
    w, e = w[order], e[order]
    rest = np.cumsum((w * w)[::-1])[::-1]  # squares of weights from each place on
    used = np.cumsum(e * e)
    over = np.flatnonzero(used - e * e + (e / w) ** 2 * rest > left)
    if not len(over):
        best = float((w * e).sum())
    else:
        i = int(over[0])
        best = float((w[:i] * e[:i]).sum()) + float(np.sqrt(max(0.0, left - (used[i] - e[i] ** 2)) * rest[i]))
    return sure + best + 1.0 + 1e-9 * (abs(sure) + abs(best))


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _exact(ids: np.ndarray, rows: list[list[int]], query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    """For components too large for 64 bits: every row scored by Python's integers."""
    scored = [(-max(-_TOP - 1, min(_TOP, sum(a * b for a, b in zip(r, query)))), int(i)) for i, r in zip(ids, rows) if i != query_id]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def _block_topk(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "cell"):
            part = part.combine_chunks()
            cell, is_query, ids = (part.column(c).to_numpy() for c in ("cell", "is_query", "vec_id"))
            vectors = part.column("v").combine_chunks() if isinstance(part.column("v"), pa.ChunkedArray) else part.column("v")
            lengths = np.diff(vectors.offsets.to_numpy())
            heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            out: list[tuple[int, int, int]] = []
            for h, t in zip(heads, np.r_[heads[1:], len(cell)]):
                for dims in np.unique(lengths[h:t]):
                    at = h + np.flatnonzero(lengths[h:t] == dims)
                    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    values = np.floor(flat * scale).reshape(-1, dims)
                    asks, own = is_query[at] == 1, ids[at]
                    first = np.r_[True, (own[1:] != own[:-1]) | (asks[1:] != asks[:-1])]
                    q, c = asks & first, ~asks & first
                    if np.abs(values).max(initial=0) < _SAFE and dims <= 2**13:
                        values = values.astype(np.int64)
                        lists = Lists(own[c], values[c]) if c.any() else None
                        for i in np.flatnonzero(q) if lists else ():
                            got, scores = lists.best(int(own[i]), values[i], k)
                            out += zip([int(own[i])] * len(got), got.tolist(), scores.tolist())
                    else:
                        rows = [[int(x) for x in r] for r in values]
                        held = [rows[i] for i in np.flatnonzero(c)]
                        for i in np.flatnonzero(q):
                            out += [(int(own[i]), a, s) for a, s in _exact(own[c], held, int(own[i]), rows[i], k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def exact_topk(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int | None = None, query_block: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) that is_query marks.

    block, query_block: rows of a block of candidates and of queries; they bound a task's memory. By
    default both hold block_bytes of components, candidates fewer where that would leave cores idle.
    Candidates are read once for each block of queries, so both are as large as memory allows."""
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & valid)
    n, asked, dims = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("embedding"))).first()
    most = max(256, block_bytes // (8 * (dims or 1)))
    block = block or min(most, max(1024, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    nb, nq = max(1, -(-n // block)), max(1, -(-asked // (query_block or most)))
    of = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    held = rows.select(of(nb).alias("b"), every(nq).alias("a"), F.lit(0).alias("is_query"), "vec_id", F.col("embedding").alias("v"))
    asks = rows.where("q").select(every(nb).alias("b"), of(nq).alias("a"), F.lit(1).alias("is_query"), "vec_id", F.col("embedding").alias("v"))
    cells = held.union(asks).select((F.col("b") * nq + F.col("a")).cast("int").alias("cell"), "is_query", "vec_id", "v")
    cells = cells.repartitionById(nb * nq, F.col("cell")).sortWithinPartitions("cell", "is_query", "vec_id", "v")
    part = cells.mapInArrow(_block_topk(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
