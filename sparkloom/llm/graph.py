"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .workspace import Workspace


def _directed(edges: DataFrame) -> DataFrame:
    """(hi, lo) with hi > lo, each once."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the least of its neighbours and itself."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
    far = both.where("v > u").join(least, "u")
    return far.select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is tied to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    near = edges.where("lo is not null").join(least, "hi").where("lo != m")
    return near.select(F.col("lo").alias("a"), F.col("m").alias("b")).union(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every vertex that has an edge; component is the smallest id it reaches.

    edges: (a, b), both of one integer type. Hot vertices are safe: minima are combined before the
    shuffle, and the joins back are plain equi-joins that adaptive execution may split."""
    first = ws.narrow(_directed(edges), f"{name}_edges")
    current, state = _measured(ws, _directed(_small_star(first)), f"{name}_0")
    ws.drop(f"{name}_edges")
    rounds, last = 0, None
    while state != last and state[0]:
        last = state
        rounds += 1
        current, state = _measured(ws, _directed(_small_star(_large_star(current))), f"{name}_{rounds}")
        ws.drop(f"{name}_{rounds - 1}")
    stars = current.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _measured(ws: Workspace, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written edges, with their number and the sum of their hashes, taken while they are written."""
    seen = Observation()
    found = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    out = ws.narrow(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(found).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])
