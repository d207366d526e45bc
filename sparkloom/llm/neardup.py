"""Operator 1, near-duplicate documents: a chosen-path set similarity join.

A document is the set of its distinct shingles (runs of five words; all words as one if there are
fewer). Documents with the same set are one vertex. Each vertex has a minwise sketch. In every one of
several independent trees a vertex descends by a few sketch positions that its node chooses, into the
child named by its minwise token there; vertices that agree on much of their sets meet in some node
with near certainty, others hardly ever. Nodes of at most ``node_limit`` vertices are compared
exhaustively by sketch. A larger node takes a leader: vertices near it are tied to it, and only those
that are not well inside its ball go further down (sketch distance is a metric, so a pair that would
be lost has both ends tied). The ties make families, and inside each family links are confirmed on
full sets: exhaustively where the family is small, by leaders and then by blocks where it is large.
No cap is set on partners, nodes or families.

Rows: a null text, or one without words, has an empty set and is linked with nothing. Rows that share
a doc_id are one vertex. A null doc_id is never linked. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .words import Words, buffers, mix, slices, words_of
from .workspace import Workspace, shuffle_partitions, table

_U = np.uint64


@dataclass(frozen=True)
class NearDup:
    """words a shingle; num / den: least similarity; trees, branch (positions a node chooses), depth
    (levels before node sizes count); sketch positions; node_limit and family_limit: most vertices
    that are compared exhaustively in one task; family_weight: most shingles that they may have; near: least sketch agreement of a candidate; stop and
    star: sketch distances to a leader up to which a vertex ends there, and is tied to it; max_levels:
    levels after which a node that is still large is taken as one family (it then is compared in full);
    leaders: rounds of leaders in a large family."""

    words: int = 5
    num: int = 85
    den: int = 100
    trees: int = 3
    branch: int = 3
    depth: int = 2
    sketch: int = 128
    node_limit: int = 1024
    family_limit: int = 1024
    family_weight: int = 4_000_000
    near: float = 0.72
    stop: float = 0.27
    star: float = 0.55
    max_levels: int = 16
    leaders: int = 1
    seed: int = 7

    @property
    def threshold(self) -> float:
        return self.num / self.den


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words inside a row; of rows with 1 to k - 1 words the whole run."""
    h, first = words.hash, words.first
    n = len(h)
    if not n:
        return h, words.row
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total[: n - j] += mix(h[j:] + _U(j + 1)) * _U(2 * j + 1)
    size = np.diff(first)
    whole = words.row[: max(0, n - k + 1)] == words.row[k - 1 :] if n >= k else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    hashes, rows = mix(total[at]), words.row[at]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.array([mix(np.array([sum((int(mix(h[first[r] + j : first[r] + j + 1] + _U(j + 1))[0]) * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF for j in range(size[r])) & 0xFFFFFFFFFFFFFFFF], np.uint64) + _U(0xA5A5 + size[r]))[0] for r in short], np.uint64)
        hashes, rows = np.r_[hashes, extra], np.r_[rows, short]
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        hashes, rows = shingles(words_of(data, offsets[i : j + 1]), k)
        cuts = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            yield np.unique(hashes[cuts[r] : cuts[r + 1]])


def _sketches(sets: list[np.ndarray], p: NearDup) -> np.ndarray:
    """uint16 minwise values, a row for each set; rows of empty sets are 0."""
    out = np.zeros((len(sets), p.sketch), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 2**32, p.sketch, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, p.sketch, dtype=np.uint32)
    values = np.concatenate([sets[i] for i in full]).astype(np.uint32)
    heads = np.r_[0, np.cumsum([len(sets[i]) for i in full])[:-1]]
    for k in range(p.sketch):
        least = np.minimum.reduceat(values * a[k] + b[k], heads)
        out[full, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _sketch_bytes(sketch: np.ndarray) -> np.ndarray:
    """Low bytes of all positions, then high bytes: the first half alone is a sketch of 8 bits."""
    return np.concatenate([(sketch & 0xFF).astype(np.uint8), (sketch >> 8).astype(np.uint8)], axis=1)


def _from_bytes(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(-1, width)


def _describe(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            sets: list[np.ndarray] = []
            start = weight = 0

            def out(start=0):
                sketch = _sketch_bytes(_sketches(sets, p))
                h1 = [int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets]
                h2 = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                return pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), as_long(h1), as_long(h2), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "sketch"],
                )

            for s in sets_of(batch.column(1), p.words):
                sets.append(s)
                weight += len(s)
                if weight > 200_000 or len(sets) >= 4096:
                    yield out(start)
                    start, weight, sets = start + len(sets), 0, []
            if sets:
                yield out(start)

    return run


def _children(nodes: np.ndarray, sketch: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (node, sketch) the nodes one level down, branch for each: (index of its parent row, node)."""
    width = sketch.shape[1]
    offset = (mix(nodes + _U(0x5bd1)) % _U(width)).astype(np.int64)
    rows, out = [], []
    for j in range(branch):
        at = (offset + j * (width // branch)) % width
        token = sketch[np.arange(len(nodes)), at].astype(np.uint64)
        out.append(mix(mix(nodes * _U(31) + at.astype(np.uint64)) + token))
        rows.append(np.arange(len(nodes)))
    return np.concatenate(rows), np.concatenate(out)


def _wide(raw: np.ndarray) -> np.ndarray:
    half = raw.shape[1] // 2
    return raw[:, :half].astype(np.uint16) | (raw[:, half:].astype(np.uint16) << 8)


def _plant(p: NearDup):
    """(rep, sketch) -> (node, rep): where each vertex stands after the first levels of every tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            sketch = _wide(_from_bytes(batch.column(1), 2 * p.sketch))
            for tree in range(p.trees):
                rows, nodes = np.arange(len(rep)), mix(np.full(len(rep), p.seed * 1000 + tree, np.uint64))
                for _ in range(p.depth):
                    up, nodes = _children(nodes, sketch[rows], p.branch)
                    rows = rows[up]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(rep[rows])], ["node", "rep"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return heads, np.r_[heads[1:], len(keys)]


def _compare_nodes(p: NearDup):
    """(node, rep, s8) sorted by node -> ties (a, b): each set of vertices that sketch agreement connects, as a star."""

    def ties(rep: np.ndarray, s8: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        label = np.arange(len(rep))
        sizes = tails - heads
        need = int(np.ceil(p.near * s8.shape[1]))
        left, right = [], []
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            for part in np.array_split(heads[sizes == size], max(1, int((sizes == size).sum() * len(i) / 200_000))):
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                for x in range(0, len(a), 100_000):
                    u, v = a[x : x + 100_000], b[x : x + 100_000]
                    ok = (s8[u] == s8[v]).sum(axis=1, dtype=np.int32) >= need
                    left.append(u[ok])
                    right.append(v[ok])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            while len(a):
                low = np.minimum(label[a], label[b])
                changed = (label[a] != low) | (label[b] != low)
                if not changed.any():
                    break
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
        mine = np.flatnonzero(label != np.arange(len(rep)))
        return np.unique(np.stack([rep[mine], rep[label[mine]]], axis=1), axis=0)

    def run(batches):
        for part in _groups(batches, "node"):
            part = part.combine_chunks()
            keys = part.column("node").to_numpy()
            rep = part.column("rep").to_numpy()
            s8 = _from_bytes(part.column("s8"), p.sketch)
            heads, tails = _spans(keys)
            e = ties(rep, s8, heads, tails)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def _descend(p: NearDup, last: bool):
    """(node, rep, sketch, leader, lead8) -> ties to the leader (node null) and places one level down (b null)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            raw = _from_bytes(batch.column("sketch"), 2 * p.sketch)
            lead = _from_bytes(batch.column("lead8"), p.sketch)
            leader = batch.column("leader").to_numpy(zero_copy_only=False)
            far = 1 - (raw[:, : p.sketch] == lead).mean(axis=1)
            tied = (far <= p.star) & (rep != leader) if not last else rep != leader
            yield _rows(None, rep[tied], leader[tied])
            on = (far > p.stop) & (rep != leader)
            if on.any() and not last:
                up, nodes = _children(node[on], _wide(raw[on]), p.branch)
                yield _rows(nodes.view(np.int64), rep[on][up], None)

    def _rows(node, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if node is None else pa.array(node), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b)], ["node", "a", "b"])

    return run


class _Union:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.label[self.label == max(a, b)] = min(a, b)
        return True


def link_sets(sets: list[np.ndarray], s8: np.ndarray, p: NearDup, left: np.ndarray | None = None, start: np.ndarray | None = None, lead: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links, confirmed on the sets, that connect all that any link connects. left: rows of which one
    end must be (all by default); start: labels of rows already known to be connected; lead: distances
    to one common leader, by which the triangle inequality spares pairs."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    union = _Union(n)
    if start is not None:
        first = {}
        union.label = np.array([first.setdefault(x, i) for i, x in enumerate(start)])
    t, slack = p.threshold, 1 - p.threshold + 1e-9
    found = []
    rows = np.arange(n) if left is None else left
    done = np.zeros(n, bool)
    for i in rows:
        done[i] = True
        maybe = ~done & (union.label != union.label[i]) & (size >= t * size[i]) & (size * t <= size[i])
        if lead is not None:
            maybe &= np.abs(lead - lead[i]) <= slack
        other = np.flatnonzero(maybe)
        if not len(other):
            continue
        own = sets[i]
        for part in np.array_split(other, max(1, int(size[other].sum() / 500_000))):
            part = part[union.label[part] != union.label[i]]
            if not len(part):
                continue
            flat = np.concatenate([sets[j] for j in part])
            heads = np.r_[0, np.cumsum(size[part])[:-1]]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), heads)
            for j in part[p.den * common >= p.num * (size[i] + size[part] - common)]:
                if union.join(i, j):
                    found.append((int(i), int(j)))
    return found


def _link_families(p: NearDup):
    """(g, rep, text, s8) sorted by g -> links (a, b)."""

    def run(batches):
        for part in _groups(batches, "g"):
            part = part.combine_chunks()
            heads, tails = _spans(part.column("g").to_numpy())
            rep = part.column("rep").to_numpy()
            s8 = _from_bytes(part.column("s8"), p.sketch)
            out, at = [], 0
            feed = sets_of(part.column("text").combine_chunks() if isinstance(part.column("text"), pa.ChunkedArray) else part.column("text"), p.words)
            for h, t in zip(heads, tails):
                sets = [next(feed) for _ in range(t - h)]
                out += [(rep[h + i], rep[h + j]) for i, j in link_sets(sets, s8[h:t], p)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in out], pa.int64()), pa.array([int(b) for _, b in out], pa.int64())], ["a", "b"])

    return run


def _to_sets(p: NearDup):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sets = [s.tobytes() for s in sets_of(batch.column("text"), p.words)]
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("rep"), batch.column("s8"), pa.array(sets, pa.binary())], ["g", "rep", "s8", "items"])

    return run


def _to_leader(batches):
    """(g, rep, items, leader, lead_items) -> (g, rep, leader, common, size, lead_size)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        common, sizes, leads = [], [], []
        for a, b in zip(batch.column("items").to_pylist(), batch.column("lead_items").to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
            sizes.append(len(x))
            leads.append(len(y))
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("rep"), batch.column("leader"), *(pa.array(v, pa.int64()) for v in (common, sizes, leads))], ["g", "rep", "leader", "common", "size", "lead_size"])


def _link_blocks(p: NearDup):
    """(pair, side, rep, comp, lead, s8, items) sorted by pair -> links; side 0 against all."""

    def run(batches):
        for part in _groups(batches, "pair"):
            part = part.combine_chunks()
            heads, tails = _spans(part.column("pair").to_numpy())
            rep, side, comp, lead = (part.column(c).to_numpy() for c in ("rep", "side", "comp", "lead"))
            s8 = _from_bytes(part.column("s8"), p.sketch)
            items = part.column("items")
            out = []
            for h, t in zip(heads, tails):
                sets = [np.frombuffer(items[i].as_py(), np.uint64) for i in range(h, t)]
                out += [(rep[h + i], rep[h + j]) for i, j in link_sets(sets, s8[h:t], p, np.flatnonzero(side[h:t] == 0), comp[h:t], lead[h:t])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in out], pa.int64()), pa.array([int(b) for _, b in out], pa.int64())], ["a", "b"])

    return run


def _in_full(p: NearDup) -> Column:
    """Whether a family of m vertices with w shingles is compared in one piece; beyond, it is cut into blocks."""
    return (F.col("m") <= p.family_limit) & (F.col("w") <= p.family_weight)


def _sized(nodes: DataFrame) -> DataFrame:
    """nodes (node, rep) of nodes that hold more than one vertex, with the number m."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    return nodes.join(sizes, "node")


def _settled(ws: Workspace, nodes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written nodes of more than one vertex, and the size of the largest."""
    seen = Observation()
    out = ws.narrow(_sized(nodes).observe(seen, F.max("m").alias("most")), name)
    return out, seen.get["most"] or 0


def _large_families(ws: Workspace, members: DataFrame, p: NearDup, parts: int) -> DataFrame:
    """Links within families beyond family_limit. Rounds of leaders link most of a family at linear
    cost; all that the first leader doesn't link is then compared with the whole family, block by block,
    but for pairs that are connected already or too far apart by their distances to that leader."""
    sets = ws.save(members.mapInArrow(_to_sets(p), "g long, rep long, s8 binary, items binary"), "big_sets")
    open_, links, lead1 = sets.select("g", "rep"), [], None
    for r in range(p.leaders):
        leader = open_.groupBy("g").agg(F.min(F.struct(F.xxhash64(F.lit(r), "rep").alias("k"), "rep")).alias("l")).select("g", F.col("l.rep").alias("leader"))
        lead = leader.join(sets.select("g", F.col("rep").alias("leader"), F.col("items").alias("lead_items")), ["g", "leader"])
        tested = ws.narrow(sets.join(open_, ["g", "rep"], "left_semi").join(lead, "g").select("g", "rep", "items", "leader", "lead_items").mapInArrow(_to_leader, "g long, rep long, leader long, common long, size long, lead_size long"), f"big_lead{r}")
        linked = F.col("common") * p.den >= (F.col("size") + F.col("lead_size") - F.col("common")) * p.num
        links.append(tested.where(linked & (F.col("rep") != F.col("leader"))).select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        if r == 0:
            apart = tested.where(~linked).select("g", "rep")  # only pairs of two that leader 1 links are connected for sure
            lead1 = tested.select("g", "rep", (1 - F.col("common") / (F.col("size") + F.col("lead_size") - F.col("common"))).alias("lead"))
        open_ = tested.where(~linked).select("g", "rep")
    stars = links[0]
    for more in links[1:]:
        stars = stars.union(more)
    comp = stars.groupBy("a").agg(F.min("b").alias("comp"))
    open_ = ws.narrow(apart, "big_open")
    weight = sets.select("g", "rep", (F.length("items") / 8).cast("long").alias("w"))
    each = weight.withColumn("o", F.lit(0)).union(open_.join(weight, ["g", "rep"]).select("g", "rep", "w", F.lit(1).alias("o")))
    blocks = lambda o: F.greatest(F.ceil(F.sum(F.when(F.col("o") == o, 1)) / p.family_limit), F.ceil(F.sum(F.when(F.col("o") == o, F.col("w"))) / p.family_weight))
    count = ws.narrow(each.groupBy("g").agg(blocks(0).alias("nt"), blocks(1).alias("no")).where("no > 0"), "big_count")
    full = sets.join(lead1, ["g", "rep"]).join(comp.withColumnRenamed("a", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(count, "g")
    cut = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    pair = lambda o, t: F.xxhash64("g", o, t)
    cols = ["rep", "comp", "lead", "s8", "items"]
    target = full.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1))).select(pair(F.col("o"), cut("nt")).alias("pair"), F.lit(1).alias("side"), *cols)
    source = full.join(open_, ["g", "rep"], "left_semi").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1))).select(pair(cut("no"), F.col("t")).alias("pair"), F.lit(0).alias("side"), *cols)
    pairs = source.union(target).repartition(parts, "pair").sortWithinPartitions("pair", "side", "rep")
    return ws.narrow(pairs.mapInArrow(_link_blocks(p), "a long, b long"), "big_links").union(stars)


def near_duplicates(spark: SparkSession, docs: DataFrame, params: NearDup = NearDup(), ws: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    p, ws = params, ws or Workspace(spark, "neardup")
    parts = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = Observation()
    rows = ws.save(docs.mapInArrow(_describe(p), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary").observe(seen, F.count(F.lit(1)).alias("n")), "rows")
    ws.sized_for(seen.get["n"])
    reps = ws.narrow(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sketch", "n_shingles")).alias("x")).select("h1", "h2", F.col("x.doc_id").alias("rep"), F.col("x.sketch").alias("sketch"), F.col("x.n_shingles").alias("w")), "reps")
    sketch = reps.select("rep", "sketch")
    short = F.substring("sketch", 1, p.sketch).alias("s8")

    members, most = _settled(ws, sketch.mapInArrow(_plant(p), "node long, rep long"), "nodes0")
    small, ties, level, held = [], [], 0, ["nodes0"]
    while True:
        small.append(members.where(F.col("m") <= p.node_limit).select("node", "rep"))
        if most <= p.node_limit:
            break
        big = members.where(F.col("m") > p.node_limit)
        level += 1
        seen = big.join(sketch, "rep").select("node", "rep", "sketch")
        lead = seen.groupBy("node").agg(F.min(F.struct(F.xxhash64("rep").alias("k"), "rep", short)).alias("l")).select("node", F.col("l.rep").alias("leader"), F.col("l.s8").alias("lead8"))
        down = ws.narrow(seen.join(lead, "node").mapInArrow(_descend(p, level >= p.max_levels), "node long, a long, b long"), f"down{level}")
        ties.append(down.where("node is null").select("a", "b").distinct())
        members, most = _settled(ws, down.where("node is not null").select("node", F.col("a").alias("rep")), f"nodes{level}")
        held += [f"down{level}", f"nodes{level}"]
    placed = small[0]
    for s in small[1:]:
        placed = placed.union(s)
    placed = placed.join(reps.select("rep", short), "rep").select("node", "rep", "s8").repartition(parts, "node").sortWithinPartitions("node", "rep")
    tied = placed.mapInArrow(_compare_nodes(p), "a long, b long")
    for t in ties:
        tied = tied.union(t)
    family = ws.narrow(components(ws, tied, "ties").select(F.col("id").alias("rep"), F.col("component").alias("g")), "family")
    ws.drop(*held)

    known = family.join(reps.select("rep", "w", short), "rep")
    sizes = known.groupBy("g").agg(F.count("*").alias("m"), F.sum("w").alias("w"))
    known = known.drop("w").join(sizes, "g")
    texts = docs.withColumnRenamed("doc_id", "rep").join(known, "rep").select("g", "m", "w", "rep", "text", "s8")
    texts = ws.save(texts, "texts")
    links = texts.where(_in_full(p)).select("g", "rep", "text", "s8").repartition(parts, "g").sortWithinPartitions("g", "rep").mapInArrow(_link_families(p), "a long, b long")
    big = texts.where(~_in_full(p)).select("g", "rep", "text", "s8")
    if not big.isEmpty():
        links = links.union(_large_families(ws, big, p, parts))
    linked = ws.narrow(components(ws, links, "links"), "linked")
    ws.drop("texts", "big_sets")

    placed = rows.select("doc_id", "n_shingles", "h1", "h2").join(reps.select("h1", "h2", "rep").join(linked.withColumnRenamed("id", "rep"), "rep", "left"), ["h1", "h2"], "left")
    out = placed.select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id").alias("component_id"))
    out = ws.narrow(out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    ws.drop("rows", "reps", "family", "linked")
    return out


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
