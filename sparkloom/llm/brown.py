"""Operator 4, language-model scores: a class-based bigram model with exchange clustering.

Training counts every token of the training documents (words and one end token a text). Words with a
share of at least ``head`` of all tokens are head words; there are at most 1 / head of them, which
bounds what is broadcast. Words with a share of at least ``core`` are clustered, the ``most_core`` most
frequent of them if there are more, which bounds the bigrams that come to the driver (its square): starting from frequency order they are moved one at a time to the class that most raises the likelihood
of the class bigrams, until no move helps or ``rounds`` are over; the other words meanwhile stand in classes
by shape (their last byte, and whether they hold signs beyond ASCII). Then every other word of the training
documents, however rare, goes to the cluster that by its own bigrams with these classes raises the likelihood
most (one distributed pass), and class bigrams are counted anew. A word unseen in training takes the cluster
that most words of its shape outside the core have. The end token is a class of its own.

log10 P(text) is the sum over tokens of log10 P(class | previous class) + log10 P(word | class). Class
transitions are interpolated with class frequencies by Witten-Bell weights; emissions are (c + 1) /
(n + v + 1) with n tokens and v distinct words of the class and one place for unseen words, so all
probabilities over the vocabulary and the unseen sum to one. The first token follows the end token.

Classes and counts of head words are broadcast. Those of the others come by equi-join on the word to each
document that holds them. The class of every token is then written, a byte each, counted and scored.

Rows: a null text counts as empty (the end token alone). A null doc_id counts as an empty one for the
split. Repeated rows each get their row. Texts meet their rarer words by a 64-bit key; where two texts share
one, each finds the other's words beside its own and takes only its own. Without training documents N and V are 0 and scores follow the
same formulas. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .neardup import _groups
from .words import Tally, Words, buffers, count_by, slices, words_of
from .workspace import Workspace, shuffle_partitions, table

_U = np.uint64
END = _U(0x1D5EED5EED5EED01)  #: stands for the end token among the word hashes


@dataclass(frozen=True)
class Brown:
    """head, core: least shares of all tokens; classes of clustered words; shapes of the others."""

    head: float = 1e-6
    core: float = 1.5e-4
    most_core: int = 2000
    classes: int = 48
    shapes: int = 64
    rounds: int = 12


def shape_of(w: Words, p: Brown) -> np.ndarray:
    """A class by form, 0 to p.shapes - 1, of every word."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    high = np.r_[0, np.cumsum(w.data >= 128)]
    beyond = high[w.end] > high[w.start]
    last = w.data[w.end - 1].astype(np.int64)
    prior = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    alpha = (last >= 97) & (last <= 122)
    kind = np.where(alpha, last - 97, np.where(last >= 128, 26, np.where((last >= 48) & (last <= 57), 27, np.where((prior >= 97) & (prior <= 122), 28 + (last % 2), 30 + (prior >= 128)))))
    return np.minimum(2 * kind + beyond, p.shapes - 1)


def training(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != part


def _vocabulary(p: Brown):
    """text -> (word, shape, n) as far as this task has read; the end token once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, texts = Tally(500_000), 0

        def out(words, n):
            # the shape rides in the low bits while counting; it is a function of the word
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shapes_of(words), pa.int16()), pa.array(n.astype(np.int64))], ["word", "shape", "n"])

        known: dict[str, list] = {"word": [], "shape": []}

        def shapes_of(words):
            keys, values = np.concatenate(known["word"]), np.concatenate(known["shape"])
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            return values[np.searchsorted(keys, words)]

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            texts += batch.num_rows
            for i, j in slices(offsets):
                w = words_of(data, offsets[i : j + 1])
                words, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                tally.add(words, n)
                known["word"].append(words)
                known["shape"].append(shape_of(w, p)[at].astype(np.int16))
                if sum(map(len, known["word"])) > 1_000_000:
                    yield out(*tally.take())
                    known = {"word": [], "shape": []}
        if known["word"]:
            yield out(*tally.take())
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([int(END)], pa.int64()), pa.array([-1], pa.int16()), pa.array([texts], pa.int64())], ["word", "shape", "n"])
        known.clear()
        pa.default_memory_pool().release_unused()

    return run


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of every token among words, or -1 for an end; its row): each text's words, then its end."""
    rows = len(w.first) - 1
    n = len(w.hash)
    at = np.full(n + rows, -1, np.int64)
    row = np.empty(n + rows, np.int64)
    spot = np.arange(n) + w.row
    at[spot] = np.arange(n)
    row[spot] = w.row
    row[w.first[1:] + np.arange(rows)] = np.arange(rows)
    return at, row


def _units(w: Words, core: np.ndarray, p: Brown) -> np.ndarray:
    """Of every token of _sequence its unit: a core word (0 up), a shape, or the end (last)."""
    at, _ = _sequence(w)
    unit = np.full(len(at), len(core) + p.shapes, np.int64)
    if len(w.hash):
        place = np.minimum(np.searchsorted(core, w.hash), max(0, len(core) - 1))
        known = core[place] == w.hash if len(core) else np.zeros(len(w.hash), bool)
        of = np.where(known, place, len(core) + shape_of(w, p))
        unit[at >= 0] = of[at[at >= 0]]
    return unit


def _bigrams(core, p: Brown):
    """text -> (pair of units, n); the pairs are bounded by the number of units squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = core.value
        units = len(words) + p.shapes + 1
        tally = Tally()
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                w = words_of(data, offsets[i : j + 1])
                unit = _units(w, words, p)
                before = np.r_[units - 1, unit[:-1]]  # what follows an end begins a text
                tally.add(*count_by(before * units + unit))
        pair, n = tally.take()
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def exchange(counts: np.ndarray, size: int, classes: int, rounds: int) -> np.ndarray:
    """Class of every unit. The first size units are clustered into classes by exchange; every other
    unit is a class of its own, after them. counts: bigrams of units."""
    units = len(counts)
    classes = min(classes, size)
    of = np.r_[np.arange(size) % max(classes, 1), classes + np.arange(units - size)]
    k = classes + units - size
    counts = counts.astype(np.float64)
    right = np.zeros((units, k))  # how often each unit is followed by each class
    left = np.zeros((units, k))
    for u in range(units):
        right[:, of[u]] += counts[:, u]
        left[:, of[u]] += counts[u, :]
    table_ = np.zeros((k, k))
    np.add.at(table_, of, right)
    total = counts.sum(axis=1)
    log = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds if classes > 1 else 0):
        moved = 0
        for u in np.argsort(-total[:size], kind="stable"):
            a = of[u]
            r, b, own = right[u].copy(), left[u].copy(), counts[u, u]
            # take the unit out of its class
            table_[a, :] -= r
            table_[:, a] -= b
            table_[a, a] += own
            r[a] -= own
            b[a] -= own
            row, col = table_.sum(axis=1)[:classes], table_.sum(axis=0)[:classes]
            inner = table_[:classes]
            outer = table_[:, :classes]
            # what the class bigrams' log-likelihood gains with the unit in each class
            gain = (log(inner + r) - log(inner)).sum(axis=1) + (log(outer.T + b) - log(outer.T)).sum(axis=1)
            at = np.arange(classes)
            diagonal = table_[at, at]
            gain += log(diagonal + r[:classes] + b[:classes] + own) - log(diagonal)
            gain -= (log(diagonal + r[:classes]) - log(diagonal)) + (log(diagonal + b[:classes]) - log(diagonal))
            out_n, in_n = counts[u].sum(), counts[:, u].sum()
            gain -= log(row + out_n) - log(row) + log(col + in_n) - log(col)
            c = int(np.argmax(gain))
            c = c if gain[c] > gain[a] + 1e-6 else a
            table_[c, :] += r
            table_[:, c] += b
            table_[c, c] += own
            if c != a:
                right[:, a] -= counts[:, u]
                right[:, c] += counts[:, u]
                left[:, a] -= counts[u, :]
                left[:, c] += counts[u, :]
                of[u] = c
                moved += 1
        if not moved:
            break
    return of


class Model:
    """What scoring needs of bounded size. Classes: clusters, then shapes, then the end."""

    def __init__(self, head: np.ndarray, head_n: np.ndarray, core: np.ndarray, of: np.ndarray, transitions: np.ndarray, n: np.ndarray, v: np.ndarray, total: int, distinct: int, ends: int, p: Brown):
        self.head, self.head_n, self.core, self.of, self.p = head, head_n, core, of, p
        self.total, self.distinct, self.ends = total, distinct, ends
        self.counts, self.transition = transitions, _smooth(transitions)
        self.n, self.v = n, v

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


def _smooth(counts: np.ndarray) -> np.ndarray:
    """log10 of the interpolated transition probabilities."""
    k = len(counts)
    prior = (counts.sum(axis=0) + 1) / (counts.sum() + k)
    n, kinds = counts.sum(axis=1, keepdims=True), np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
    return np.log10((counts + kinds * prior) / (n + kinds))


def _contexts(model, limit: int = 1_000_000):
    """text -> (word, slot, n) of words outside the core: how often each class stands before (slot below
    the number of classes) and after the word, added up over about limit rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k, size = len(m.counts), len(m.core)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            word, slot = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(word)
            word, slot = word[order], slot[order]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key, n = np.unique(np.repeat(np.arange(len(heads)) * (2 * k), np.diff(np.r_[heads, len(word)])) + slot, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word[heads][key // (2 * k)].view(np.int64)), pa.array((key % (2 * k)).astype(np.int16)), pa.array(n)], ["word", "slot", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                w = words_of(data, offsets[i : j + 1])
                at, _ = _sequence(w)
                unit = _units(w, m.core, m.p)
                c = m.of[unit]
                spot = np.flatnonzero((unit >= size) & (at >= 0))
                if not len(spot):
                    continue
                before = np.r_[m.of[-1], c[:-1]][spot]
                after = c[spot + 1]  # a word is never last, each text has its end
                word = w.hash[at[spot]]
                held.append((np.r_[word, word], np.r_[before, k + after].astype(np.int16)))
                if sum(len(x[0]) for x in held) > limit:
                    yield out()
        if held:
            yield out()

    return run


def best_class(counts: np.ndarray, clusters: int, head: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each word the cluster that raises the likelihood of the class bigrams counts most. The rows of
    word i (slot as in _contexts, n) begin at head[i]."""
    k = len(counts)
    log = lambda x: x * np.log(np.maximum(x, 1e-300))
    base = np.concatenate([counts[:, :clusters], counts[:clusters].T]).astype(float)
    known, row, col = log(base), counts.sum(axis=1)[:clusters], counts.sum(axis=0)[:clusters]
    tail, out, x = np.r_[head[1:], len(slot)], np.zeros(len(head), np.int64), 0
    while x < len(head):
        y = max(x + 1, int(np.searchsorted(tail, head[x] + 50_000, "right")))
        part = slice(head[x], tail[y - 1])
        gain = np.add.reduceat(log(base[slot[part]] + n[part, None]) - known[slot[part]], head[x:y] - head[x], axis=0)
        total = np.add.reduceat(np.where(slot[part] < k, n[part], 0), head[x:y] - head[x])[:, None]
        gain -= log(row + total) - log(row) + log(col + total) - log(col)
        out[x:y] = gain.argmax(axis=1)
        x = y
    return out


def _assign(model):
    """(word, slot, n) sorted by word -> (word, class)."""

    def run(batches):
        m: Model = model.value
        k = len(m.counts)
        for part in _groups(batches, "word"):
            word, slot, n = (part.column(c).to_numpy() for c in ("word", "slot", "n"))
            of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            key, n = count_by(of * (2 * k) + slot, n)
            head = np.flatnonzero(np.r_[True, key[1:] // (2 * k) != key[:-1] // (2 * k)])
            names = word[np.flatnonzero(np.r_[True, of[1:] != of[:-1]])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best_class(m.counts, m.clusters, head, key % (2 * k), n).astype(np.int16))], ["word", "class"])

    return run


def _rare(model):
    """(key, text) -> (key, word): the words of each text that are not broadcast."""

    def run(batches):
        head = model.value.head
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                w = words_of(data, offsets[i : j + 1])
                at = np.minimum(np.searchsorted(head, w.hash), max(0, len(head) - 1))
                rest = np.flatnonzero(head[at] != w.hash) if len(head) else np.arange(len(w.hash))
                order = rest[np.lexsort((w.hash[rest], w.row[rest]))]
                row, word = w.row[order], w.hash[order]
                if len(order):
                    one = np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i + row[one]]), pa.array(word[one].view(np.int64))], ["key", "word"])

    return run


def _encode(model):
    """(doc_id, train, text, rare) -> what scoring needs: counts, the base score, the sum of the log10 of
    the numerators of all emissions, and the class of every token as a byte."""

    def run(batches):
        m: Model = model.value
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            rare = batch.column(3)
            for i, j in slices(offsets):
                w = words_of(data, offsets[i : j + 1])
                count, c = np.zeros(len(w.hash), np.int64), m.unseen[shape_of(w, m.p)]
                if len(m.head) and len(w.hash):
                    at = np.minimum(np.searchsorted(m.head, w.hash), len(m.head) - 1)
                    hit = m.head[at] == w.hash
                    count[hit], c[hit] = m.head_n[at[hit]], m.head_of[at[hit]]
                own = rare.slice(i, j - i).flatten()
                if len(own) and len(w.hash):
                    word, of, n = (own.field(f).to_numpy(zero_copy_only=False) for f in range(3))
                    word, first = np.unique(word.view(np.uint64), return_index=True)  # a word has one class in every text
                    at = np.minimum(np.searchsorted(word, w.hash), len(word) - 1)
                    hit = word[at] == w.hash
                    count[hit], c[hit] = n[first][at[hit]], of[first][at[hit]]
                rows = j - i
                where, row = _sequence(w)
                classes = np.full(len(where), m.clusters, np.uint8)
                classes[where >= 0] = c
                tokens = np.diff(w.first) + 1
                cuts = np.r_[0, np.cumsum(tokens)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(tokens),
                        pa.array(np.bincount(w.row, count > 0, rows).astype(np.int64) + (m.ends > 0)),
                        pa.array(np.bincount(w.row, m.base(count), rows) + m.base(np.array([m.ends]))[0]),
                        pa.array(np.bincount(w.row, np.log10(count + 1), rows) + np.log10(m.ends + 1)),
                        pa.array([classes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    ["doc_id", "train", "n_tokens", "n_known", "base_score", "emit", "classes"],
                )

    return run


def _coded(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, tokens of each row, classes of all) of texts of about limit tokens together."""
    offsets = np.r_[0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)
    for i, j in slices(offsets, limit):
        yield i, j, np.diff(offsets[i : j + 1]), np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), np.uint8)


def _class_bigrams(k: int):
    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, _, _, c in _coded(batch.column(0)):
                if len(c):
                    total += np.bincount(np.r_[np.uint8(k - 1), c[:-1]].astype(np.int32) * k + c, minlength=k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return run


def _score(model):
    def run(batches):
        m: Model = model.value
        size = np.log10(m.n + m.v + 1)
        for batch in batches:
            total = [np.zeros(0)]
            for i, j, tokens, c in _coded(batch.column("classes")):
                step = m.transition[np.r_[np.uint8(m.clusters), c[:-1]], c] - size[c]
                total.append(np.bincount(np.repeat(np.arange(j - i), tokens), step, j - i))
            score = batch.column("emit").to_numpy() + np.concatenate(total)
            held = pc.invert(batch.column("train"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), held, batch.column("n_tokens"), batch.column("n_known"), pa.array(np.full(len(score), m.total, np.int64)), batch.column("base_score"), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def train(spark: SparkSession, texts: DataFrame, p: Brown, ws: Workspace) -> tuple[Model, DataFrame]:
    """The model, and the written table of all counts (word, shape, n). texts: (text)."""
    vocabulary = ws.save(texts.mapInArrow(_vocabulary(p), "word long, shape short, n long").groupBy("word", "shape").agg(F.sum("n").alias("n")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words = vocabulary.where("shape >= 0")
    head = words.where(F.col("n") >= F.lit(max(1.0, p.head * total))).select("word", "n").toArrow()  # at most 1 / p.head rows
    word, n = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    often = np.flatnonzero(n >= max(1.0, p.core * total))
    often = np.sort(often[np.argsort(-n[often], kind="stable")[: p.most_core]])
    core, core_n = word[often], n[often]
    held = spark.sparkContext.broadcast(core)
    units = len(core) + p.shapes + 1
    pairs = texts.mapInArrow(_bigrams(held, p), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most units squared rows
    counts = np.zeros(units * units, np.int64)
    counts[pairs.column(0).to_numpy()] = pairs.column(1).to_numpy()
    counts = counts.reshape(units, units)
    size = len(core)
    rank = np.r_[np.argsort(-core_n, kind="stable"), np.arange(size, units)]
    of = np.empty(units, np.int64)
    of[rank] = exchange(counts[np.ix_(rank, rank)], size, p.classes, p.rounds)
    k = int(of.max()) + 1
    transitions = np.zeros((k, k))
    np.add.at(transitions, (of[:, None], of[None, :]), counts)
    by = np.zeros((2, k), np.int64)
    np.add.at(by[0], of[:size], core_n)
    np.add.at(by[1], of[:size], 1)
    shape = {r["shape"]: (r.n, r.v) for r in vocabulary.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # a row for each shape
    ends = shape.get(-1, (0, 0))[0]
    core_shape = {r.word: r["shape"] for r in words.where(F.col("n") >= F.lit(int(core_n.min()) if len(core) else total + 1)).select("word", "shape").collect()}  # as many as core words, and those that tie with the last
    n_core = {}
    for x, c in zip(core.view(np.int64).tolist(), core_n.tolist()):
        a, b = n_core.get(core_shape[x], (0, 0))
        n_core[core_shape[x]] = (a + c, b + 1)
    for s in range(p.shapes):
        c = of[size + s]
        for z in (0, 1):
            by[z, c] += shape.get(s, (0, 0))[z] - n_core.get(s, (0, 0))[z]
    by[0, of[-1]], by[1, of[-1]] = ends, 1
    return Model(word, n, core, of, transitions, by[0], by[1], int(total), int(distinct), int(ends), p), vocabulary


def assign(spark: SparkSession, texts: DataFrame, model: Model, vocabulary: DataFrame, p: Brown, ws: Workspace) -> tuple[Model, DataFrame]:
    """The model in which every word of the training texts has a cluster, and the written table (word,
    shape, n, class) of the words outside the core. Class bigrams are still to be counted."""
    m = copy(model)
    m.clusters = max(1, min(p.classes, len(m.core)))
    if not len(m.core):  # nothing was clustered: one class for all words
        m.counts = np.ones((1 + len(m.counts), 1 + len(m.counts)))
        m.of = m.of + 1
    held = spark.sparkContext.broadcast(m)
    contexts = texts.mapInArrow(_contexts(held), "word long, slot short, n long").repartition(shuffle_partitions(spark), "word").sortWithinPartitions("word")  # one number: no rows are compared
    found = contexts.mapInArrow(_assign(held), "word long, class short")
    words = ws.save(vocabulary.where("shape >= 0").join(found, "word"), "classes")
    m.n, m.v = np.zeros(m.clusters + 1, np.int64), np.zeros(m.clusters + 1, np.int64)
    kinds = np.zeros((p.shapes, m.clusters), np.int64)
    for r in words.groupBy("shape", "class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most shapes times classes rows
        m.n[r["class"]] += r.n
        m.v[r["class"]] += r.v
        kinds[r["shape"], r["class"]] = r.v
    m.unseen = np.where(kinds.any(axis=1), kinds.argmax(axis=1), kinds.sum(axis=0).argmax())
    head = words.where(F.col("n") >= F.lit(max(1.0, p.head * m.total))).select("word", "class").toArrow()  # at most 1 / p.head rows
    m.head_of = np.zeros(len(m.head), np.int64)
    m.head_of[np.searchsorted(m.head, head.column(0).to_numpy().view(np.uint64))] = head.column(1).to_numpy()
    at = np.searchsorted(m.head, m.core)
    m.head_of[at] = m.of[: len(m.core)]
    np.add.at(m.n, m.of[: len(m.core)], m.head_n[at])
    np.add.at(m.v, m.of[: len(m.core)], 1)
    m.n[-1], m.v[-1] = m.ends, 1
    return m, words


def score(spark: SparkSession, docs: DataFrame, params: Brown = Brown(), ws: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text)."""
    ws = ws or Workspace(spark, "brown")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.where(training(F.col("doc_id"))).select("text")
    model, vocabulary = train(spark, texts, params, ws)
    m, words = assign(spark, texts, model, vocabulary, params, ws)
    held = spark.sparkContext.broadcast(m)
    tail = words.where(F.col("n") < F.lit(max(1.0, params.head * m.total))).select("word", F.col("class").cast("long").alias("class"), "n")
    rare = docs.select("key", "text").mapInArrow(_rare(held), "key long, word long").join(tail, "word").groupBy("key").agg(F.collect_list(F.struct("word", "class", "n")).alias("rare"))
    empty = F.from_json(F.lit("[]"), "array<struct<word:long,class:long,n:long>>")
    full = docs.join(rare, "key", "left").select("doc_id", training(F.col("doc_id")).alias("train"), "text", F.coalesce("rare", empty).alias("rare"))
    encoded = ws.save(full.mapInArrow(_encode(held), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, emit double, classes binary"), "encoded")
    k = m.clusters + 1
    counts = np.zeros(k * k)
    for r in encoded.where("train").select("classes").mapInArrow(_class_bigrams(k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most classes squared rows
        counts[r.pair] = r.n
    m = copy(m)
    m.counts = counts.reshape(k, k)
    m.transition = _smooth(m.counts)
    final = spark.sparkContext.broadcast(m)
    return encoded.mapInArrow(_score(final), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
