"""Operator 3, document fingerprints: I-Match with randomised lexicons.

The lexicon is every term whose document frequency lies in a band: a share of at least ``rare`` and at
most ``common`` of all documents, that is, an inverse document frequency in [-ln common, -ln rare]. A
document has some hundreds of distinct terms, so at most (their mean number) / rare terms are that
frequent, whatever the corpus; that bounds what is broadcast. Each of ``lexicons`` random sub-lexicons
keeps a term with one of the rates 1 / 2^s of ``scales``. A document's distinct terms in the lexicon are
sorted, and those in each sub-lexicon are hashed together, each by its place among them. The fingerprint
strings these hashes end to end, four hexadecimal digits each (zeros where no term fell into it). Dense
sub-lexicons tell small edits of long texts, sparse ones large edits or short texts.

The likeness of two fingerprints is, for each scale, the share of equal hashes among the sub-lexicons in
which either has terms; it is the greatest share of the scales with at least ``told`` such sub-lexicons,
and that of all scales together if none has as many. A text with no term in the lexicon is fingerprinted
by all its words instead ("=" and a digest). Every document is also compared with an edited copy of itself
and with its successor, which takes the documents in descending doc_id: they are dealt out by ranges of
doc_id, and the first row of every range goes to the range before it as well.

Rows: a null text counts as empty. Null doc_ids come last; rows of one doc_id are in the order of their
texts. A single document is its own successor. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Tally, buffers, mix, power, slices, words_of
from .workspace import bucket_of, range_bounds, shuffle_partitions, table

_U = np.uint64
_DIGITS = 4


@dataclass(frozen=True)
class IMatch:
    rare: float = 0.002
    common: float = 0.1
    lexicons: int = 128
    scales: tuple[int, ...] = (1, 4, 5, 6, 7, 8, 9, 10)
    told: int = 4
    seed: int = 5


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs; rows ascend, hashes ascend in each."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    keep = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])] if len(rows) else np.zeros(0, bool)
    return rows[keep], hashes[keep]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (term, documents that have it), as far as this task has read."""
    tally = Tally()

    def out():
        term, n = tally.take()
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j in slices(offsets):
            w = words_of(data, offsets[i : j + 1])
            rows, terms = _distinct(w.row, w.hash)
            tally.add(*np.unique(terms, return_counts=True))
            if tally.full():
                yield out()
    yield out()


class Lexicon:
    """Sorted term hashes, and for each masks of the sub-lexicons that hold it, 64 to a mask."""

    def __init__(self, terms: np.ndarray, p: IMatch):
        self.terms, self.p = np.sort(terms.astype(np.uint64)), p
        self.mask = np.zeros((-(-p.lexicons // 64), len(terms)), np.uint64)
        for k in range(p.lexicons):
            draw = mix(self.terms ^ _U((p.seed << 32) + 7919 * (k + 1)))
            rate = p.scales[k % len(p.scales)]
            self.mask[k // 64] |= (draw >> _U(64 - rate) == 0).astype(np.uint64) << _U(k % 64)

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(16-bit hash of each text in each sub-lexicon, 0: no term; "" or the digest that stands for a text without terms)."""
        data, offsets = buffers(column)
        parts, other = [], []
        for i, j in slices(offsets):
            w = words_of(data, offsets[i : j + 1])
            at = np.minimum(np.searchsorted(self.terms, w.hash), max(0, len(self.terms) - 1))
            known = self.terms[at] == w.hash if len(self.terms) else np.zeros(len(w.hash), bool)
            rows, terms = _distinct(w.row[known], w.hash[known])
            held = self.mask[:, np.searchsorted(self.terms, terms)]
            out = np.zeros((j - i, self.p.lexicons), np.uint16)
            for k in range(self.p.lexicons if len(rows) else 0):
                at = np.flatnonzero((held[k // 64] >> _U(k % 64)) & _U(1))
                if not len(at):
                    continue
                row, term = rows[at], terms[at]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                place = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
                total = np.add.reduceat(mix(term + _U(k)) * power(len(at))[place], heads)
                out[row[heads], k] = mix(total) % _U(0xFFFF) + _U(1)
            parts.append(out)
            for r, none in enumerate(~out.any(axis=1)):
                other.append("=" + hashlib.sha256(w.hash[w.first[r] : w.first[r + 1]].tobytes()).hexdigest()[:32] if none else "")
        return (np.concatenate(parts) if parts else np.zeros((0, self.p.lexicons), np.uint16)), other


def _strings(hashes: np.ndarray, other: list[str]) -> list[str]:
    raw = hashes.astype(">u2").tobytes().hex()
    width = hashes.shape[1] * _DIGITS
    return [o or raw[i * width : (i + 1) * width] for i, o in enumerate(other)]


def likeness(a: str, b: str, p: IMatch = IMatch()) -> float:
    """Of two fingerprints, 0 to 1."""
    if a.startswith("=") or b.startswith("="):
        return float(a == b)
    zero = "0" * _DIGITS
    told, same = [0] * len(p.scales), [0] * len(p.scales)
    for k in range(p.lexicons):
        x, y = (f[k * _DIGITS : (k + 1) * _DIGITS] for f in (a, b))
        told[k % len(p.scales)] += x != zero or y != zero
        same[k % len(p.scales)] += x == y != zero
    enough = [s / t for s, t in zip(same, told) if t >= p.told]
    return max(enough) if enough else sum(same) / sum(told)


def _likenesses(a: np.ndarray, a_other: list[str], b: np.ndarray, b_other: list[str], p: IMatch) -> np.ndarray:
    scales = len(p.scales)
    by = lambda x: np.stack([x[:, k::scales].sum(axis=1) for k in range(scales)], axis=1)
    told, same = by((a != 0) | (b != 0)), by((a == b) & (a != 0))
    share = np.where(told >= p.told, same / np.maximum(told, 1), -1.0).max(axis=1, initial=-1.0)
    out = np.where(share >= 0, share, same.sum(axis=1) / np.maximum(told.sum(axis=1), 1))
    for i, (x, y) in enumerate(zip(a_other, b_other)):
        if x or y:
            out[i] = float(x == y)
    return out


def edited(own: str, successor: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + successor[:half]


def _compare(lexicon, limit: int = 1 << 20):
    """Rows (tail, doc_id, text) in order -> the result's columns. The rows with tail 1 come last; the
    first of them succeeds the last of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        ids: list = []
        texts: list[str] = []
        weight = 0

        def out(n: int) -> pa.RecordBatch:
            """The first n of the rows held; one more is held."""
            own, own_other = lex.hashes(pa.array(texts[: n + 1], pa.large_string()))
            new = [edited(t, s) for t, s in zip(texts[:n], texts[1 : n + 1])]
            edit, edit_other = lex.hashes(pa.array(new, pa.large_string()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array(_strings(own[:n], own_other[:n])),
                    pa.array(_strings(edit, edit_other)),
                    pa.array(_likenesses(own[:n], own_other[:n], edit, edit_other, lex.p)),
                    pa.array(_likenesses(own[:n], own_other[:n], own[1:], own_other[1:], lex.p)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        ended = False
        for batch in batches:
            for tail, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if ended:
                    continue
                ids.append(doc)
                texts.append(text.as_py() or "")
                weight += len(texts[-1])
                ended = tail == 1
                if ended or weight > limit or len(ids) > 2000:
                    if len(ids) > 1:
                        yield out(len(ids) - 1)
                    ids, texts = ids[-1:], texts[-1:]
                    weight = len(texts[0])

    return run


def lexicon_of(docs: DataFrame, p: IMatch) -> Lexicon:
    """From the counts of all documents."""
    n = docs.count()
    terms = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = terms.where((F.col("n") >= F.lit(p.rare * n)) & (F.col("n") <= F.lit(max(1.0, p.common * n))))
    found = band.select("term").toArrow().column(0).to_numpy()  # bounded by the band, see above
    return Lexicon(found.view(np.uint64), p)


def fingerprints(spark: SparkSession, docs: DataFrame, params: IMatch = IMatch()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs, params))
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    bounds = range_bounds(docs, "doc_id", shuffle_partitions(spark))
    of = bucket_of(key, bounds).cast("int")
    first = sorted((r.part, r.top) for r in docs.select(of.alias("part"), key.alias("k")).groupBy("part").agg(F.max("k").alias("top")).collect())  # a row for each range
    above = {top: first[(i + 1) % len(first)][0] for i, (_, top) in enumerate(first)}
    place = lambda part, tail: F.struct(part.alias("part"), F.lit(tail).alias("tail"))
    literal = lambda values: F.array(*map(F.lit, values))
    target = F.element_at(F.map_from_arrays(literal(above), literal(above.values())), key)  # one map for all ranges
    here = F.array(place(of, 0))
    if above:
        here = F.when(key.isin(list(above)), F.array(place(of, 0), place(target, 1))).otherwise(here)
    rows = docs.select(F.explode(here).alias("p"), key.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("p.part", "p.tail", "k", "doc_id", "text").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("tail", F.desc("k"), "text")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("tail", "doc_id", "text").mapInArrow(_compare(lexicon), out)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))
