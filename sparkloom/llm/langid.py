"""Operator 10, language identification by nearest centroids.

Texts are lower-cased; signs other than letters become single gaps, and n-grams are the byte trigrams of
what is left, so every script is covered. A vector holds the TF-IDF weights (square root of the count,
times smoothed inverse document frequency) of the model's trigrams, normalised; these are the ``dims``
most frequent of every language in the sample, all together. Each language gets several centroids by
spherical k-means with farthest-first seeds; a text is given the language of the centroid with the
greatest cosine, and is rejected where it has no letter or its cosine is below a floor that hangs on how
many n-grams it has.

Training is on a bounded sample: of every language the ``per_language`` rows with the least hash of
doc_id and text (rows that repeat both count once). No language is left out; more than ``most_labels``
different labels are refused with an error, as these can't be languages. The sample's texts stay on the
executors: the driver receives counts of trigrams and centroids, at most ``dims`` and ``clusters`` of
each language. Every row is predicted from its whole text alone.

Rows: a text that is null or has no letter gets `und` and score 0. Ties between languages go to the
smaller name. With no training rows every row gets `und`. A null doc_id counts as an empty one for the
split. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neardup import _groups
from .words import buffers, slices
from .workspace import Workspace, table

UNKNOWN = "und"


@dataclass(frozen=True)
class LangId:
    dims: int = 2048
    per_language: int = 400
    most_labels: int = 20_000
    clusters: int = 4
    rounds: int = 8
    floor: float = 0.1
    seed: int = 11


#: Bytes that are no letter by themselves: all of ASCII but a-z. Bytes of longer signs stay.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, row) of every place of each text, a gap before and after it; runs of gaps count once."""
    n = np.diff(offsets)
    at = offsets - offsets[0] + 2 * np.arange(len(offsets))
    out = np.full(int(at[-1]), 32, np.uint8)
    keep = np.ones(int(at[-1]), bool)
    keep[at[:-1]] = keep[at[1:] - 1] = False
    out[keep] = _PLAIN[data[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
    gap = out == 32
    stay = ~gap
    stay[1:] |= ~gap[:-1] | (row[1:] != row[:-1])
    stay[0] = True
    out, row = out[stay].astype(np.int32), row[stay]
    if len(out) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    gram = (out[:-2] << 16) | (out[1:-1] << 8) | out[2:]
    same = row[:-2] == row[2:]
    return gram[same], row[:-2][same]


def _lower(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _steps(i: int, j: int, dims: int) -> Iterator[tuple[int, int]]:
    """Row ranges that keep a dense matrix of that many columns small."""
    step = max(1, min(512, (1 << 21) // max(1, dims)))
    return ((a, min(a + step, j)) for a in range(i, j, step))


class Model:
    """languages[label[c]] is the language of centroid c. index: place of a trigram, or the place past the last."""

    def __init__(self, grams: np.ndarray, idf: np.ndarray, centroids: np.ndarray, label: np.ndarray, languages: list[str], floor: float):
        self.grams, self.idf, self.centroids, self.label, self.languages, self.floor = grams, idf, centroids, label, languages, floor
        self._index = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(normalised rows, number of n-grams of each, those outside the model included)."""
        if self._index is None:
            self._index = np.full(1 << 24, len(self.grams), np.int16 if len(self.grams) < 2**15 else np.int32)
            self._index[self.grams] = np.arange(len(self.grams))
        gram, row = _grams(data, offsets)
        rows, d = len(offsets) - 1, len(self.grams)
        place = row.astype(np.int64) * (d + 1) + self._index[gram]
        every = np.bincount(place, minlength=rows * (d + 1)).reshape(rows, d + 1)
        counts = every[:, :d]
        x = np.sqrt(counts, dtype=np.float32) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1), every.sum(axis=1)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, cosine, whether it is rejected) of each text."""
        data, offsets = buffers(_lower(column))
        best, score, reject = [], [], []
        for i, j in slices(offsets, 1 << 20):
            for a, b in _steps(i, j, len(self.grams)):
                x, used = self.vectors(data, offsets[a : b + 1])
                cosine = x @ self.centroids.T
                c = np.argmax(cosine, axis=1)
                s = np.clip(cosine[np.arange(len(c)), c], 0, 1)
                best.append(self.label[c])
                score.append(s.astype(np.float64))
                reject.append(s < self.floor * np.minimum(1, np.sqrt(used / 200)))
        join = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
        return join(best, np.int64), join(score, np.float64), join(reject, bool)


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Up to k unit centroids: the mean, then rows farthest from all so far, then k-means by cosine."""
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-12)
    c = unit(x.mean(axis=0, keepdims=True))
    typical = np.argsort(-(x @ c[0]), kind="stable")[: max(1, len(x) * 9 // 10)]  # outliers seed nothing
    while len(c) < min(k, len(typical)):
        c = np.r_[c, x[typical[np.argmin((x[typical] @ c.T).max(axis=1))]][None]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c.astype(np.float32)


def _gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, texts that have it) over all the texts."""
    seen = []
    for i, j in slices(offsets):
        gram, row = _grams(data, offsets[i : j + 1])
        seen.append(np.unique((row.astype(np.int64) << 24) | gram) & 0xFFFFFF)
    return np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)


def _blank(gram: np.ndarray, df: np.ndarray, texts: int, languages: list[str], p: LangId) -> Model:
    """A model with its trigrams and weights, without centroids."""
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)
    return Model(gram, idf, np.zeros((0, len(gram)), np.float32), np.zeros(0, np.int64), languages, p.floor)


def fit(texts: list[str], langs: list[str], p: LangId) -> Model:
    """The model of some texts in memory; train() does the same with tables."""
    languages = sorted(set(langs))
    of = np.array(langs)
    data, offsets = buffers(_lower(pa.array(texts, pa.string())))
    chosen = []
    for name in languages:
        gram, n = _gram_counts(*buffers(_lower(pa.array([t for t, x in zip(texts, langs) if x == name], pa.string()))))
        chosen.append(gram[np.lexsort((gram, -n))[: p.dims]])
    every, df = _gram_counts(data, offsets)
    keep = np.isin(every, np.concatenate(chosen)) if chosen else np.zeros(len(every), bool)
    model = _blank(every[keep], df[keep], len(texts), languages, p)
    rows = [model.vectors(data, offsets[a : b + 1])[0] for a, b in _steps(0, len(texts), len(model.grams))]
    x = np.concatenate(rows) if rows else np.zeros((0, len(model.grams)), np.float32)
    parts = [_cluster(x[of == name], p.clusters, p.rounds) for name in languages]
    model.centroids = np.concatenate(parts) if parts else model.centroids
    model.label = np.repeat(np.arange(len(languages)), [len(c) for c in parts]).astype(np.int64)
    return model


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _least(k: int):
    """(lang, h) -> of every language the k least distinct h that this task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = pc.dictionary_encode(batch.column(0))
            at, h = names.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, lang in enumerate(names.dictionary.to_pylist()):
                held[lang] = np.unique(np.r_[held.get(lang, np.zeros(0, np.int64)), h[at == i]])[:k]
        for lang, kept in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array(kept)], ["lang", "h"])

    return run


def sample(ws: Workspace, rows: DataFrame, p: LangId) -> DataFrame:
    """The written table (lang, h, text) to learn from: at most per_language rows of each language in rows
    (doc_id, text, lang)."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64(F.lit(p.seed), "doc_id", "text").alias("h"))
    least = ws.save(known.select("lang", "h").mapInArrow(_least(p.per_language), "lang string, h long").distinct(), "least")
    # what is ranked in one task: a share 2^-i of a language's hashes that is some two to four times
    # per_language, however many tasks have read the language; the share is read from its quantiles
    shares = [2.0**-i for i in range(31)]
    found = least.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("h", shares, 100_000).alias("q"))
    step = F.greatest(F.lit(0), F.least(F.lit(30), F.floor(F.log2(F.col("n") / (2 * p.per_language + 64))))).cast("int")
    near = least.join(found.select("lang", F.get("q", step).alias("cut")), "lang").where(F.col("h").cast("double") <= F.col("cut").cast("double"))  # quantiles are doubles
    order = Window.partitionBy("lang").orderBy("h")
    pick = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= p.per_language).select("lang", "h")
    pick = ws.save(pick.coalesce(8), "picks")
    return ws.save(known.join(pick, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")), "sample")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n)."""
    for batch in batches:
        names = pc.dictionary_encode(batch.column(0))
        for i, lang in enumerate(names.dictionary.to_pylist()):
            gram, n = _gram_counts(*buffers(_lower(batch.column(1).filter(pc.equal(names.indices, i)))))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _sparse(model):
    """(lang, h, text) -> (lang, h, at, x): the places of the vector's components that aren't 0, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            data, offsets = buffers(_lower(batch.column(2)))
            for i, j in slices(offsets):
                for a, b in _steps(i, j, len(m.grams)):
                    x, _ = m.vectors(data, offsets[a : b + 1])
                    at = [np.flatnonzero(v).astype(np.int32) for v in x]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([k.tobytes() for k in at], pa.binary()), pa.array([v[k].tobytes() for v, k in zip(x, at)], pa.binary())], ["lang", "h", "at", "x"])

    return run


def _clusters(p: LangId):
    """(lang, h, at, x) sorted by lang and h -> (lang, c, at, x): the centroids of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "lang"):
            names = np.array(part.column("lang").to_pylist(), dtype=object)
            heads = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            for h, t in zip(heads, np.r_[heads[1:], len(names)]):  # at most per_language rows
                at = [np.frombuffer(v, np.int32) for v in part.column("at").slice(h, t - h).to_pylist()]
                x = [np.frombuffer(v, np.float32) for v in part.column("x").slice(h, t - h).to_pylist()]
                own = np.unique(np.concatenate(at))
                rows = np.zeros((t - h, max(1, len(own))), np.float32)
                for r, (k, v) in enumerate(zip(at, x)):
                    rows[r, np.searchsorted(own, k)] = v
                found = _cluster(rows, p.clusters, p.rounds)[:, : len(own)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([names[h]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array([own.tobytes()] * n, pa.binary()), pa.array([np.ascontiguousarray(v).tobytes() for v in found], pa.binary())], ["lang", "c", "at", "x"])

    return run


def train(docs: DataFrame, params: LangId = LangId(), ws: Workspace | None = None) -> Model:
    """The model of the rows of docs (doc_id, text, lang) that aren't held out."""
    p, spark = params, docs.sparkSession
    ws = ws or Workspace(spark, "langid")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = sample(ws, rows.where(~held_out(F.col("doc_id"))), p)
    sizes = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(p.most_labels + 1).collect()}
    if len(sizes) > p.most_labels:
        raise ValueError(f"more than {p.most_labels} different labels in lang")
    counts = ws.save(texts.select("lang", "text").mapInArrow(_count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= p.dims).select("gram").distinct()
    found = counts.join(best, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # at most dims of each language
    model = _blank(found.column(0).to_numpy().astype(np.int64), found.column(1).to_numpy(), sum(sizes.values()), sorted(sizes), p)
    vectors = texts.mapInArrow(_sparse(spark.sparkContext.broadcast(model)), "lang string, h long, at binary, x binary")
    centroids = vectors.repartition("lang").sortWithinPartitions("lang", "h").mapInArrow(_clusters(p), "lang string, c int, at binary, x binary")
    parts = sorted(centroids.collect(), key=lambda r: (r.lang, r.c))  # at most clusters of each language
    model.centroids = np.zeros((len(parts), len(model.grams)), np.float32)
    for line, r in zip(model.centroids, parts):
        line[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    place = {lang: i for i, lang in enumerate(model.languages)}
    model.label = np.array([place[r.lang] for r in parts], np.int64)
    return model


def _predict(model: Model):
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model.languages:
                best, score, reject = model.predict(text)
            else:
                best, score, reject = np.full(len(text), len(names) - 1), np.zeros(len(text)), np.ones(len(text), bool)
            best, score = np.where(letter, best, len(names) - 1), np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "text"] + [pa.array(names[best], pa.string()), pa.array(score), pa.array(reject | ~letter)],
                [c for c in batch.schema.names if c != "text"] + ["lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _predict(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            seen = next(inner(iter([pa.RecordBatch.from_arrays([text], ["text"])])))
            yield batch.filter(pc.invert(seen.column("rejected")))

    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
