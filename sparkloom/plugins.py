"""What is built in, as factories for the registry. Each returns a function over DataFrames, or an object."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.guards import Guardrails, Rule
from .functions.text import word_set
from .operators import answering, chunking, evaluation, retrieval, search, synth
from .operators.store import VersionedTable
from .sources import loaders


def _loader(kind: str) -> Callable[[], Callable]:
    def make() -> Callable:
        return loaders.LOADERS[kind]

    return make


loader_text, loader_csv, loader_html, loader_docx, loader_pptx, loader_xlsx, loader_pdf, loader_image = map(_loader, ("text", "csv", "html", "docx", "pptx", "xlsx", "pdf", "image"))


def chunker_fixed(size: int = 1200, overlap: int = 150):
    return partial(chunking.chunk, method="fixed", size=size, overlap=overlap)


def chunker_structure(size: int = 1200, overlap: int = 150):
    return partial(chunking.chunk, method="structure", size=size, overlap=overlap)


def chunker_parent_child(parent_size: int = 2400, size: int = 400, overlap: int = 50):
    return partial(chunking.chunk, method="parent_child", parent_size=parent_size, size=size, overlap=overlap)


def chunker_semantic(window: int = 1, quantile: float = 0.85, least: int = 250, most: int = 1500):
    return partial(chunking.chunk, method="semantic", window=window, quantile=quantile, least=least, most=most)


def embedder_hashing(dims: int = 384):
    return partial(search.hashed_vectors, dims=dims)


def store_table(path: str, schema: str = chunking.CHUNKS, bucket_by: str = "doc_id", buckets: int = 64, spark: SparkSession | None = None):
    return VersionedTable(spark, path, schema, bucket_by, buckets)


def retriever_dense(k: int = 5):
    return partial(retrieval.retrieve, options=retrieval.Retrieval(mode="dense", k=k, top_k=k))


def retriever_sparse(k: int = 5):
    return partial(retrieval.retrieve, options=retrieval.Retrieval(mode="sparse", k=k, top_k=k))


def retriever_hybrid(k: int = 5, fusion: str = "rrf", dense_weight: float = 0.5):
    return partial(retrieval.retrieve, options=retrieval.Retrieval(mode="hybrid", k=k, top_k=k, fusion=fusion, dense_weight=dense_weight))


def retriever_agentic(k: int = 5, max_steps: int = 3, model: answering.Model | None = None):
    return partial(answering.agentic_search, judge=model, k=k, max_steps=max_steps)


def reranker_overlap(top_n: int = 5):
    """Reranks by the share of words that question and passage have in common."""
    score = F.round(synth.jaccard(word_set(F.col("query")), word_set(F.col("text"))), 6)
    return partial(search.rerank, scorer=score, k=top_n)


def reranker_model(top_n: int = 5, model: answering.Model | None = None):
    return partial(retrieval.rerank_by_model, model=model, k=top_n)


def query_transform_condense(model: answering.Model | None = None):
    return partial(answering.condense, model=model)


def query_transform_rewrite(model: answering.Model | None = None):
    return partial(answering.rewrite, model=model)


def query_transform_multi_query(n: int = 3, model: answering.Model | None = None):
    return partial(answering.expand_queries, model=model, n=n)


def query_transform_hyde(words: int = 80, model: answering.Model | None = None):
    return partial(answering.hyde, model=model, words=words)


def llm_extractive():
    return answering.Extractive()


def guardrail_pii(action: str = "redact", kinds: Sequence[str] = ("card", "ssn", "email", "phone"), allow: Sequence[str] = ()):
    return Guardrails(pii=action, kinds=tuple(kinds), injection=False, allow=tuple(allow))


def guardrail_injection():
    return Guardrails(pii=None, injection=True)


def guardrail_scope(rules: list):
    return Guardrails(pii=None, injection=False, rules=[Rule(**r) for r in rules])


class MemoryCache:
    """Values by key in this process, for ttl seconds."""

    def __init__(self, ttl: float | None = None):
        self.ttl, self._held = ttl, {}

    def get(self, key: str):
        at, value = self._held.get(key, (None, None))
        return value if at is not None and (self.ttl is None or time.monotonic() - at <= self.ttl) else None

    def put(self, key: str, value) -> None:
        self._held[key] = (time.monotonic(), value)


def cache_memory(ttl: float | None = None):
    return MemoryCache(ttl)


def cache_table(path: str, spark: SparkSession | None = None):
    return VersionedTable(spark, path, "key string, value string, at timestamp", "key", 16)


def tracer_memory(include_text: bool = False):
    held: list[DataFrame] = []

    def emit(answers: DataFrame) -> None:
        held.append(answering.trace(answers, include_text))

    emit.held = held
    return emit


def tracer_logging(include_text: bool = False):
    """Counts of events by stage and name, to the log: one line each."""

    def emit(answers: DataFrame) -> None:
        for r in answering.trace(answers, include_text).groupBy("stage", "name").count().collect():
            logging.getLogger("sparkloom").info("%s %s %d", r.stage, r["name"], r["count"])

    return emit


def tracer_table(path: str, include_text: bool = False):
    def emit(answers: DataFrame) -> None:
        answering.trace(answers, include_text).withColumn("at", F.current_timestamp()).write.mode("append").json(path)

    return emit


def metric_retrieval():
    return evaluation.metrics_by_place


def metric_citation():
    return evaluation.citation_metrics


def metric_abstention():
    return evaluation.abstention_metrics


def metric_judge(model: answering.Model | None = None):
    return partial(evaluation.judge, model=model)
