"""A knowledge base over configured sources, and an agent that answers from it."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import resolve
from .errors import ConfigError
from .functions.guards import Guardrails
from .operators import answering, chunking, health, retrieval, store
from .operators.filters import AccessRules, Caller
from .operators.search import KeywordIndex
from .registry import registry
from .resilience import Lazy
from .sources import clean, loaders
from .tables import ensure

_CHUNKS = chunking.CHUNKS + ", rel string, file_type string"
SETTINGS = ("chunker", "embedder", "sources")


def component(stage: str, spec: Mapping[str, Any] | None, **have: Any) -> Any:
    """What a setting like {"provider": name, ...} stands for."""
    return None if not spec else registry.create(stage, spec["provider"], {k: v for k, v in spec.items() if k != "provider"}, **have)


class KnowledgeBase:
    def __init__(self, spark: SparkSession, settings: Mapping[str, Any]):
        self.spark, self.settings = spark, resolve(settings)
        path = self.settings["index"]
        self.index = store.VersionedTable(spark, f"{path}/chunks", _CHUNKS, "doc_id")
        self.manifest = store.VersionedTable(spark, f"{path}/manifest", "rel string, hash string, doc_id string", "rel")
        self.chunker = component("chunker", self.settings["chunker"])
        self.embed = component("embedder", self.settings["embedder"])

    def documents(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(files, documents, what is left out and why) of the sources."""
        sources = [loaders.Source(s) if isinstance(s, str) else loaders.Source(s["location"], tuple(s.get("exclude", ())), s.get("loader")) for s in self.settings["sources"]]
        if not sources:
            raise ConfigError("no sources are set")
        files, unknown = loaders.discover(self.spark, sources, warnings=True)
        docs = loaders.load(files)
        good = clean.strip_repeated_lines(docs.where("error is null and text is not null").select("id", "text")).withColumnRenamed("text", "plain")
        docs = docs.join(good, "id", "left").withColumn("text", clean.promote_headings(F.coalesce("plain", "text"))).drop("plain")
        bad = docs.where("error is not null").select(F.col("rel").alias("path"), F.col("error").alias("warning"))
        return files, docs, unknown.unionByName(bad)

    def _chunk(self, docs: DataFrame) -> DataFrame:
        return self.chunker(docs.where("error is null"), carry=("rel", "file_type"))

    def ingest(self, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
        """(states of all files, warnings). Only new and changed files are read into chunks, unless settings changed."""
        if rebuild and self.index.version():
            self.index.clear()
        files, docs, warnings = self.documents()
        return store.ingest(files, docs, self.index, self.manifest, self._chunk, {k: self.settings[k] for k in SETTINGS}), warnings

    def analyze(self) -> tuple[DataFrame, DataFrame]:
        """(health of each document, of its chunks) without writing an index."""
        _, docs, _ = self.documents()
        return health.health(docs.select("id", "text")), health.chunk_health(self._chunk(docs))

    def chunks(self) -> DataFrame:
        """All chunks; id is a number made of chunk_id."""
        return self.index.read().withColumnRenamed("id", "chunk_id").withColumn("id", F.xxhash64("chunk_id"))

    def count(self) -> int:
        return self.index.read().count()

    def _version(self) -> str:
        return hashlib.sha256(f"{self.index.path}|{self.index.version()}|{self.settings['embedder']}".encode()).hexdigest()[:20]

    def keyword_index(self) -> KeywordIndex:
        return KeywordIndex.build(self.chunks(), self._version(), "kb-terms")

    def vectors(self) -> DataFrame:
        return ensure(self.spark, "kb-vectors", self._version(), lambda: self.embed(self.chunks().select("id", "text")))

    def retrieve(self, questions: DataFrame, caller: Caller | None = None, flt: Mapping | None = None, model: answering.Model | None = None, k: int | None = None) -> DataFrame:
        """(query_id, id, rank, score) for questions (query_id, text, and history if there is one)."""
        s, r, access = self.settings, self.settings["retriever"], self.settings["access"]
        mode, k = r["provider"], k or s["k"]
        rules = AccessRules(tenant=access["tenant"], roles=access["roles"], attributes=access["attributes"]) if access["enabled"] else None
        if mode == "agentic":
            return answering.agentic_search(questions, self.chunks(), model, k, r.get("max_steps", 3), self.keyword_index())
        o = retrieval.Retrieval(mode=mode, fusion=r.get("fusion", "rrf"), dense_weight=r.get("dense_weight", 0.5), transform=(s["query_transform"] or {}).get("provider"), k=k, top_k=k)
        index = self.keyword_index() if mode != "dense" else None
        vectors = self.vectors() if mode != "sparse" else None
        found = retrieval.retrieve(questions, self.chunks(), o, access=rules, caller=caller, flt=flt, model=model, index=index, vectors=vectors)
        rerank = component("reranker", s["reranker"], model=model)
        return rerank(found, self.chunks(), questions.select("query_id", "text")) if rerank else found


class Agent:
    """Answers questions, one or many, from a knowledge base by its settings."""

    def __init__(self, kb: KnowledgeBase, model: answering.Model | None = None, tracers: tuple = ()):
        self.kb, self.tracers = kb, tracers
        llm = kb.settings["llm"]
        self.model = model or Lazy(_Maker(dict(llm)))

    def options(self) -> answering.AnswerOptions:
        s, g = self.kb.settings, self.kb.settings["generation"]
        rails = [component("guardrail", x) for x in s["guardrails"]]
        held = Guardrails(pii=next((r.pii for r in rails if r.pii), None), injection=any(r.injection for r in rails), rules=[rule for r in rails for rule in r.rules], allow=[a for r in rails for a in r.allow])
        return answering.AnswerOptions(k=s["k"], min_chunks=g["min_chunks"], min_score=g["min_score"], require_verified=g["require_verified"], verify=g["verify"], on_unsupported=g["on_unsupported"], guardrails=held)

    def ask_all(self, questions: DataFrame, caller: Caller | None = None) -> DataFrame:
        found = self.kb.retrieve(questions, caller, model=self.model)
        out = answering.answer(questions, self.kb.chunks(), self.model, self.options(), results=found)
        for emit in self.tracers:
            try:
                emit(out)
            except Exception:  # a tracer that fails mustn't cost the answer
                continue
        return out

    def ask(self, question: str, caller: Caller | None = None) -> dict:
        rows = self.kb.spark.createDataFrame([(1, question)], "query_id long, text string")
        return self.ask_all(rows, caller).first().asDict(recursive=True)


class _Maker:
    def __init__(self, spec: dict):
        self.spec = spec

    def __call__(self):
        return component("llm", self.spec)
