"""The whole way from questions to passages as one plan: access, follow-ups, variants, search, fusion,
reranking, parents, limit. Every step is a join or a window over all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.text import json_object, sigmoid
from ..tables import scratch
from .answering import Model, complete, condense, expand_queries, hyde, rewrite
from .filters import AccessRules, Caller, Filter, combine, compile_filter
from .search import KeywordIndex, bm25, expand_parents, hashed_vectors, nearest, only, rrf, top, weighted


@dataclass(frozen=True)
class Retrieval:
    """mode: dense, sparse or hybrid; fusion of its sides: rrf or weighted; transform: none, rewrite,
    multi_query or hyde; k: what is returned; top_k: what a search is asked for at least."""

    mode: str = "hybrid"
    fusion: str = "rrf"
    dense_weight: float = 0.5
    transform: str | None = None
    k: int = 5
    top_k: int = 5
    digits: int = 6

    def __post_init__(self):
        if self.mode not in ("dense", "sparse", "hybrid") or self.fusion not in ("rrf", "weighted") or self.transform not in (None, "rewrite", "multi_query", "hyde"):
            raise ConfigError("unknown mode, fusion or transform")

    def depth(self, later: bool) -> int:
        """Results that a search gives: the pool is twice what is returned where a later step narrows it."""
        return max(self.top_k, 2 * self.k if later else self.k)


def hybrid_depth(k: int) -> int:
    """What either side of a hybrid search is asked for."""
    return max(2 * k, 20)


def search_once(queries: DataFrame, chunks: DataFrame, o: Retrieval, k: int, allowed: DataFrame, index: KeywordIndex | None = None, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = hashed_vectors) -> DataFrame:
    """(query_id, id, rank, score) of queries (query_id, text) in chunks (id, text), of the allowed (id) alone.
    Keyword statistics are those of all chunks; vectors that aren't allowed are never scored."""
    depth = hybrid_depth(k) if o.mode == "hybrid" else k
    lists = []
    if o.mode != "sparse":
        asks = embed(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
        held = vectors if vectors is not None else embed(chunks)
        n, dims = held.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        held = only(held, allowed, n * (8 * (dims or 0) + 64))
        lists.append(nearest(asks, held, depth, digits=o.digits, same=True))
    if o.mode != "dense":
        lists.append(bm25(queries, chunks, depth, keep=allowed, index=index))
    if len(lists) == 1:
        return lists[0]
    if o.fusion == "weighted":
        return weighted(*lists, k, o.dense_weight)
    return rrf(lists, k, weights=[2 * o.dense_weight, 2 * (1 - o.dense_weight)])


def retrieve(questions: DataFrame, chunks: DataFrame, options: Retrieval = Retrieval(), *, access: AccessRules | None = None, caller: Caller | None = None, flt: Filter | None = None, model: Model | None = None, scorer: Column | None = None, parents: DataFrame | None = None, index: KeywordIndex | None = None, vectors: DataFrame | None = None, traced: bool = False):
    """(query_id, id, rank, score) for questions (query_id, text, and history where follow-ups may come)
    over chunks (id, text and metadata). query_id is an integer below 2**59.

    scorer reranks by a column over query and text; parents (id, parent_id) puts parents in the place of
    chunks. Without access rules every chunk may be found. traced=True gives (results, counts), the latter
    (query_id, step, n)."""
    o = options
    rules = access.filter_for(caller or Caller()) if access else None
    both = combine(rules, flt)
    allowed = chunks.where(compile_filter(both, chunks)).select("id")
    asked = questions.select("query_id", "text")
    if "history" in questions.columns and model is not None:
        asked = condense(questions.select("query_id", F.col("text").alias("question"), "history"), model).select("query_id", F.col("query").alias("text"))
    if o.transform:
        if model is None:
            raise ConfigError(f"{o.transform} needs a model")
        variants = scratch({"rewrite": rewrite, "multi_query": expand_queries, "hyde": hyde}[o.transform](asked, model), "variants")
    else:
        variants = asked.select("query_id", F.lit(0).alias("variant"), "text")
    k = o.depth(scorer is not None or parents is not None)
    keyed = variants.select((F.col("query_id") * 16 + F.col("variant")).cast("long").alias("query_id"), "text")
    found = search_once(keyed, chunks, o, k, allowed, index, vectors)
    back = found.select(F.floor(F.col("query_id") / 16).cast("long").alias("query_id"), F.pmod("query_id", F.lit(16)).alias("variant"), "id", "rank", "score")
    if o.transform:
        fused = back.groupBy("query_id", "id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"), F.min(F.struct("variant", "rank")).alias("first"))
        found = top(fused, k, F.desc("score"), F.col("first")).select("query_id", "id", "rank", "score")
    else:
        found = back.drop("variant")
    steps = {"search": found}
    if scorer is not None:
        pairs = found.join(chunks.select("id", "text"), "id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
        found = top(pairs.select("query_id", "id", scorer.alias("score")), 2 * o.k if parents is not None else o.k, F.desc("score"), F.col("id")).select("query_id", "id", "rank", "score")
        steps["rerank"] = found
    if parents is not None:
        found = expand_parents(found, parents, o.k)
        steps["parents"] = found
    found = found.where(F.col("rank") <= o.k)
    if not traced:
        return found
    steps["final"] = found
    counts = [x.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select("query_id", F.lit(name).alias("step"), "n") for name, x in steps.items()]
    out = counts[0]
    for x in counts[1:]:
        out = out.union(x)
    return found, out


def squashed(logit: Column) -> Column:
    """A pair scorer's raw value as a relevance between 0 and 1."""
    return sigmoid(logit)


def with_signals(lists: dict[str, DataFrame], fused: DataFrame) -> DataFrame:
    """fused results with signals, a map from the name of each list that has them to its score there."""
    parts = [x.select("query_id", "id", F.lit(name).alias("name"), F.col("score").cast("double").alias("s")) for name, x in lists.items()]
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    maps = every.groupBy("query_id", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "s")))).alias("signals"))  # one entry a list
    return fused.join(maps, ["query_id", "id"], "left")


def rerank_by_model(results: DataFrame, texts: DataFrame, queries: DataFrame, model: Model, k: int) -> DataFrame:
    """Results in the order that a model gives the numbered passages of each question. Passages that it doesn't
    name go; where the reply is no list of numbers the order stays. Scores fall evenly from 1."""
    held = results.join(texts.select("id", "text"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    rows = held.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("s"))
    numbered = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
    prompt = F.concat(F.lit('Order the passages by how well they answer, as JSON {"order": [numbers]}.\n\n'), numbered, F.lit("\n\nQuestion: "), F.col("query"))
    replied = complete(rows, prompt, model)
    said = F.from_json(json_object(F.col("reply")), "order array<int>")["order"]
    named = F.array_distinct(F.filter(said, lambda n: n.isNotNull() & (n >= 1) & (n <= F.size("s"))))
    order = F.when(F.size(named) > 0, named).otherwise(F.sequence(F.lit(1), F.size("s")))
    flat = replied.withColumn("order", order).select("query_id", F.size("order").alias("n"), F.posexplode("order").alias("at", "number"), "s")
    out = flat.select("query_id", F.get("s", F.col("number") - 1)["id"].alias("id"), (F.col("at") + 1).alias("rank"), F.round(1 - F.col("at") / (F.col("n") + 1), 6).alias("score"))
    return out.where(F.col("rank") <= k)
