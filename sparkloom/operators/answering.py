"""Grounded answers for a table of questions: transforms, retrieval, generation, citations, abstention.

A model is any function from rows (prompt) to rows (reply) in pandas batches; Extractive is one without
weights that answers with the best sentence of the first source. Steps that call a model run on filtered
branches, so that rows which don't need a call cost none."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import Guardrails
from ..functions.text import contains_quote, json_object, last_messages
from ..tables import scratch
from .search import KeywordIndex, bm25, rrf, top

Model = Callable[[list[str]], list[str]]


AGAIN = "\n\nThat was not a JSON object. Reply with one JSON object and nothing else."


def is_object(reply: str | None) -> bool:
    """Whether the reply holds a JSON object, between its first and its last brace."""
    try:
        return isinstance(json.loads(reply[reply.index("{") : reply.rindex("}") + 1]), dict)
    except (ValueError, AttributeError, TypeError):
        return False


def complete(rows: DataFrame, prompt: Column, model: Model, batch: int = 64, tries: int = 1, valid: Callable[[str], bool] = is_object) -> DataFrame:
    """rows with reply, and calls, input_chars and output_chars: what the model was asked and said for the
    row. The model is called in batches inside the tasks; with tries beyond one, prompts whose reply isn't
    valid are asked again with a note, and a reply that never was is null."""
    schema = rows.withColumn("__prompt", prompt).schema
    names = list(schema.names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = f["__prompt"].fillna("").tolist()
            replies, calls, sent, got = [None] * len(asked), [0] * len(asked), [0] * len(asked), [0] * len(asked)
            open_ = list(range(len(asked)))
            for n in range(tries):
                for at in range(0, len(open_), batch):
                    some = open_[at : at + batch]
                    said = [asked[i] + (AGAIN if n else "") for i in some]
                    for i, p, r in zip(some, said, model(said)):
                        replies[i], calls[i], sent[i], got[i] = r, calls[i] + 1, sent[i] + len(p), got[i] + len(r or "")
                if tries > 1:
                    open_ = [i for i in open_ if not valid(replies[i])]
            if tries > 1:
                for i in open_:
                    replies[i] = None
            yield f.assign(reply=replies, calls=calls, input_chars=sent, output_chars=got)

    done = rows.withColumn("__prompt", prompt).mapInPandas(run, schema.add("reply", "string").add("calls", "integer").add("input_chars", "long").add("output_chars", "long"))
    return done.select(*[n for n in names if n != "__prompt"], "reply", *_SPENT)


_SPENT = ("calls", "input_chars", "output_chars")


class Extractive:
    """Quotes of each prompt's first source the sentence that shares most words with the question."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        sources, _, question = prompt.rpartition("\n\nQuestion: ")
        found = re.search(r"\[1\][^\n]*\n(.*?)(?=\n\n\[2\]|\Z)", sources, re.S)
        if not found:
            return json.dumps({"answerable": False, "answer": "", "citations": []})
        asked = set(re.findall(r"\w+", question.lower()))
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", found[1].strip()) if s]
        if not sentences:
            return json.dumps({"answerable": False, "answer": "", "citations": []})
        best = max(sentences, key=lambda s: (len(asked & set(re.findall(r"\w+", s.lower()))), -sentences.index(s)))
        return json.dumps({"answerable": True, "answer": best, "citations": [{"source": 1, "quote": best}]}, ensure_ascii=False)


def with_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, turn, question, history): each user turn with the last n messages before it."""
    w = "(partition by conv_id order by turn rows between {} preceding and 1 preceding)"
    said = F.struct("role", "text")
    x = turns.withColumn("__m", said).withColumn("history", F.expr(f"collect_list(__m) over {w.format(n)}"))
    return x.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "history")


def condense(questions: DataFrame, model: Model, n: int = 6) -> DataFrame:
    """Follow-ups made to stand alone. Only rows with a history go to the model; an empty reply changes nothing."""
    asked = F.size("history") > 0
    talk = F.array_join(F.transform(last_messages(F.col("history"), n), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    follow = complete(questions.where(asked), F.concat(F.lit("Rewrite the last question so that it stands alone.\n"), talk, F.lit("\n\nQuestion: "), F.col("question")), model)
    follow = follow.withColumn("query", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), F.col("question"))).drop("reply", *_SPENT)
    return follow.unionByName(questions.where(~asked).withColumn("query", F.col("question")))


def expand_queries(questions: DataFrame, model: Model, n: int = 3) -> DataFrame:
    """(query_id, variant, text): the question first, then up to n others from the model, no repeats."""
    prompt = F.concat(F.lit(f'Give {n} other wordings as JSON {{"queries": [...]}}.\n\nQuestion: '), F.col("text"))
    replied = complete(questions.select("query_id", "text"), prompt, model)
    other = F.coalesce(F.from_json(json_object(F.col("reply")), "queries array<string>")["queries"], F.array().cast("array<string>"))
    rows = replied.select("query_id", F.posexplode(F.slice(F.concat(F.array("text"), other), 1, n + 1)).alias("variant", "text")).where("trim(text) != ''")
    first = rows.groupBy("query_id", F.lower("text").alias("k")).agg(F.min(F.struct("variant", "text")).alias("x"))
    return first.select("query_id", "x.variant", "x.text")


def rewrite(questions: DataFrame, model: Model) -> DataFrame:
    """Each question, and what the model makes of it for search, as two variants; one where these are equal."""
    replied = complete(questions.select("query_id", "text"), F.concat(F.lit("Rewrite this question as a search query.\n\nQuestion: "), F.col("text")), model)
    same = F.lower(F.trim(F.coalesce("reply", F.lit("")))).isin("") | (F.lower(F.trim("reply")) == F.lower(F.trim("text")))
    first, other = F.struct(F.lit(0).alias("variant"), F.col("text").alias("text")), F.struct(F.lit(1).alias("variant"), F.trim("reply").alias("text"))
    return replied.select("query_id", F.explode(F.when(same, F.array(first)).otherwise(F.array(first, other))).alias("x")).select("query_id", "x.variant", "x.text")


def hyde(questions: DataFrame, model: Model, words: int = 80) -> DataFrame:
    """Each question, and a passage from the model that might answer it, as two variants."""
    replied = complete(questions.select("query_id", "text"), F.concat(F.lit(f"Write a passage of about {words} words that answers this.\n\nQuestion: "), F.col("text")), model)
    both = F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("text")), F.struct(F.lit(1).alias("variant"), F.col("reply").alias("text")))
    return replied.select("query_id", F.explode(both).alias("x")).select("query_id", "x.variant", "x.text").where("trim(text) != ''")


def search_variants(variants: DataFrame, docs: DataFrame, k: int = 10, depth: int = 20, index: KeywordIndex | None = None) -> DataFrame:
    """Keyword search for every variant (query_id, variant, text), fused by reciprocal ranks."""
    keyed = variants.select(F.struct("query_id", "variant").alias("query_id"), "text")
    found = bm25(keyed, docs, depth, index=index).select(F.col("query_id.query_id").alias("query_id"), "id", "rank", F.col("query_id.variant").alias("variant"))
    fused = found.groupBy("query_id", "id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"), F.min(F.struct("variant", "rank")).alias("first"))
    return top(fused, k, F.desc("score"), F.col("first")).select("query_id", "id", "rank", "score")


def agentic_search(questions: DataFrame, docs: DataFrame, judge: Model, k: int = 5, max_steps: int = 3, index: KeywordIndex | None = None) -> DataFrame:
    """Search, let the judge see what was found, search again with its query; a bounded number of steps
    over the questions that are still open. A step's lists are fused at the end."""
    open_, lists = questions.select("query_id", "text", F.col("text").alias("asked")), []
    for _ in range(max_steps):
        found = scratch(bm25(open_.select("query_id", "text"), docs, k, index=index), "agentic")
        lists.append(found)
        seen = found.where("rank <= 6").join(docs.select("id", F.substring("text", 1, 300).alias("t")), "id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n---\n").alias("seen"))
        prompt = F.concat(F.lit('Reply as JSON {"enough": bool, "query": text}.\n'), F.col("seen"), F.lit("\n\nQuestion: "), F.col("asked"))
        replied = complete(open_.join(seen, "query_id"), prompt, judge)
        said = F.from_json(json_object(F.col("reply")), "enough boolean, query string")
        more = replied.select("query_id", "asked", "text", said.alias("s")).where("s is not null and not coalesce(s.enough, true) and trim(coalesce(s.query, '')) != '' and lower(trim(s.query)) != lower(trim(text))")
        open_ = scratch(more.select("query_id", F.col("s.query").alias("text"), "asked"), "agentic")  # a step's calls are made once
    return rrf(lists, k)


@dataclass(frozen=True)
class AnswerOptions:
    """verify: whether a second call looks for claims that the sources don't support; on_unsupported: abstain or
    flag. output: guardrails on the answer and on each quote. min_chunks, min_score: what counts as found."""

    k: int = 5
    min_chunks: int = 1
    min_score: float = 0.0
    require_verified: bool = True
    guardrails: Guardrails = field(default_factory=lambda: Guardrails(pii=None))
    output: Guardrails | None = None
    verify: bool = False
    on_unsupported: str = "abstain"


def _citations(o: AnswerOptions):
    def check(replies: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for reply, sources in zip(replies, texts):
            try:
                said = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
            except (ValueError, AttributeError, TypeError):
                said = None
            if not isinstance(said, dict):
                out.append((False, "", "low_confidence", 0, 0, []))
                continue
            answerable = str(said.get("answerable", True)).lower() not in ("false", "no", "0")
            text = str(said.get("answer") or "").strip()
            if not answerable or not text:
                out.append((False, "", "no_relevant_context", 0, 0, []))
                continue
            seen, cited = set(), []
            proposed = [c for c in said.get("citations") or [] if isinstance(c, dict)]
            for c in proposed:
                number = re.search(r"\d+", str(c.get("source", "")))
                n, quote = int(number[0]) if number else 0, str(c.get("quote") or "")
                if 1 <= n <= len(sources) and (n, quote) not in seen:
                    seen.add((n, quote))
                    cited.append({"source": n, "quote": quote, "verified": contains_quote(quote, sources[n - 1])})
            kept = [c for c in cited if c["verified"]] if o.require_verified else cited
            ok = bool(kept) or not o.require_verified
            out.append((ok, text if ok else "", None if ok else "unverified_claims", len(proposed), sum(c["verified"] for c in cited), kept))
        return pd.DataFrame(out, columns=["answered", "text", "reason", "proposed", "verified", "citations"])

    return F.pandas_udf(check, "struct<answered boolean, text string, reason string, proposed int, verified int, citations array<struct<source int, quote string, verified boolean>>>")


def check_claims(rows: DataFrame, prompt: Column, model: Model) -> DataFrame:
    """rows with supported (null: the model gave no verdict in two tries) and unsupported, the claims it named.
    An answer counts as supported only if no claim is named."""
    note = F.lit('\n\nList the claims of the drafted answer that the sources don\'t support, as JSON {"supported": bool, "unsupported_claims": [...]}.')

    def valid(reply: str) -> bool:
        return is_object(reply) and isinstance(json.loads(reply[reply.index("{") : reply.rindex("}") + 1]).get("supported"), bool | str)

    replied = complete(rows, F.concat(prompt, note), model, tries=2, valid=valid)
    said = F.from_json(json_object(F.col("reply")), "supported string, unsupported_claims array<string>")
    x = replied.withColumn("__said", said).withColumn("unsupported", F.coalesce("__said.unsupported_claims", F.array().cast("array<string>")))
    ok = (F.lower(F.trim("__said.supported")) == "true") & (F.size("unsupported") == 0)
    return x.withColumn("supported", F.when(F.col("__said.supported").isNotNull(), ok)).drop("__said", "reply")


def answer(questions: DataFrame, docs: DataFrame, model: Model | None = None, options: AnswerOptions | None = None, results: DataFrame | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, answer, abstained, reason, citations, proposed, verified, sources, warnings, calls,
    input_chars, output_chars) of questions (query_id, text).

    Input guardrails come first, then retrieval (results, or keyword search), guardrails on what was found,
    the check that enough was found, generation with numbered sources (asked once more if the reply is no
    JSON object), the check of every quote, of the claims if asked for, and guardrails on the output."""
    o, model = options or AnswerOptions(), model or Extractive()
    guarded = questions.select("query_id", o.guardrails.apply(F.col("text")).alias("g"))
    asked = guarded.where("g.action in ('allow', 'redact')").select("query_id", F.col("g.text").alias("text"))
    found = (results if results is not None else bm25(asked, docs, o.k, index=index)).join(docs.select("id", "text"), "id")
    found = found.select("query_id", "id", "rank", "score", o.guardrails.apply(F.col("text")).alias("g"))
    passed = F.col("g.action").isin("allow", "redact")
    entry = F.when(passed, F.struct("rank", "id", "score", F.col("g.text").alias("text")))
    context = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("s"), F.count_if(~passed).alias("stopped"))
    rows = asked.join(context, "query_id", "left").withColumn("n", F.coalesce(F.size("s"), F.lit(0))).withColumn("stopped", F.coalesce("stopped", F.lit(0)))
    enough = (F.col("n") >= max(1, o.min_chunks)) & (F.coalesce(F.get("s", F.lit(0))["score"], F.lit(0.0)) >= o.min_score)
    rows = rows.withColumn("enough", enough)
    removed = F.when(F.col("stopped") > 0, F.concat(F.col("stopped").cast("string"), F.lit(" passages were removed by guardrails")))
    numbered = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x["id"].cast("string"), F.lit("\n"), x["text"])), "\n\n")
    replied = complete(rows.where("enough").select("query_id", "text", "s", removed.alias("removed"), F.concat(numbered, F.lit("\n\nQuestion: "), F.col("text")).alias("asked")), F.col("asked"), model, tries=2)
    checked = replied.withColumn("a", _citations(o)(F.col("reply"), F.transform("s", lambda x: x["text"])))
    dropped = F.col("a.proposed") - F.size("a.citations")
    lost = F.when((dropped > 0) & F.col("a.answered"), F.concat(dropped.cast("string"), F.lit(" of "), F.col("a.proposed").cast("string"), F.lit(" citations were dropped")))
    x = checked.select("query_id", "asked", F.col("a.text").alias("answer"), (~F.col("a.answered")).alias("abstained"), F.col("a.reason").alias("reason"), F.col("a.citations").alias("citations"), F.col("a.proposed").alias("proposed"), F.col("a.verified").alias("verified"), F.transform("s", lambda s: s["id"]).alias("sources"), F.array_compact(F.array("removed", lost)).alias("warnings"), *_SPENT)
    if o.verify:
        x = _verified(x, model, o)
    if o.output is not None:
        x = _guarded(x, o.output)
    good = x.drop("asked")
    none = {f.name: F.lit(None).cast(f.dataType) for f in good.schema}

    def empty(df: DataFrame, reason: Column) -> DataFrame:
        fixed = {"answer": F.lit(""), "abstained": F.lit(True), "reason": reason, "proposed": F.lit(0), "verified": F.lit(0), "calls": F.lit(0), "input_chars": F.lit(0).cast("long"), "output_chars": F.lit(0).cast("long")}
        warned = F.array_compact(F.array(removed)) if "stopped" in df.columns else F.array().cast("array<string>")
        return df.select("query_id", *[(warned if n == "warnings" else fixed.get(n, c)).alias(n) for n, c in none.items() if n != "query_id"])

    why = F.when((F.col("n") == 0) & (F.col("stopped") > 0), "guardrail_blocked").otherwise("no_relevant_context")
    return good.unionByName(empty(rows.where("not enough"), why)).unionByName(empty(guarded.where("g.action in ('block', 'escalate')"), F.lit("guardrail_blocked")))


def _verified(x: DataFrame, model: Model, o: AnswerOptions) -> DataFrame:
    """The answers with their claims checked; those that abstained already cost no call."""
    spent = [F.col(c).alias(f"__{c}") for c in _SPENT]
    todo = x.where("not abstained").select(*[c for c in x.columns if c not in _SPENT], *spent)
    seen = check_claims(todo, F.concat("asked", F.lit("\n\nDrafted answer: "), "answer"), model)
    failed = F.coalesce(~F.col("supported"), F.lit(False))
    claims = F.transform("unsupported", lambda c: F.concat(F.lit("unsupported claim: "), c))
    note = F.when(F.col("supported").isNull(), F.array(F.lit("the check of the answer was inconclusive"))).when(failed & (F.size("unsupported") == 0), F.array(F.lit("the check found the answer unsupported"))).otherwise(claims)
    stop = failed & F.lit(o.on_unsupported == "abstain")
    seen = seen.withColumns({"warnings": F.concat("warnings", note), "abstained": stop, "answer": F.when(stop, "").otherwise(F.col("answer")), "reason": F.when(stop, F.lit("unverified_claims")).otherwise(F.col("reason")), **{c: F.col(c) + F.col(f"__{c}") for c in _SPENT}})
    return x.where("abstained").unionByName(seen.select(*x.columns))


def _guarded(x: DataFrame, g: Guardrails) -> DataFrame:
    """Guardrails on the answer, then on each quote: stopped quotes go, redacted ones stay verified."""
    said = x.withColumn("__g", g.apply(F.col("answer")))
    stop = ~F.col("abstained") & ~F.col("__g.action").isin("allow", "redact")
    quotes = F.transform("citations", lambda c: F.struct(c["source"].alias("source"), g.apply(c["quote"]).alias("g"), c["verified"].alias("verified")))
    kept = F.transform(F.filter(quotes, lambda c: c["g"]["action"].isin("allow", "redact")), lambda c: F.struct(c["source"].alias("source"), c["g"]["text"].alias("quote"), c["verified"].alias("verified")))
    return said.withColumns({"citations": kept, "answer": F.when(F.col("abstained") | stop, "").otherwise(F.col("__g.text")), "reason": F.when(stop, F.lit("guardrail_blocked")).otherwise(F.col("reason")), "abstained": F.col("abstained") | stop}).drop("__g")


def cited_sources(citations: Column) -> Column:
    """The distinct source numbers of an answer's citations, in the order of their first use."""
    return F.array_distinct(F.transform(citations, lambda c: c["source"]))


def trace(answers: DataFrame, include_text: bool = False) -> DataFrame:
    """(query_id, stage, name, data) of answers: what was found, generated, cited and why one abstained. Texts
    are left out unless asked for."""
    event = lambda stage, name, **data: F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("name"), F.to_json(F.struct(*[v.alias(k) for k, v in data.items()])).alias("data"))
    found = event("retrieve", "results", n=F.coalesce(F.size("sources"), F.lit(0)))
    made = event("generate", "generate", calls=F.col("calls"), input_chars=F.col("input_chars"), output_chars=F.col("output_chars"), **({"text": F.col("answer")} if include_text else {}))
    cited = event("verify", "citations", proposed=F.col("proposed"), verified=F.col("verified"))
    ended = event("abstain", "abstain", reason=F.col("reason"))
    events = F.array_compact(F.array(found, F.when(F.col("calls") > 0, made), F.when(F.col("calls") > 0, cited), F.when(F.col("abstained"), ended)))
    return answers.select("query_id", F.posexplode(events).alias("n", "e")).select("query_id", "n", "e.stage", "e.name", "e.data")
