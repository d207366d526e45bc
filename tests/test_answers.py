import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.guards import Guardrails, Rule
from sparkloom.operators import answering, filters, retrieval, search

DOCS = [(1, "Leave is 25 days a year. Ask your manager.", "hr"), (2, "The office opens at nine. Ask the desk.", "all"), (3, "Salaries are paid on the last day. Write to a@b.com.", "hr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string, role string")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def good(prompts):
    return [json.dumps({"answerable": True, "answer": "25 days.", "citations": [{"source": 1, "quote": "25 days a year"}, {"source": 1, "quote": "30 days"}]}) for _ in prompts]


def test_a_bad_reply_is_asked_for_once_more(spark, docs):
    def stubborn(prompts):
        return [good([p])[0] if p.endswith("nothing else.") else "no json" for p in prompts]

    x = answering.answer(asks(spark, "leave days"), docs, stubborn).first()
    assert (x.answer, x.calls, x.proposed, x.verified, x.warnings) == ("25 days.", 2, 2, 1, ["1 of 2 citations were dropped"])
    never = answering.answer(asks(spark, "leave days"), docs, lambda p: ["no"] * len(p)).first()
    assert (never.reason, never.calls, never.abstained) == ("low_confidence", 2, True)
    events = [r.stage for r in answering.trace(answering.answer(asks(spark, "leave days"), docs, stubborn)).orderBy("n").collect()]
    assert events == ["retrieve", "generate", "verify"]


@pytest.mark.parametrize("verdict,reason,warning", [({"supported": True, "unsupported_claims": []}, None, None), ({"supported": "true", "unsupported_claims": ["x"]}, "unverified_claims", "unsupported claim: x"), (None, None, "the check of the answer was inconclusive")])
def test_claims_are_checked(spark, docs, verdict, reason, warning):
    def model(prompts):
        return [json.dumps(verdict) if "Drafted answer" in p else good([p])[0] for p in prompts]

    x = answering.answer(asks(spark, "leave days"), docs, model, answering.AnswerOptions(verify=True)).first()
    assert x.reason == reason and (warning is None or warning in x.warnings) and x.calls == (3 if verdict is None else 2)
    flagged = answering.answer(asks(spark, "leave days"), docs, model, answering.AnswerOptions(verify=True, on_unsupported="flag")).first()
    assert not flagged.abstained


def test_guardrails_on_context_and_output(spark, docs):
    stop = Guardrails(pii=None, rules=[Rule("hr", ["Leave", "Salaries"])])
    got = {r.query_id: r for r in answering.answer(asks(spark, "salaries day", "office desk"), docs, options=answering.AnswerOptions(guardrails=stop)).collect()}
    assert got[1].reason == "guardrail_blocked" and got[2].reason is None
    own = answering.AnswerOptions(output=Guardrails(kinds=("email",), injection=False))
    x = answering.answer(asks(spark, "salaries paid last day write"), docs, lambda p: [json.dumps({"answer": "Write to a@b.com", "citations": [{"source": 1, "quote": "Write to a@b.com"}]}) for _ in p], own).first()
    assert (x.answer, x.citations[0].quote, x.citations[0].verified) == ("Write to [EMAIL]", "Write to [EMAIL]", True)
    blocked = answering.AnswerOptions(output=Guardrails(pii=None, rules=[Rule("w", ["days"])]))
    assert answering.answer(asks(spark, "leave days"), docs, good, blocked).first().reason == "guardrail_blocked"


def test_retrieval_pipeline(spark, docs):
    rules = filters.AccessRules(roles="role")
    q = asks(spark, "leave days a year", "office opens")
    found, counts = retrieval.retrieve(q, docs, retrieval.Retrieval(k=2), access=rules, caller=filters.Caller(roles=("all",)), traced=True)
    assert {(r.query_id, r.id) for r in found.collect()} == {(1, 2), (2, 2)}
    assert {r.step for r in counts.collect()} == {"search", "final"}
    wide = retrieval.retrieve(q, docs, retrieval.Retrieval(k=3, mode="sparse", transform="multi_query"), model=lambda p: [json.dumps({"queries": ["salaries paid"]}) for _ in p])
    assert {3} <= {r.id for r in wide.where("query_id = 1").collect()}
    score = F.size(F.array_intersect(F.split(F.lower("text"), " "), F.split("query", " ")))
    best = retrieval.retrieve(q, docs, retrieval.Retrieval(k=1), scorer=score, parents=spark.createDataFrame([(1, 10), (2, 20)], "id long, parent_id long"))
    assert {(r.query_id, r.id) for r in best.collect()} == {(1, 10), (2, 20)}
    talk = q.withColumn("history", F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text"))))
    follow = retrieval.retrieve(talk, docs, retrieval.Retrieval(k=1, mode="sparse"), model=lambda p: ["salaries paid"] * len(p))
    assert {r.id for r in follow.collect()} == {3}


def test_model_order_signals_and_rewrites(spark, docs):
    q = asks(spark, "ask")
    found = search.bm25(q, docs, 5)
    ids = [r.id for r in found.orderBy("rank").collect()]
    got = retrieval.rerank_by_model(found, docs, q, lambda p: ['{"order": [2, 9, 2]}'] * len(p), 5).collect()
    assert [(r.id, r.rank, r.score) for r in got] == [(ids[1], 1, 1.0)]
    same = retrieval.rerank_by_model(found, docs, q, lambda p: ["?"] * len(p), 5).orderBy("rank").collect()
    assert [r.id for r in same] == ids
    fused = search.rrf([found, found.limit(1)], 5)
    assert {tuple(sorted(r.signals)) for r in retrieval.with_signals({"a": found, "b": found.where("rank = 1")}, fused).collect()} == {("a", "b"), ("a",)}
    assert [r.text for r in answering.rewrite(q, lambda p: ["ASK "] * len(p)).collect()] == ["ask"]
    assert {r.variant for r in answering.hyde(q, lambda p: ["a passage"] * len(p)).collect()} == {0, 1}
    steps = answering.agentic_search(asks(spark, "leave", "office"), docs, lambda p: [json.dumps({"enough": "office" in x, "query": "salaries"}) for x in p], k=2)
    assert {(r.query_id, r.id) for r in steps.collect()} == {(1, 1), (1, 3), (2, 2)}


def test_the_index_is_kept_until_the_version_changes(spark, docs):
    a = search.KeywordIndex.build(docs, "v1", "kept")
    more = docs.union(spark.createDataFrame([(4, "Leave again", "hr")], docs.schema))
    assert search.KeywordIndex.build(more, "v1", "kept").n == a.n == 3 and search.KeywordIndex.build(more, "v2", "kept").n == 4
    q = asks(spark, "leave days", "nothing known")
    assert sorted(search.bm25(q, docs, 5, index=a).collect()) == sorted(search.bm25(q, docs, 5).collect())
