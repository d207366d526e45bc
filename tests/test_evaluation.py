import json

from pyspark.sql import functions as F

from sparkloom.operators import evaluation as ev
from sparkloom.operators import synth

CIT = "array<struct<source int, quote string, verified boolean>>"


def test_places_citations_and_abstention(spark):
    results = spark.createDataFrame([(1, 10, 1, "docs/hr/Leave.md", "Leave > Days", "Leave is 25 days."), (1, 11, 2, "docs/it.md", "", "x"), (2, 10, 1, "docs/hr/Leave.md", "Leave > Days", "Leave is 25 days."), (3, 11, 1, "docs/it.md", "VPN", "x")], "query_id int, id int, rank int, source string, section string, text string")
    gold = spark.createDataFrame([(1, 0, "leave.md", None, "25  days"), (1, 1, "it.md", "Printers", None), (2, 0, "HR\\Leave.md", "days", None), (3, 0, "it.md", None, None), (4, 0, "it.md", None, None)], "query_id int, gold_no int, source string, section string, quote string")
    links = ev.gold_links(results, gold)
    assert {tuple(r) for r in links.collect()} == {(1, 0, 10, 1), (2, 0, 10, 1), (3, 0, 11, 1)}
    assert {tuple(r) for r in ev.metrics_by_place(links, gold).collect()} == {(1, 1.0, 0.5, 1.0), (2, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0), (4, 0.0, 0.0, 0.0)}
    cases = spark.createDataFrame([(1, True, "q1", "25", True), (2, True, "q2", "25", True), (3, True, "q3", "v", True), (5, False, "q5", None, False)], "query_id int, answerable boolean, question string, gold_answer string, has_gold boolean")
    answers = spark.createDataFrame([(1, False, 3, 2, [(1, "a", True), (2, "b", True)], "25", "s", None), (2, True, 0, 0, [], "", "s", None), (3, False, 1, 1, [(1, "a", True)], "v", "s", None), (5, False, 1, 0, [], "no", "s", "Boom")], f"query_id int, abstained boolean, proposed int, verified int, citations {CIT}, answer string, context string, error string")
    got = {r.query_id: (r.citation_valid_rate, r.citation_source_match) for r in ev.citation_metrics(answers, results, links, cases).collect()}
    assert got == {1: (0.666667, 0.5), 2: (None, None), 3: (1.0, 1.0), 5: (0.0, None)}
    said = {r.query_id: tuple(r)[1:] for r in ev.abstention_metrics(answers, cases).collect()}
    assert said == {1: (1.0, 0.0, None), 2: (0.0, 1.0, None), 3: (1.0, 0.0, None), 5: (0.0, None, 0.0)}
    calls = []

    def model(prompts):
        calls.extend(prompts)
        return [json.dumps({"verdict": "Partial" if "expected answer" in p else "supported"}) if "25" in p else "?" for p in prompts]

    graded = {r.query_id: (r.correctness, r.groundedness) for r in ev.judge(answers, cases, model).collect()}
    assert graded == {1: (0.5, 1.0), 2: (0.0, None), 3: (None, None), 5: (None, None)}
    values = ev.full_report(cases, answers, results, gold, ev.judge(answers, cases, model))
    means = {r.metric: r["mean"] for r in ev.summarize(values).collect()}
    assert means["error_rate"] == 0.25 and means["hit"] == 1.0 and means["abstain_correct"] == 0.666667
    assert [r.query_id for r in ev.worst(values, 1).collect()] == [5]
    text = ev.render("Run", ev.summarize(values))
    assert text.startswith("# Run") and "| error_rate | 4 | 0.250 |" in text and json.loads(ev.render("Run", ev.summarize(values), form="json"))["title"] == "Run" and "error_rate" in ev.render("Run", ev.summarize(values), form="text")


def test_samples_ablation_and_resumed_runs(spark, tmp_path):
    cases = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("question"), F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    assert ev.judge_sample(cases, 5).collect() == ev.judge_sample(cases.repartition(3), 5).collect() and ev.judge_sample(cases, None).count() == 40
    make = lambda v: (lambda: cases.select("query_id", F.lit("hit").alias("metric"), F.lit(v).alias("value")))
    values, broken = ev.ablate({"a": make(1.0), "b": lambda: cases.select("nope"), "c": make(0.5)})
    assert set(broken) == {"b"} and {tuple(r) for r in ev.ablation_by_tag(values, cases, "hit", ["a", "c"]).collect()} == {("even", 1.0, 0.5), ("odd", 1.0, 0.5)}
    fails = F.when(F.col("query_id") % 10 == 0, "Boom").cast("string")
    first = ev.run_resumed(cases.select("query_id", "question"), str(tmp_path / "run"), lambda df: df.withColumn("error", fails).withColumn("n", F.lit(1)), 2)
    assert first.where("error is not null").count() == 4 and first.count() == 40
    again = ev.run_resumed(cases.select("query_id", "question"), str(tmp_path / "run"), lambda df: df.withColumn("error", F.lit(None).cast("string")).withColumn("n", F.lit(2)), 2)
    assert {r.n: r["count"] for r in again.groupBy("n").count().collect()} == {1: 36, 2: 4}


PASSAGE = "The annual leave of all permanent staff is 25 days and part of it may be carried over into March. " * 3


def test_drafts_and_generation(spark):
    chunks = spark.createDataFrame([(i, f"s{i % 3}", PASSAGE + str(i), i, ["Leave", "Pay", "Leave"][i % 3]) for i in range(9)], "id int, source string, text string, ordinal int, heading_path string")
    reply = {"question": "How much holiday do people get?", "answer": "25 days", "quote": "is 25 days", "followup": "And when does it lapse?", "followup_answer": "in March"}
    why = lambda **x: [r["drop"] for r in synth.draft_followup(chunks.limit(1), lambda p: [json.dumps(reply | x)] * len(p)).collect()]
    assert why() == [None] and why(quote="thirty days off") == ["quote_not_in_passage"] and why(followup=reply["question"]) == ["followup_not_short_or_distinct"]
    assert why(answer="26 days") == ["answer_number_not_in_passage"] and why(skip=True) == ["passage_not_suitable"] and why(quote="") == ["incomplete_reply"]
    assert why(question="What does the passage above say?") == ["refers_to_passage"] and why(question="Is the annual leave of all permanent staff long?") == ["copies_passage_wording"]
    assert [r["drop"] for r in synth.draft_answerable(chunks.limit(1), lambda p: ["?"] * len(p)).collect()] == ["unusable_reply"]
    names = ["apple", "pear", "plum", "cherry", "fig", "quince", "grape", "lemon", "melon"]

    def model(prompts):
        out = []
        for p in prompts:
            if "sources answer" in p:
                out.append(json.dumps({"answered": "parking" not in p}))
            else:
                k = names[int(p.strip()[-1])]
                out.append(json.dumps(reply | {"question": f"{k} {k}s holiday", "followup": f"then {k} lapse"}))
        return out

    asks = spark.createDataFrame([(1, "parking spaces cost"), (2, "annual leave days")], "query_id int, text string")
    cases, report = synth.generate(chunks, model, answerable=3, followups=2, unanswerable=asks)
    rows = cases.collect()
    assert report["kept"] == {"followup": 2, "answerable": 3, "unanswerable": 1} and report["sources_covered"] == 3 and report["dropped"] == {"unanswerable: actually_answerable": 1}
    assert len({r.id for r in rows}) == 6 and {r.split for r in rows} <= {"dev", "test"} and sum(not r.answerable for r in rows) == 1
    _, short = synth.generate(chunks, lambda p: ["?"] * len(p), answerable=2)
    assert short["warnings"] == ["0 of 2 answerable questions were made"] and short["dropped"] == {"answerable: unusable_reply": 9}
    assert {r.line for r in synth.outline(chunks).collect()} == {"- s0: Leave", "- s1: Pay", "- s2: Leave"}


def test_numbers_within_sources_and_heavy_words(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("source"), F.concat(F.repeat(F.lit("x "), 150), F.col("id").cast("string")).alias("text"))
    got = synth.candidates(rows).select("source", "turn", "id").collect()
    hot = sorted(r.turn for r in got if r.source == "hot")
    assert hot == list(range(1, 2001)) and sorted(r.turn for r in got if r.source is None) == list(range(1, 1001))
    q = spark.range(60).select("id", F.concat(F.lit("same word list here "), F.col("id").cast("string")).alias("text"))
    every = {(a, b) for a in range(60) for b in range(a + 1, 60)}
    pairs = lambda block: {(r.a, r.b) for r in synth.similar_questions(q, 0.6, block).collect()}
    assert pairs(2000) == pairs(7) == every
