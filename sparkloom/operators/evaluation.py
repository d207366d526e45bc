"""Evaluation over tables of cases: retrieval metrics, intervals, outcomes, gates, comparisons."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_object, path_matches, quote_in_text, stable_hash
from ..tables import exists, scratch, union_all
from .answering import Model, complete, is_object

Z = 1.96
LOWER_IS_BETTER = ("answerable_abstain_rate", "error_rate")


def retrieval_metrics(results: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, hit, recall, mrr) of cases (query_id) that have gold (query_id, id); results carry ranks."""
    total = gold.groupBy("query_id").agg(F.countDistinct("id").alias("wanted"))
    found = results.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.countDistinct("id").alias("n"), F.min("rank").alias("best"))
    rows = cases.select("query_id").join(total, "query_id").join(found, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("query_id", (n > 0).cast("double").alias("hit"), F.round(n / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def melt(metrics: DataFrame, *names: str, key: str = "query_id") -> DataFrame:
    return metrics.unpivot(key, list(names), "metric", "value").where("value is not null")


def wilson(mean: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson score interval of a share."""
    d = 1 + Z * Z / n
    mid = (mean + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(mean * (1 - mean) / n + Z * Z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def summarize(values: DataFrame, *by: str) -> DataFrame:
    """(*by, metric, n, mean, low, high) of long values (metric, value): Wilson intervals where all values
    are 0 or 1, normal ones else; none for fewer than two values."""
    x = values.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary"))
    return _intervals(x, *by)


def _intervals(x: DataFrame, *by: str) -> DataFrame:
    low, high = wilson(F.col("m"), F.col("n"))
    half = Z * F.sqrt(F.col("v") / F.col("n"))
    some = F.col("n") >= 2
    pick = lambda a, b: F.when(some, F.round(F.when(F.col("binary"), a).otherwise(b), 6))
    return x.select(*by, "metric", "n", F.round("m", 6).alias("mean"), pick(low, F.greatest(F.lit(0.0), F.col("m") - half)).alias("low"), pick(high, F.least(F.lit(1.0), F.col("m") + half)).alias("high"))


def with_total(values: DataFrame, by: str) -> DataFrame:
    """summarize() for every value of by and, under "all", for everything, in one pass of grouping sets."""
    x = values.groupingSets([["metric", by], ["metric"]], "metric", by).agg(
        F.when(F.grouping(by) == 1, F.lit("all")).otherwise(F.col(by)).alias("part"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary")
    )
    return _intervals(x, "part").withColumnRenamed("part", by)


def by_tag(values: DataFrame, cases: DataFrame) -> DataFrame:
    """Means by tag of long values (query_id, metric, value) and cases (query_id, tags)."""
    tagged = values.join(cases.select("query_id", F.explode("tags").alias("tag")), "query_id")
    return tagged.groupBy("tag", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def outcome(error: Column, answerable: Column, abstained: Column, hit: Column, correctness: Column, citation: Column) -> Column:
    """Why a case ended as it did: the first reason that holds. Nulls mean not measured."""
    missed = hit == 0
    return (
        F.when(error.isNotNull(), "error")
        .when(~answerable & ~abstained, "answered_unanswerable")
        .when(~answerable, "ok")
        .when(abstained & missed, "retrieval_miss")
        .when(abstained, "wrong_abstention")
        .when((correctness < 1) & missed, "retrieval_miss")
        .when(correctness < 1, "wrong_with_right_context")
        .when(correctness.isNull() & missed, "retrieval_miss")
        .when(citation < 1, "citation_problem")
        .otherwise("ok")
    )


def outcome_counts(outcomes: DataFrame, sample: int = 3) -> DataFrame:
    """(outcome, n, examples): the smallest ids, kept few before anything is gathered."""
    order = F.expr("row_number() over (partition by outcome order by query_id)")
    few = outcomes.withColumn("k", order).where(F.col("k") <= sample).groupBy("outcome").agg(F.array_sort(F.collect_list("query_id")).alias("examples"))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).join(few, "outcome")


def gate(summary: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """(metric, threshold, mean, passed): a metric that wasn't measured fails."""
    spark = summary.sparkSession
    want = spark.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "metric string, threshold double")
    x = want.join(summary.select("metric", "mean"), "metric", "left")
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("mean") <= F.col("threshold")).otherwise(F.col("mean") >= F.col("threshold"))
    return x.select("metric", "threshold", "mean", F.coalesce(good, F.lit(False)).alias("passed"))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, before, now, delta) of what both summaries have."""
    a, b = before.select("metric", F.col("mean").alias("before")), now.select("metric", F.col("mean").alias("now"))
    return a.join(b, "metric").select("metric", "before", "now", F.round(F.col("now") - F.col("before"), 6).alias("delta"))


def ablation(runs: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each metric, a column for each variant's mean; runs are summaries (metric, mean)."""
    parts = [x.select("metric", "mean", F.lit(k).alias("variant")) for k, x in runs.items()]
    both = parts[0]
    for x in parts[1:]:
        both = both.union(x)
    return both.groupBy("metric").pivot("variant", list(runs)).agg(F.first("mean"))


def dataset_warnings(cases: DataFrame) -> DataFrame:
    """One row of counts of what a question set lacks: cases (gold_answer, gold_sources, answerable, split)."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("answerable") & (F.coalesce("gold_answer", F.lit("")) == "")).alias("without_answer"),
        F.count_if(F.col("answerable") & (F.coalesce(F.size("gold_sources"), F.lit(0)) < 1)).alias("without_sources"),
        (F.count_if(~F.col("answerable")) == 0).alias("no_unanswerable"),
        (F.count_if(F.col("split") == "test") == 0).alias("no_test_split"),
    )


def remaining(cases: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do: cases without a finished result for the same question."""
    ok = done.where("error is null").select("query_id", "question")
    return cases.join(ok, ["query_id", "question"], "left_anti")


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, cost_usd); cost is null for models without a price."""
    x = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return x.join(prices, "model", "left").select("model", "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"))


# -- gold passages by place

def place_matches(source: Column, section: Column, text: Column, want_source: Column, want_section: Column, want_quote: Column) -> Column:
    """Whether a passage is where a reference points: its file, and then the quote in its text if one is given,
    else the section in its headings if one is given."""
    flat = lambda c: F.lower(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))))
    inside = F.when(F.coalesce(want_quote, F.lit("")) != "", quote_in_text(want_quote, text)).when(F.coalesce(want_section, F.lit("")) != "", F.contains(flat(section), flat(want_section))).otherwise(F.lit(True))
    return path_matches(F.coalesce(source, F.lit("")), want_source) & inside


def gold_links(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_no, id, rank): which results (query_id, id, rank, source, section, text) are at which gold
    place (query_id, gold_no, source, section, quote). They meet by query; quotes are tested last, on what is left."""
    want = gold.select("query_id", "gold_no", F.col("source").alias("want_source"), F.col("section").alias("want_section"), "quote")
    pairs = results.join(want, "query_id").where(path_matches(F.coalesce("source", F.lit("")), F.col("want_source")))
    return pairs.where(place_matches(F.col("source"), F.col("section"), F.col("text"), F.col("want_source"), F.col("want_section"), F.col("quote"))).select("query_id", "gold_no", "id", "rank")


def metrics_by_place(links: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, hit, recall, mrr) of all queries with gold places, from gold_links()."""
    total = gold.groupBy("query_id").agg(F.countDistinct("gold_no").alias("wanted"))
    found = links.groupBy("query_id").agg(F.countDistinct("gold_no").alias("n"), F.min("rank").alias("best"))
    n = F.coalesce("n", F.lit(0))
    return total.join(found, "query_id", "left").select("query_id", (n > 0).cast("double").alias("hit"), F.round(n / F.col("wanted"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


# -- answers

def citation_metrics(answers: DataFrame, results: DataFrame, links: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, citation_valid_rate, citation_source_match): verified of proposed citations; and, of the
    citations of answered questions that can be answered and have gold, those whose passage is at a gold place.
    Null where there is nothing to measure. answers: (query_id, abstained, proposed, verified, citations)."""
    valid = F.when(F.col("proposed") > 0, F.round(F.col("verified") / F.col("proposed"), 6))
    cited = answers.where("not abstained").select("query_id", F.explode("citations").alias("c")).select("query_id", F.col("c.source").alias("rank"))
    at_gold = results.select("query_id", "rank", "id").join(links.select("query_id", "id").distinct().withColumn("gold", F.lit(1)), ["query_id", "id"], "left")
    share = cited.join(at_gold, ["query_id", "rank"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("gold", F.lit(0))), 6).alias("share"))
    asked = cases.select("query_id", "answerable", F.col("has_gold"))
    x = answers.select("query_id", valid.alias("citation_valid_rate")).join(asked, "query_id").join(share, "query_id", "left")
    return x.select("query_id", "citation_valid_rate", F.when(F.col("answerable") & F.col("has_gold"), F.col("share")).alias("citation_source_match"))


def abstention_metrics(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, abstain_correct, answerable_abstain_rate, unanswerable_abstain_rate); of the last two the one
    that doesn't apply is null."""
    x = answers.select("query_id", "abstained").join(cases.select("query_id", "answerable"), "query_id")
    said = F.col("abstained").cast("double")
    return x.select("query_id", (F.col("abstained") != F.col("answerable")).cast("double").alias("abstain_correct"), F.when(F.col("answerable"), said).alias("answerable_abstain_rate"), F.when(~F.col("answerable"), said).alias("unanswerable_abstain_rate"))


def judge_sample(cases: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """The cases that a judge grades: n of them in the order of a seeded digest of their ids; all where n is None."""
    if n is None:
        return cases
    return cases.orderBy(stable_hash(F.lit(str(seed)), F.col("query_id").cast("string")), "query_id").limit(n)


VERDICTS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}
GROUNDED = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0}


def judge(answers: DataFrame, cases: DataFrame, model: Model) -> DataFrame:
    """(query_id, correctness, groundedness) of answers (query_id, answer, abstained, context) to cases (query_id,
    question, gold_answer, answerable). One who abstains from what could be answered has 0 without a call; a
    verdict that doesn't come in two tries is null."""
    x = answers.select("query_id", "answer", "abstained", "context").join(cases.select("query_id", "question", "gold_answer", "answerable"), "query_id")

    def graded(rows: DataFrame, ask: Column, scale: Mapping[str, float], name: str) -> DataFrame:
        def valid(reply: str) -> bool:
            return is_object(reply) and str(json.loads(reply[reply.index("{") : reply.rindex("}") + 1]).get("verdict", "")).lower() in scale

        told = complete(rows.select("query_id", ask.alias("__ask")), F.col("__ask"), model, tries=2, valid=valid)
        verdict = F.lower(F.from_json(json_object(F.col("reply")), "verdict string")["verdict"])
        return told.select("query_id", F.element_at(F.create_map(*[F.lit(v) for kv in scale.items() for v in kv]), verdict).alias(name))

    rate = lambda scale: F.lit(f' Reply as JSON {{"verdict": one of {", ".join(scale)}}}.\n\n')
    asked = x.where(F.col("answerable") & (F.coalesce("gold_answer", F.lit("")) != "") & ~F.col("abstained"))
    right = graded(asked, F.concat(F.lit("Does the answer say what the expected answer says?"), rate(VERDICTS), F.lit("Question: "), "question", F.lit("\nExpected: "), "gold_answer", F.lit("\nAnswer: "), "answer"), VERDICTS, "correctness")
    silent = x.where(F.col("answerable") & (F.coalesce("gold_answer", F.lit("")) != "") & F.col("abstained")).select("query_id", F.lit(0.0).alias("correctness"))
    held = graded(x.where("not abstained"), F.concat(F.lit("Is every claim of the answer supported by the sources?"), rate(GROUNDED), F.lit("Sources:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nAnswer: "), "answer"), GROUNDED, "groundedness")
    return x.select("query_id").join(right.union(silent), "query_id", "left").join(held, "query_id", "left")


def full_report(cases: DataFrame, answers: DataFrame, results: DataFrame, gold: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Long values (query_id, metric, value) of everything that can be measured, error_rate included. cases:
    (query_id, answerable); answers may have a column error; results: (query_id, id, rank, source, section, text)."""
    links = gold_links(results, gold)
    asked = cases.select("query_id", "answerable").join(gold.select("query_id").distinct().withColumn("has_gold", F.lit(True)), "query_id", "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))
    ok = answers.where("error is null") if "error" in answers.columns else answers
    open_ = asked.where("answerable and has_gold").select("query_id").join(ok.select("query_id"), "query_id")
    parts = [
        melt(metrics_by_place(links, gold).join(open_, "query_id"), "hit", "recall", "mrr"),
        melt(citation_metrics(ok, results, links, asked), "citation_valid_rate", "citation_source_match"),
        melt(abstention_metrics(ok, cases), "abstain_correct", "answerable_abstain_rate", "unanswerable_abstain_rate"),
    ]
    failed = answers.select("query_id", F.lit("error_rate").alias("metric"), (F.col("error").isNotNull() if "error" in answers.columns else F.lit(False)).cast("double").alias("value"))
    parts.append(failed)
    if judged is not None:
        parts.append(melt(judged, "correctness", "groundedness"))
    return union_all(parts)


def worst(values: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, mean): the n cases with the lowest mean of their metrics (those where lower is better reversed)."""
    v = F.when(F.col("metric").isin(*LOWER_IS_BETTER), 1 - F.col("value")).otherwise(F.col("value"))
    return values.groupBy("query_id").agg(F.round(F.avg(v), 6).alias("mean")).orderBy("mean", "query_id").limit(n)


def ablation_by_tag(values: DataFrame, cases: DataFrame, metric: str, variants: Sequence[str]) -> DataFrame:
    """A row for each tag, a column for each variant's mean of one metric. values: (query_id, variant, metric, value)."""
    tagged = values.where(F.col("metric") == metric).join(cases.select("query_id", F.explode("tags").alias("tag")), "query_id")
    return tagged.groupBy("tag").pivot("variant", list(variants)).agg(F.round(F.avg("value"), 6))


def ablate(variants: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(values (variant, query_id, metric, value) of all variants that can be made, why the others can't). Each is
    a function that returns long values, and is written before the next is asked."""
    parts, broken = [], {}
    for name, make in variants.items():
        try:
            parts.append(scratch(make().select(F.lit(name).alias("variant"), "query_id", "metric", "value"), "variant"))
        except Exception as e:  # a variant that can't run mustn't take the others with it
            broken[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return (union_all(parts) if parts else None), broken


def run_resumed(cases: DataFrame, checkpoint: str, answer_batch: Callable[[DataFrame], DataFrame], batches: int = 8) -> DataFrame:
    """All answers to cases (query_id, question), a share of them at a time, each written below checkpoint before
    the next begins; what a former run has answered without an error is kept. answer_batch adds columns, error
    among them."""
    spark = cases.sparkSession
    for n in range(batches):
        part = cases.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == n)
        if exists(spark, checkpoint):
            done = spark.read.parquet(checkpoint).where(F.col("error").isNull()).select("query_id", "question")
            part = part.join(done, ["query_id", "question"], "left_anti")
        answer_batch(part).write.mode("append").parquet(checkpoint)
    kept = spark.read.parquet(checkpoint).join(cases.select("query_id", "question"), ["query_id", "question"], "left_semi")
    latest = kept.groupBy("query_id").agg(F.max_by(F.struct(*kept.columns), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("x"))
    return latest.select("x.*")


def render(title: str, summary: DataFrame, outcomes: DataFrame | None = None, gates: DataFrame | None = None, form: str = "markdown") -> str:
    """A report of small tables (a row for each metric, outcome or threshold), as Markdown, text or JSON."""
    parts = {"metrics": summary, "outcomes": outcomes, "thresholds": gates}
    held = {k: (x.columns, [list(r) for r in x.orderBy(x.columns[0]).collect()]) for k, x in parts.items() if x is not None}
    if form == "json":
        return json.dumps({"title": title, **{k: [dict(zip(c, r)) for r in rows] for k, (c, rows) in held.items()}}, default=str, ensure_ascii=False)
    out = [f"# {title}" if form == "markdown" else title]
    for name, (columns, rows) in held.items():
        cells = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in rows]
        if form == "markdown":
            out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(c) + " |" for c in cells]]
        else:
            wide = [max(map(len, col)) for col in zip(columns, *cells)]
            out += ["", name, *["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [columns, *cells]]]
    return "\n".join(out)
