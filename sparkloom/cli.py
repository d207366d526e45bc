"""python -m sparkloom.cli: presets, ingest, inspect, ask, serve, eval check, eval gen, eval run, eval ablate.
Ends with 0, with 1 where thresholds aren't met, 2 for what can't be used, 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .config import PRESETS, deep_merge, load_config, load_env
from .engine import Agent, KnowledgeBase
from .errors import SparkloomError
from .operators import evaluation, synth
from .sources.loaders import load_dataset


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("--env", help="a file of KEY=value lines to take into the environment")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("presets")
    for name in ("ingest", "inspect", "ask", "serve"):
        sub.add_parser(name).add_argument("config")
    sub.choices["ingest"].add_argument("--rebuild", action="store_true")
    sub.choices["ask"].add_argument("question")
    sub.choices["serve"].add_argument("--port", type=int, default=8080)
    tests = sub.add_parser("eval").add_subparsers(dest="action", required=True)
    for name in ("check", "gen", "run", "ablate"):
        tests.add_parser(name).add_argument("config")
    for name in ("check", "run", "ablate"):
        tests.choices[name].add_argument("dataset")
    tests.choices["gen"].add_argument("--out", required=True)
    tests.choices["gen"].add_argument("--answerable", type=int, default=10)
    tests.choices["gen"].add_argument("--followups", type=int, default=0)
    tests.choices["run"].add_argument("--limit", type=int)
    tests.choices["run"].add_argument("--format", choices=("markdown", "text", "json"), default="text")
    tests.choices["ablate"].add_argument("variants", help="a JSON file: name to settings that replace others")
    return p


def cases_of(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases with a numeric query_id, gold places) of a question set."""
    cases = dataset.withColumn("query_id", F.xxhash64("id") % F.lit(1 << 50)).withColumn("text", F.col("question"))
    gold = cases.select("query_id", F.posexplode("gold_sources").alias("gold_no", "g")).select("query_id", "gold_no", "g.source", "g.section", "g.quote")
    return cases, gold


def retrieval_values(kb: KnowledgeBase, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Long values of retrieval alone, of the cases that can be answered and have gold."""
    asked = cases.where("answerable").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    chunks = kb.chunks().select("id", F.col("rel").alias("source"), F.concat_ws(" ", "heading_path", "context").alias("section"), "text")
    found = kb.retrieve(asked.select("query_id", "text")).join(chunks, "id")
    return evaluation.melt(evaluation.metrics_by_place(evaluation.gold_links(found, gold), gold.join(asked.select("query_id"), "query_id", "left_semi")), "hit", "recall", "mrr")


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.env:
        load_env(args.env)
    if args.command == "presets":
        print(json.dumps(PRESETS, indent=2))
        return 0
    settings = load_config(args.config)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    kb = KnowledgeBase(spark, settings)
    if args.command == "ingest":
        states, warnings = kb.ingest(args.rebuild)
        print(json.dumps({r.state: r["count"] for r in states.groupBy("state").count().collect()}))
        for r in warnings.orderBy("path").limit(20).collect():
            print(f"{r.path}: {r.warning}", file=sys.stderr)
    elif args.command == "inspect":
        files, pieces = kb.analyze()
        flagged = files.where("size(flags) > 0")
        print(json.dumps({"documents": files.count(), "flagged": flagged.count(), "fragmented": pieces.where("fragmented").count()}))
        for r in flagged.orderBy("id").limit(50).collect():
            print(f"{r.id}: {', '.join(r.flags)}")
    elif args.command == "ask":
        print(json.dumps(Agent(kb).ask(args.question), ensure_ascii=False, default=str))
    elif args.command == "serve":
        from .server import serve

        serve(Agent(kb), args.port)
    elif args.action == "gen":
        chunks = kb.chunks().select("id", F.col("rel").alias("source"), "text")
        cases, report = synth.generate(chunks, Agent(kb).model, args.answerable, args.followups)
        cases.coalesce(1).write.mode("overwrite").json(args.out)
        print(json.dumps(report))
    else:
        dataset = load_dataset(spark, args.dataset)
        if args.action == "check":
            found = evaluation.dataset_warnings(dataset).first().asDict()
            print(json.dumps(found))
            return 0
        if getattr(args, "limit", None):
            dataset = dataset.orderBy("id").limit(args.limit)
        cases, gold = cases_of(dataset)
        if args.action == "run":
            summary = evaluation.summarize(retrieval_values(kb, cases, gold))
            gates = evaluation.gate(summary, settings["evaluation"]["thresholds"]) if settings["evaluation"]["thresholds"] else None
            print(evaluation.render(settings["name"], summary, gates=gates, form=args.format))
            return 0 if gates is None or gates.where("not passed").isEmpty() else 1
        with open(args.variants, encoding="utf-8") as f:
            variants = json.load(f)

        def of(name: str):
            def make() -> DataFrame:
                own = KnowledgeBase(spark, deep_merge(settings, variants[name]) | {"index": f"{settings['index']}-{name}"})
                own.ingest()
                return retrieval_values(own, cases, gold)

            return make

        values, broken = evaluation.ablate({name: of(name) for name in variants})
        if values is not None:
            means = values.groupBy("metric").pivot("variant", [v for v in variants if v not in broken]).agg(F.round(F.avg("value"), 4))
            print(evaluation.render("variants", means, form="text"))
        for name, why in broken.items():
            print(f"{name}: {why}", file=sys.stderr)
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        return run(parser().parse_args(argv), spark)
    except KeyboardInterrupt:
        return 130
    except (SparkloomError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
