"""Command line: build a corpus and its graph from captured payloads, and ask, report and evaluate over them."""

from __future__ import annotations

import argparse
import os
import sys

from citemill.operators import evaluate, gaps, graph, metrics, traverse
from citemill.operators.routing import Settings
from citemill.plans import build as plan
from citemill.runtime import get_session, shared_dir
from citemill.sources import readers, store
from citemill.streaming import fold

QUESTIONS = ("how did the field evolve", "what are the open problems", "major methods", "compare the leading approaches")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citemill")
    p.add_argument("--out", default="data", help="the folder of a build")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "run"):
        one = sub.add_parser(name)
        one.add_argument("payloads", help="a folder of captured payloads, <source>/<number>.json or .xml")
        one.add_argument("--title", default="untitled")
        if name == "run":
            one.add_argument("--question", default=QUESTIONS[1])
    sub.add_parser("ask").add_argument("question")
    for name in ("stats", "report", "events", "doctor", "sources"):
        sub.add_parser(name)
    one = sub.add_parser("eval")
    one.add_argument("--reference", default="")
    one.add_argument("--write", default="")
    return p


def shown(lines) -> list[str]:
    return [r.line for r in lines.orderBy("section", "place").collect()]  # a report


def ask(parts: dict, question: str) -> list[str]:
    kind, nodes, edges = traverse.traverse(parts["nodes"], parts["edges"], question)
    return traverse.answer_prompt(question, shown(traverse.rendered(kind, question, nodes, edges))).split("\n")


def main(argv: list[str] | None = None, spark=None, say=print) -> int:
    args, settings = parser().parse_args(argv), Settings.from_env()
    if args.command == "sources":
        for s in settings.sources():
            say(f"{s}: {', '.join(k for n, k, *_ in readers.ENDPOINTS if n == s)}")
        return 0
    spark = spark or get_session("citemill", os.environ.get("CITEMILL_CPUS", "*"))
    if args.command == "doctor":
        say(f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} tasks at once, shared folder {shared_dir(spark)}")
        for stage in ("extraction", "answer"):
            say(f"{stage}: {', '.join(settings.candidates(stage))}")
        return 0
    if args.command in ("build", "run"):
        plan.build(spark, readers.captured(spark, args.payloads), args.title, args.out, settings)
    parts = plan.loaded(spark, args.out)
    lines: list[str] = []
    if args.command in ("build", "run", "events"):
        lines += [f"{r.phase}: {r.message}" for r in parts["events"].orderBy("seq").collect()]
        state = fold.run_states(parts["events"]).first()
        lines.append(fold.counter_line(state.counters, 80))
    if args.command == "stats":
        lines += [f"{r.kind} {r.type or 'all'}: {r.n}" for r in graph.graph_stats(parts["nodes"], parts["edges"]).orderBy("kind", "type").collect()]
        lines.append(", ".join(f"{k}: {v}" for k, v in metrics.corpus_stats(parts["papers"]).first().asDict().items()))
    if args.command == "ask":
        lines += ask(parts, args.question)
    if args.command == "run":
        lines += ask(parts, args.question)
    if args.command == "report":
        lines += shown(gaps.report_lines(gaps.gap_report(parts["extractions"], parts["papers"], parts["nodes"], parts["edges"])))
    if args.command == "eval":
        reference = store.load_reference_set(spark, args.reference) if args.reference else None
        found = evaluate.report_lines(evaluate.run_eval(parts["papers"], parts["extractions"], parts["nodes"], parts["edges"], list(QUESTIONS), reference))
        if args.write:
            store.save_lines(found, args.write)
        lines += shown(found)
    for line in lines:
        say(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
