"""python -m chronolore COMMAND: load, ask, search, trace, owners, paths, evaluate, score, export and doctor over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chronolore.functions.text import parse_grants
from chronolore.operators import export, models, stats
from chronolore.plans import ask, evaluate, load
from chronolore.sources import runs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronolore", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, words: bool = False) -> None:
        p = commands.add_parser(name)
        p.add_argument("--graph", required=True)
        for f in flags:
            p.add_argument(f)
        if words:
            p.add_argument("words", nargs="+")

    add("load", "--corpus", "--runs")
    for name in ("ask", "search"):
        add(name, "--grants", "--as-of", "--limit", words=True)
    add("trace", "--grants", "--fact-id", "--query")
    add("owners", "--grants", words=True)
    add("paths", "--grants", "--from", "--to", "--max-hops")
    add("evaluate", "--questions")
    add("score", "--runs", "--facts")
    add("export", "--to")
    add("doctor")
    return top


def main(argv: list[str] | None = None) -> int:
    """The exit code: 0, 1 for a failed evaluation or an unhealthy table, 2 for a refused answer."""
    args = vars(parser().parse_args(argv))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    reader = ask.Reader("command line", parse_grants(args.get("grants")))
    if args["command"] == "load":
        found, people = load.read_corpus(spark, args["corpus"])
        newest = args["runs"] and runs.newest_run(spark, args["runs"])
        extracted = runs.accepted(runs.read_run(spark, newest)) if newest else load.accept(models.marker_extractor(found.utterances), found.utterances)[0]
        load.write(load.build(found, people, extracted), args["graph"])
        stats.load_report(load.read(spark, args["graph"])).show(truncate=False)
        return 0
    t, words = load.read(spark, args["graph"]), " ".join(args.get("words") or [])
    tools = {
        "search": lambda: ask.search_knowledge(t, reader, {"query": words, "as_of": args["as_of"], "limit": args["limit"]}),
        "trace": lambda: ask.trace_decision(t, reader, {"query": args["query"], "fact_id": args["fact_id"]}),
        "owners": lambda: ask.find_owner(t, reader, {"query": words}),
        "paths": lambda: ask.path_between(t, reader, {"from": args["from"], "to": args["to"], "max_hops": args["max_hops"]}),
    }
    if args["command"] in tools:
        print(tools[args["command"]]())
        return 0
    if args["command"] == "ask":
        got = ask.ask(t, words, reader, args["as_of"], limit=int(args["limit"] or 8)).first()
        print(got["answer"])
        return 2 if got["refused"] else 0
    if args["command"] == "evaluate":
        graded = evaluate.grade_questions(t, runs.gold_questions(spark, args["questions"]))
        graded.show(truncate=False)
        return evaluate.exit_code(graded)
    if args["command"] == "score":
        scored = evaluate.score_run(runs.read_run(spark, runs.newest_run(spark, args["runs"])), runs.gold_facts(spark, args["facts"]))
        scored["by_type"].show()
        scored["total"].show()
        return 0
    if args["command"] == "export":
        notes = export.notes(t)
        export.write_notes(notes.unionByName(export.index(t, notes, "Index")), args["to"])
        return 0
    report = load.doctor(t)
    report.show(truncate=False)
    return int(not report.where("NOT healthy").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
