"""``spark-submit docketspark/cli.py``: ask questions, ingest folders, list and run queries, report evaluations, check the tables' health.
``--json`` for machines."""

from __future__ import annotations

import argparse
import json
import sys

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketspark", description=__doc__)
    p.add_argument("--json", action="store_true", help="print JSON rows")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    for name, text in (("run", "run a query"), ("explain", "show a query's plan")):
        c = commands.add_parser(name, help=text)
        c.add_argument("query")
        c.add_argument("data")
        c.add_argument("--limit", type=int, default=20, help="rows to show")
        c.add_argument("--output", help="write the whole result as Parquet")
    c = commands.add_parser("validate", help="validation measures against their thresholds; exit 1 unless all blocking ones pass")
    c.add_argument("data")
    c.add_argument("--output", help="write the report as markdown")
    c = commands.add_parser("ask", help="answer a question from the documents: the best excerpts, and an answer that cites them; exit 1 without one")
    c.add_argument("data")
    c.add_argument("question")
    c.add_argument("--top", type=int, default=5, help="excerpts to answer from")
    c.add_argument("--index", help="folder in which the index stays")
    c = commands.add_parser("eval", help="suite measures by language and the pass rate of each confidence band")
    c.add_argument("data")
    c = commands.add_parser("ingest", help="store the files of a folder that are not stored yet, each content once")
    c.add_argument("folder")
    c.add_argument("into")
    c = commands.add_parser("health", help="state of tables, vectors and plug-ins; exit 1 unless a question can be answered")
    c.add_argument("data")
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import AnalysisException

    from docketspark import plans
    from docketspark.session import build_session, table

    args = parser().parse_args(argv)

    def show(rows: list[dict]) -> None:
        for r in rows:
            print(json.dumps(r, default=str) if args.json else "  ".join(f"{k}={v}" for k, v in r.items()))

    if args.command == "list":
        show([{"query": n, "about": (f.__doc__ or "").strip().split("\n")[0]} for n, f in sorted(plans.QUERIES.items())])
        return 0
    spark = build_session()
    if args.command == "health":
        from docketspark.functions import plugins
        from docketspark.operators import health

        components = health.check(spark, args.data, TABLES, embedder=plugins.hashing_embedder(), generator=plugins.extractive_generator())
        total = health.roll_up(components).first().asDict()
        show([*(r.asDict() for r in components.collect()), total])
        return 0 if total["can_answer"] else 1
    if args.command == "validate":
        from docketspark.operators.evaluation import milestone_passed, threshold_checks
        from docketspark.plans.answers import measures
        from docketspark.sources.files import markdown_report

        checks = threshold_checks(measures(spark, args.data)).cache()
        show([r.asDict() for r in checks.collect()])
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(markdown_report(checks, "Validation"))
        return 0 if milestone_passed(checks).first()[0] else 1
    if args.command == "ask":
        from docketspark.operators.answering import ask

        excerpts, answer = ask(spark, table(spark, args.data, "documents"), args.question, args.top, args.index)
        show([*(r.asDict() for r in excerpts.orderBy("rank").collect()), found := answer.first().asDict()])
        return 0 if found["outcome"] == "answered" else 1
    if args.command == "eval":
        from docketspark.operators import evaluation as E
        from docketspark.plans.answers import scored_cases

        scored = scored_cases(spark, args.data)
        show([r.asDict() for report in (E.suite_report(scored, ["lang"]), E.calibration(scored)) for r in report.collect()])
        return 0
    if args.command == "ingest":
        from docketspark.streaming.ingest import ingest, new_files

        ingest(new_files(spark, args.folder), f"{args.into}/known", f"{args.into}/checkpoint", lambda rows: rows.write.mode("append").parquet(f"{args.into}/files")).awaitTermination()
        show([{"stored": spark.read.parquet(f"{args.into}/files").count()}])
        return 0
    if args.query not in plans.QUERIES:
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    df = plans.QUERIES[args.query](spark, args.data)
    if args.command == "explain":
        df.explain("formatted")
    elif args.output:
        df.write.mode("overwrite").parquet(args.output)
    else:
        show([r.asDict(recursive=True) for r in df.limit(args.limit).collect()])
    return 0


if __name__ == "__main__":
    sys.exit(main())
