"""Command line: start a run, observe its status, read a retained result.

    python -m tidemark.cli start LEDGER TABLES [--environment main]
    python -m tidemark.cli observe LEDGER
    python -m tidemark.cli read-result LEDGER RESULT_ID [--limit 20]
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    start = verbs.add_parser("start")
    start.add_argument("ledger")
    start.add_argument("tables")
    start.add_argument("--environment", default="main")
    verbs.add_parser("observe").add_argument("ledger")
    read = verbs.add_parser("read-result")
    read.add_argument("ledger")
    read.add_argument("result_id")
    read.add_argument("--limit", type=int, default=20)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import report
    from .plans.ledger import Ledger
    from .plans.workspace import Workspace
    from .streaming.traversal import Observation

    spark = SparkSession.builder.getOrCreate()
    say = lambda **x: print(json.dumps(x, default=str), flush=True)
    if args.verb == "start":
        fold = report.contribution(report.read(spark, args.tables, "customer"), report.read(spark, args.tables, "orders"))
        work = Workspace(spark, args.ledger, "contribution", fold)
        seen = Observation(work.ledger.files)
        say(locator=[args.ledger, "contribution", args.environment])
        seen.write(phase="running")
        with work.run(args.environment) as run:
            out = run.resolve(fold)
        seen.write(phase=out.state, bodies=run.bodies, counts=out.counts)
        say(terminal=out.state, bodies=run.bodies)
        return 0 if out.data is not None else 1
    ledger = Ledger(spark, args.ledger)
    if args.verb == "observe":
        got = Observation(ledger.files).read()
        say(**(got or {"phase": "unknown"}))
        return 0 if got else 1
    row = ledger.table("results").filter(F.col("result_id") == args.result_id).first()
    if row is None:
        say(error="absent")
        return 1
    for r in spark.read.parquet(f"{ledger.root}/{row['path']}").limit(args.limit).collect():
        say(**r.asDict(True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
