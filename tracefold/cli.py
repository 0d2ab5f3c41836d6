"""Command line: ``build`` a snapshot or ``evaluate`` one from files of JSON lines."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from .plans.evaluation import evaluate
from .plans.snapshot import Request, build
from .session import session
from .sources.jsonl import file_bytes, read_lines

#: Seconds that the files' windows are taken for when there is a baseline.
WINDOW = 3600


def run(argv: Sequence[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tracefold")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "evaluate"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--scope", required=True)
        c.add_argument("--budget", type=int, default=2_000)
        if name == "evaluate":
            c.add_argument("--baseline-input")
            c.add_argument("--label", default="incident-evaluation")
            c.add_argument("--json-only", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or session()
    request = Request(args.scope, args.budget, read_lines(spark, args.input))
    if args.command == "build":
        print(build(request).to_json())
        return 0
    before = None
    if args.baseline_input:
        request.baseline, before = read_lines(spark, args.baseline_input), file_bytes(spark, args.baseline_input)
        request.incident_seconds = request.baseline_seconds = WINDOW
    report = evaluate(request, args.label, file_bytes(spark, args.input), before)
    print(json.dumps(report, indent=2, sort_keys=True))
    if not args.json_only:
        print("\n" + report["humanReport"])
    return 0


def main() -> None:
    raise SystemExit(run())


if __name__ == "__main__":
    main()
