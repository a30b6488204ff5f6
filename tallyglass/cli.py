"""Command line: scan a folder, print what was found, and write reports."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from .plans.engine import VERSION, Estate, scan
from .sinks import console, json_file, markdown
from .sinks.commit import CommitError, commit_all
from .sinks.render import view
from .sources.guarded import is_below

FOUND, FAILED, STOPPED = 1, 2, 130


def confidence(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1 is expected")
    return value


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallyglass", description="Audits semantic models: duplicate, near-duplicate and unused measures.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    s = commands.add_parser("scan", help="scan a folder of projects")
    s.add_argument("path")
    s.add_argument("--json", metavar="FILE")
    s.add_argument("--markdown", metavar="FILE")
    s.add_argument("--quiet", action="store_true", help="print nothing")
    s.add_argument("--min-confidence", type=confidence, default=0.0, metavar="N")
    s.add_argument("--fail-on-findings", action="store_true", help=f"exit with {FOUND} if there are findings of high severity")
    s.add_argument("--no-color", action="store_true")
    s.add_argument("--force", action="store_true", help="overwrite existing outputs")
    return parser


def refusals(outputs: list[str], estate: Estate, force: bool) -> list[str]:
    """Why outputs may not be written: nothing that was scanned, or lies in a scanned project part, is ever overwritten."""
    sources = estate.health.protected | set(estate.health.read)
    folders = {os.path.realpath(r.p) for r in estate.assets.selectExpr("source_path as p").distinct().collect()}
    for r in estate.metrics.selectExpr("source_path as p").where("p is not null").distinct().collect():
        folders.add(os.path.realpath(os.path.dirname(r.p)))
    out, seen = [], set()
    for given in outputs:
        path = os.path.realpath(given)
        if path in seen:
            out.append(f"{given}: two outputs have this destination")
        elif path in sources or any(is_below(path, f) for f in folders):
            out.append(f"{given}: this belongs to what was scanned")
        elif os.path.isdir(path):
            out.append(f"{given}: this is a folder")
        elif not os.path.isdir(os.path.dirname(path)):
            out.append(f"{given}: its folder isn't there")
        elif os.path.exists(path) and not force:
            out.append(f"{given}: this exists (--force overwrites it)")
        seen.add(path)
    return out


def _scan(args: argparse.Namespace) -> int:
    if not os.path.isdir(args.path):
        print(f"{args.path}: no such folder", file=sys.stderr)
        return FAILED
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tallyglass").getOrCreate()
    whole = scan(spark, args.path)
    estate, dropped = whole.at_least(args.min_confidence)
    wanted = [(p, r) for p, r in ((args.json, json_file.pieces), (args.markdown, markdown.render)) if p]
    problems = refusals([p for p, _ in wanted], whole, args.force) if wanted else []
    shown = None if args.quiet and not args.markdown else view(estate)  # JSON alone goes to its file piece by piece
    if wanted and not problems:
        try:
            commit_all([(p, render(shown or estate)) for p, render in wanted])
        except CommitError as e:
            problems = [str(e), *(f"{p}: {s}" for p, s in e.states.items()), *(f"copy of {p}: {c}" for p, c in e.recovery.items()), *([f"index of the copies: {e.index}"] if e.index else [])]
    if not args.quiet:
        print(console.render(shown, color=not args.no_color and console.colour_enabled()), end="")
        if dropped:
            print(f"{dropped} findings below {args.min_confidence:g} are not shown.")
    if problems:
        print("\n".join(problems), file=sys.stderr)
        return FAILED
    return FOUND if args.fail_on_findings and not estate.findings.where("severity = 'high'").isEmpty() else 0


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    try:
        return _scan(args)
    except KeyboardInterrupt:
        return STOPPED


if __name__ == "__main__":
    sys.exit(main())
