"""Batch check of two snapshots, for schedulers and pipelines.

    spark-submit run_check.py check before.parquet after.parquet \\
        --metric revenue --segment region --fail-on-significant

Exit status: 0 done, 1 input or computation failed, 2 a significant change was
found and ``--fail-on-significant`` was given.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from tabscope.operators import drift
from tabscope.plans.reports import drift_highlights, drift_report, has_significant_change
from tabscope.session import tune
from tabscope.sources import load, write_report

EXIT_OK, EXIT_ERROR, EXIT_SIGNIFICANT = 0, 1, 2


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="run_check", description="What changed between two snapshots, and is it real?")
    check = parser.add_subparsers(dest="command", required=True).add_parser("check", help="compare two snapshots")
    check.add_argument("before", help="earlier snapshot: csv, json or parquet")
    check.add_argument("after", help="later snapshot")
    check.add_argument("--metric", help="number column to explain; chosen if left out")
    check.add_argument("--segment", help="category column to break the change down by; chosen if left out")
    check.add_argument("--agg", choices=["sum", "mean"], default="sum", help="how the metric is aggregated")
    check.add_argument("--format", choices=["text", "json"], default="text", help="what to print")
    check.add_argument("--out", help="folder to write all report tables to, as JSON rows")
    check.add_argument("--schema", help="column types of both snapshots, as in CREATE TABLE; spares text formats a pass")
    check.add_argument("--multi-line", action="store_true", help="cells or records of text formats may span lines; reads each file in one task")
    check.add_argument("--fail-on-significant", action="store_true", help="exit with 2 on a significant change")
    return parser


def _print_json(head: dict, tables: dict[str, DataFrame]) -> None:
    """One JSON object with every row of every table; rows come to the driver partition by partition."""
    print("{" + ", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in head.items()), end="")
    for name, table in tables.items():
        print(f",\n {json.dumps(name)}: [", end="")
        for i, row in enumerate(table.toLocalIterator()):
            print(",\n  " if i else "\n  ", json.dumps(row.asDict(recursive=True), default=str), sep="", end="")
        print("]", end="")
    print("\n}")


def run_check(spark: SparkSession, args: argparse.Namespace) -> int:
    tune(spark)
    try:
        pair = drift.pair_of(*(load(spark, path, args.schema, args.multi_line or None) for path in (args.before, args.after)))
    except Exception as error:  # noqa: BLE001 - any unreadable input ends the job the same way
        print(f"cannot read the input: {error}", file=sys.stderr)
        return EXIT_ERROR
    # Every table of the report reads the snapshots again. Parquet serves each just its
    # columns; text formats would be parsed anew each time and are kept once parsed.
    rows = pair.rows
    if not all(path.rstrip("/").endswith("parquet") for path in (args.before, args.after)):
        rows = rows.persist()
        pair = drift.Pair(rows, pair.schema_before, pair.schema_after)
    try:
        metric = args.metric or drift.suggest_metric_column(pair)
        segment = args.segment or drift.suggest_segment_column(pair)
        report = drift_report(pair, metric, segment, args.agg)
        if args.out:
            write_report(report, args.out)
        if args.format == "json":
            _print_json({"metric": metric, "segment": segment}, report)
        else:
            for r in drift_highlights(report).collect():
                numbers = [f"{x:,.2f}" for x in (r["before"], r["after"]) if x is not None]
                change = "" if r["change"] is None else f" ({r['change']:+.2f})"
                print(f"{r['kind']}: {r['subject']} {r['detail'] or ''} {' -> '.join(numbers)}{change}".rstrip())
        significant = args.fail_on_significant and has_significant_change(report).first()[0]
    except Exception as error:  # noqa: BLE001
        print(f"cannot compute the report: {error}", file=sys.stderr)
        return EXIT_ERROR
    finally:
        rows.unpersist()
    return EXIT_SIGNIFICANT if significant else EXIT_OK


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tabscope check").getOrCreate()
    return run_check(spark, args)


if __name__ == "__main__":
    sys.exit(main())
