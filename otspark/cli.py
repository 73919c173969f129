"""Command line: analyse captures, build a baseline, check rule files.

    python -m otspark.cli analyse a.pcap -o results
    python -m otspark.cli baseline a.pcap -o results [--before packets.parquet]
    python -m otspark.cli rules folder

Exit codes: 0 done, 1 settings or input that cannot be used, 2 rule files with errors.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from otspark import analysis, config
from otspark.errors import AnalysisError
from otspark.operators import compare, rules
from otspark.sinks import files
from otspark.sources import capture

log = logging.getLogger("otspark")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="otspark", description="Offline analysis of captures of industrial networks.")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="report on captures")
    a.add_argument("inputs", nargs="+")
    a.add_argument("-o", "--output", default="results")
    a.add_argument("--mode", default="full")
    a.add_argument("--min-severity", default="INFO")
    a.add_argument("--protocols", help="comma-separated; none: all")
    a.add_argument("--formats", help="comma-separated, or all")
    a.add_argument("--rules", help="folder of YAML files with further rules")
    a.add_argument("--compare", help="report of an earlier run")
    a.add_argument("--subset", help="capture file of the packets that events point at")
    for name in ("packets", "flows", "matrix", "edges"):
        a.add_argument(f"--most-{name}", type=int, default=0)
    a.add_argument("--anonymise", action="store_true")
    a.add_argument("--mask", action="store_true")
    a.add_argument("--no-graph", action="store_true")
    b = sub.add_parser("baseline", help="behaviour of a capture, and how it differs from an earlier one")
    b.add_argument("inputs", nargs="+")
    b.add_argument("-o", "--output", default="baseline")
    b.add_argument("--before", help="packets of an earlier run (Parquet)")
    r = sub.add_parser("rules", help="check rule files")
    r.add_argument("folder")
    return p


def settings_of(args: argparse.Namespace) -> config.Settings:
    return config.Settings(
        inputs=tuple(args.inputs), output=args.output, mode=args.mode.strip().lower().replace("_", "-"), protocols=config.protocols_of(args.protocols), formats=config.formats_of(args.formats), min_severity=args.min_severity.strip().upper(), rules=args.rules,
        compare=args.compare, subset=args.subset, most_packets=args.most_packets, most_flows=args.most_flows, most_matrix=args.most_matrix, most_edges=args.most_edges, anonymise=args.anonymise, mask=args.mask, graph=not args.no_graph,
    )


def check_rules(spark: SparkSession, folder: str) -> list[str]:
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.y*ml").collect()
    return [e for r in rows for e in rules.load(r.value).errors] + ([] if rows else ["no rule files"])


def baseline(spark: SparkSession, inputs: list[str], output: str, before: str | None) -> dict[str, str]:
    packets = capture.packets(capture.records(spark, inputs))
    packets.write.mode("overwrite").parquet(f"{output}/packets.parquet")
    packets = spark.read.parquet(f"{output}/packets.parquet")
    out = analysis.write_baseline(spark, packets, output)
    if before:
        then, now = compare.snapshot(spark.read.parquet(before)), compare.snapshot(packets)
        told = {"new_devices": files.rows_of(compare.new_hosts(then, now)), "new_communication_pairs": files.rows_of(compare.new_pairs(then, now)), "traffic": files.rows_of(compare.traffic(then, now))[0], "modbus_writes": files.rows_of(compare.writes(then, now))[0]}
        out["comparison"] = f"{output}/comparison.json"
        files.write_json(spark, told, out["comparison"])
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("otspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "rules":
            wrong = check_rules(spark, args.folder)
            print("\n".join(wrong) or "rules are fine")
            return 2 if wrong else 0
        if args.command == "baseline":
            done = baseline(spark, args.inputs, args.output, args.before)
        else:
            done = analysis.export(analysis.analyse(spark, settings_of(args)))
        for what, where in done.items():
            log.info("%s: %s", what, where)
        return 0
    except AnalysisError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
