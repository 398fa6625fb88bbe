"""Command line over stored tables and reports.

    python -m folioscope extract LAYOUT --output OUT [--backend tables|elements] [--numeric-primary] [--header-pattern P] [--footer-pattern P]
    python -m folioscope diff LAYOUT_A LAYOUT_B --output OUT [--dump-intermediate]
    python -m folioscope classify REPORT --output OUT [--hook MODULE:FUNCTION] [--model NAME] [--answers TABLE] [--events]
    python -m folioscope export REPORT [--csv OUT] [--excel OUT]
    python -m folioscope import-labels REPORT CLASSIFIED --log LOG [--source NAME]

LAYOUT is a folder of Parquet tables (spans and pages, or elements); REPORT a JSON file, or a folder of
files with a report a line, as ``diff`` writes them (OUT/reports).  ``classify`` writes classified reports to
OUT/reports, a line a pair, and ``import-labels`` takes them for all pairs.  A hook is a function of
``classify.modelled``; with a table of answers a later run asks only for what is missing.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.config import LayoutConfig
from folioscope.operators import classify, diffing, layout, report
from folioscope.plans import compare
from folioscope.shipping import ship
from folioscope.sources import readers, sheets, writers
from folioscope.storage import release, written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    sub = p.add_subparsers(dest="command", required=True)
    for name, inputs in (("extract", ["layout"]), ("diff", ["layout_a", "layout_b"])):
        s = sub.add_parser(name)
        for i in inputs:
            s.add_argument(i)
        s.add_argument("--output", required=True)
        s.add_argument("--backend", default="tables")
        s.add_argument("--numeric-primary", action="store_true")
        s.add_argument("--header-pattern", action="append", default=[])
        s.add_argument("--footer-pattern", action="append", default=[])
        s.add_argument("--dump-intermediate", action="store_true")
    s = sub.add_parser("classify")
    s.add_argument("report")
    s.add_argument("--output", required=True)
    s.add_argument("--hook")
    s.add_argument("--model", default="hook")
    s.add_argument("--answers")
    s.add_argument("--events", action="store_true")
    s = sub.add_parser("export")
    s.add_argument("report")
    s.add_argument("--csv")
    s.add_argument("--excel")
    s = sub.add_parser("import-labels")
    s.add_argument("report")
    s.add_argument("classified")
    s.add_argument("--log", required=True)
    s.add_argument("--source", default="classified_import")
    return p


def config(args) -> LayoutConfig:
    return LayoutConfig(numeric_is_primary=args.numeric_primary, header_patterns=tuple(args.header_pattern), footer_patterns=tuple(args.footer_pattern))


def hook_of(name: str | None):
    """The function that ``MODULE:FUNCTION`` names; its module is sent to the workers."""
    if not name:
        return None
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def export_of(spark: SparkSession, path: str):
    return report.export_rows(readers.reports(spark, path).withColumnsRenamed({"match_score": "score", "page_no_in_a": "start_page_a", "page_no_in_b": "start_page_b"}))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "export" and not (args.csv or args.excel):
        raise SystemExit("export needs --csv or --excel")
    spark = spark or SparkSession.builder.appName("folioscope").getOrCreate()
    ship(spark)
    if args.command == "extract":
        lines, pages = readers.extract(spark, args.layout, args.backend)
        compare.sections_of(lines, pages, config(args)).write.mode("overwrite").json(f"{args.output}/sections")
        if args.dump_intermediate:
            cleaned = layout.clean_lines(lines, pages, config(args))
            cleaned.filter("reason is not null").write.mode("overwrite").json(f"{args.output}/removed_lines")
            layout.extraction_summary(cleaned, pages).write.mode("overwrite").json(f"{args.output}/debug")
    elif args.command == "diff":
        sides = [x for path in (args.layout_a, args.layout_b) for x in readers.extract(spark, path, args.backend)]
        found = compare.compare(*sides, config(args))
        diffs = written(found["diffs"], "diffs")
        writers.write_json(diffs, diffing.summary(diffs, found["pairs"]), f"{args.output}/reports")
        if args.dump_intermediate:
            found["matches"].write.mode("overwrite").json(f"{args.output}/matches")
            for s, (lines, pages) in zip("ab", (sides[:2], sides[2:]), strict=True):
                cleaned = layout.clean_lines(lines, pages, config(args))
                layout.extraction_summary(cleaned, pages).write.mode("overwrite").json(f"{args.output}/debug_{s}")
    elif args.command == "classify":
        sources = readers.report_sources(spark, args.report)
        listener = (lambda name, told: print(name, *(f"{k}={v}" for k, v in told.items()), flush=True)) if args.events else None
        rows = classify.classified(readers.reports(spark, args.report), hook_of(args.hook), model=args.model, store=args.answers, listener=listener)
        rows = written(rows, "classified")  # read three times; a model is asked once
        rows.write.mode("overwrite").json(f"{args.output}/classifications")
        classify.summary(rows, sources).write.mode("overwrite").json(f"{args.output}/summary")
        writers.write_classified(rows, f"{args.output}/reports", sources)
    elif args.command == "export":
        rows = export_of(spark, args.report)
        if args.csv:
            writers.write_csv(rows, args.csv)
        if args.excel:
            sheets.write_sheets(rows, args.excel)
    else:
        labels = readers.all_labels(spark, args.classified, readers.report_sources(spark, args.report))
        entries = report.imported(readers.reports(spark, args.report), labels, args.source)
        entries = written(entries.withColumn("updated_at", F.current_timestamp()), "entries")
        n = entries.count()
        if n:
            writers.append_log(entries, args.log)
        print(f"imported={n}")
    release(spark)


if __name__ == "__main__":
    main()
