"""Command line: ``python -m echofold detect DIR`` and ``python -m echofold apply [REPORT]``."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys

from pyspark.sql import SparkSession

from echofold.operators.shared import clean, cut
from echofold.plans.pipeline import find_duplicates
from echofold.schema import MIN_SIZE_KB
from echofold.sources import files as src
from echofold.sources import report
from echofold.sources.store import SnapshotStore


def session(workers: int | None) -> SparkSession:
    builder = SparkSession.builder.appName("echofold").config("spark.ui.showConsoleProgress", "false")
    return (builder if "SPARK_MASTER" in os.environ else builder.master(f"local[{workers or '*'}]")).getOrCreate()


def detect(spark: SparkSession, directory: str, store: SnapshotStore, reader: src.TagReader, backend: src.Backend, min_size: int = 0, force_refresh: bool = False, say=lambda text: None):  # noqa: ANN001, ANN201
    """(number of files, result of the detection, rows of warnings); new fingerprints are stored.

    Every file is listed, read and fingerprinted once: what later steps
    read are written tables.  ``say`` gets lines on the progress.
    """
    found = cut(src.scan(spark, directory, reader, min_size))
    n = found.count()
    say(f"Found {n} audio files  (cache: {store.root}, {len(store)} entries)")
    split = src.progress(src.split_fresh(found, store.read(), force_refresh)).first()
    say(f"  {split['cached']} already cached, {split['to_compute']} to fingerprint")
    files, new, warnings = src.ensure_fingerprints(found, store.read(), backend, force_refresh, src.unreachable)
    items, new, warnings = cut(files.drop("mtime")), cut(new), cut(warnings)
    if not new.isEmpty():
        store.write(new)
    say(f"  {new.count()} computed")
    result = find_duplicates(items, cache=store.read())
    say(f"  Done: {result.edges.count()} matches")
    return n, result, warnings


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="echofold")
    sub = top.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect", help="find near-duplicate audio files")
    d.add_argument("directory")
    d.add_argument("--min-size", type=int, default=MIN_SIZE_KB, metavar="KB")
    d.add_argument("--json", nargs="?", const=True, default=False, metavar="PATH", help="JSON to standard output, or to a file with --json=PATH")
    d.add_argument("--cache", metavar="FOLDER", help="fingerprint store; by default beside the directory")
    d.add_argument("--workers", type=int, metavar="N")
    d.add_argument("--force-refresh", action="store_true", help="compute every fingerprint again")
    a = sub.add_parser("apply", help="replace duplicates by hard links to the file to keep; a dry run by default")
    a.add_argument("input", nargs="?", default="-")
    a.add_argument("--apply", action="store_true")
    a.add_argument("--backup-suffix", default=".bak", metavar="SUFFIX")
    args = top.parse_args(argv)
    return run_detect(args) if args.command == "detect" else run_apply(args)


def run_detect(args: argparse.Namespace) -> int:
    directory = os.path.abspath(args.directory)
    if not os.path.isdir(directory):
        print(f"Error: {directory} is not a directory", file=sys.stderr)
        return 1
    if importlib.util.find_spec("mutagen") is None:
        print("Error: reading tags needs the mutagen library", file=sys.stderr)
        return 1
    spark = session(args.workers)
    store = SnapshotStore(spark, args.cache or os.path.join(os.path.dirname(directory), ".echofold-store"))
    say = (lambda text: None) if args.json is True else (lambda text: print(text, flush=True))
    say(f"Scanning {directory} ...")
    try:
        n, result, warnings = detect(spark, directory, store, src.mutagen_reader, src.first_of([src.library_backend, src.fpcalc_backend]), args.min_size * 1024, args.force_refresh, say)
        if args.json is False:
            print(report.text_report(n, report.report_rows(result.groups, result.members), result.members, warnings))
            return 0
        text = report.pretty_json(report.json_rows(result.groups, result.members))
    finally:
        clean(spark)
    if args.json is True:
        sys.stdout.buffer.write(text.encode() + b"\n")
    else:
        with open(args.json, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return 0


def run_apply(args: argparse.Namespace) -> int:
    """Files are renamed and linked where the command runs, so the report is read here too; what to do with it is a plan like any other."""
    spark = session(None)
    try:
        groups = report.parse_json(sys.stdin.read() if args.input == "-" else open(args.input, encoding="utf-8").read())
    except (OSError, ValueError) as e:
        print(f"Error: invalid JSON input: {e}", file=sys.stderr)
        return 1
    rows = spark.createDataFrame(groups, report.REPORT)
    there = {path for g in groups for path in (*(g["files"] or ()), g["keep"]) if path and os.path.exists(path)}
    plan = report.apply_plan(rows, spark.createDataFrame([(path,) for path in sorted(there)], "path string"))
    if not args.apply:
        print("Dry run; --apply renames and links.")
    done = report.apply_on_driver(plan, args.backup_suffix, args.apply)
    for path, status, why in done:
        print(f"[{status}] {path}" + (f": {why}" if why else ""))
    counts = {r["status"]: r["n"] for r in report.apply_counts(spark.createDataFrame(done, "path string, status string, reason string")).collect()}
    print(f"{counts.get('done', 0)} {'were' if args.apply else 'would be'} replaced, {counts.get('skip', 0)} skipped, {counts.get('fail', 0)} failed")
    return 1 if counts.get("fail") else 0
