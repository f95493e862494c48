"""Command lines: python -m quillon.plans.cli sync|refresh|gate|audit|prune --db ROOT ..."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.client import POLL_ATTEMPTS, POLL_SECONDS, SYNC_PAGES, Client, UrlTransport
from ..sources.registry import SOURCES, required_for_models, select
from ..sources.snapshots import SnapshotStore
from .audit import audit, audit_catalog, audit_duplicates, prune
from .gate import run_gate
from .sync import Sync


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("sync", "refresh", "gate"):
        c = sub.add_parser(name)
        c.add_argument("--tables", nargs="+", choices=list(SOURCES))
        c.add_argument("--check-only", action="store_true")
        c.add_argument("--download-dir", type=Path)
        c.add_argument("--keep-downloads", action="store_true")
        c.add_argument("--bulk-poll-seconds", type=float, default=POLL_SECONDS)
        c.add_argument("--bulk-max-attempts", type=int, default=POLL_ATTEMPTS)
        if name != "refresh":
            c.add_argument("--page-safety-limit", type=int, default=SYNC_PAGES)
        else:
            c.add_argument("--skip-calendar", action="store_true")
        if name != "gate":
            c.add_argument("--force", action="store_true")
        else:
            c.add_argument("--max-staleness-days", type=int, default=0)
            c.add_argument("--reference-policy", choices=("refresh", "report"), default="refresh")
    sub.add_parser("audit")
    prune_ = sub.add_parser("prune")
    prune_.add_argument("--dry-run", action="store_true")
    prune_.add_argument("--protect", nargs="*", default=[], metavar="NAME", help="names of stores that are never pruned, besides those in QUILLON_PROTECTED")
    for c in sub.choices.values():
        c.add_argument("--db", required=True)
    return p


def main(argv: list[str] | None = None, transport=None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "gate" and args.max_staleness_days < 0:
        parser.error("--max-staleness-days must be 0 or more")
    if args.command in ("sync", "refresh", "gate") and not os.environ.get("QUILLON_API_KEY"):
        print("QUILLON_API_KEY is not set", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    store = SnapshotStore(spark, args.db, read_only=args.command == "audit")
    if args.command == "audit":
        audit(store).show(100, truncate=False)
        for t, n in audit_duplicates(store).items():
            print(f"{t} duplicate keys: {n}")
        for t, c, kind in audit_catalog(store):
            print(t, c, kind)
        return 0
    if args.command == "prune":
        names = prune(store, args.dry_run, (*args.protect, *os.environ.get("QUILLON_PROTECTED", "").split()))
        print(f"Objects to drop: {len(names)}", *names, sep="\n")
        return 0
    client = Client(os.environ.get("QUILLON_API_URL", ""), os.environ["QUILLON_API_KEY"], transport or UrlTransport(), getattr(args, "page_safety_limit", SYNC_PAGES), args.bulk_poll_seconds, args.bulk_max_attempts)
    run = Sync(spark, store, client, args.check_only, getattr(args, "force", False), args.command == "refresh", args.download_dir, args.keep_downloads)
    if args.command == "gate":
        out = run_gate(run, args.tables or required_for_models(), args.max_staleness_days, args.reference_policy)
        print("PASSED" if out["passed"] else "BLOCKED", *out["blockers"], sep="\n")
        return int(not out["passed"])
    results, calendar, code = run.run(select(args.tables, args.check_only, run.refresh), getattr(args, "skip_calendar", False))
    for r in results:
        print(f"{r.table}: {r.status} (rows {r.rows_added:+d}, max {r.local_max})")
    if calendar:
        print(f"{calendar['table']}: {calendar['status']}")
    return code


if __name__ == "__main__":
    sys.exit(main())
