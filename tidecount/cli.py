"""Command line. Counts and releases of an event file; or, with a ledger folder: ingest, release, flush-deletes, reset-budget, budget-report."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from .functions import pseudonym
from .functions.config import Config
from .operators import activity, turnstile, workloads
from .operators.ledger import Ledger
from .plans import release
from .sources import events, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidecount", description=__doc__)
    what = parser.add_subparsers(dest="what", required=True)
    exact = what.add_parser("exact", help="true rolling counts of an event file")
    exact.add_argument("path")
    exact.add_argument("--window", type=int, default=1)
    for name in ("dau", "mau", "budget"):
        sub = what.add_parser(name, help={"budget": "what releases of an event file's days would spend"}.get(name, "noisy counts within the month's budget"))
        sub.add_argument("path")
        sub.add_argument("--secret", help="else HASH_SALT_SECRET")
        sub.add_argument("--window", type=int)
    generate = what.add_parser("generate", help="a synthetic workload as JSON lines or CSV, by the path's ending")
    generate.add_argument("path")
    for name, default, kind in (("users", 100, int), ("days", 7, int), ("p-active", 0.2, float), ("delete-rate", 0.1, float), ("seed", 1, int)):
        generate.add_argument(f"--{name}", type=kind, default=default)
    what.add_parser("secret", help="a new salt secret; data under the old one can't be erased with it")
    rotate = what.add_parser("rotate-salt", help="settings with a new salt secret, under which stored data can still be erased")
    rotate.add_argument("--secret", help="the present one, else HASH_SALT_SECRET")
    parser.add_argument("--version", action="version", version="tidecount 0.2")
    for name, rest in (("ingest", ("path",)), ("release", ("metric", "day")), ("flush-deletes", ()), ("reset-budget", ("metric", "period")), ("budget-report", ())):
        sub = what.add_parser(name, help=f"{name} on a ledger")
        sub.add_argument("ledger")
        for argument in rest:
            sub.add_argument(argument)
        sub.add_argument("--secret", help="else HASH_SALT_SECRET")
        sub.add_argument("--window", type=int)
    return parser


def _config(args) -> Config:
    return Config.from_env(**({"hash_salt_secret": args.secret} if args.secret else {}))


def _on_ledger(args, ledger: Ledger, config: Config) -> int:
    if args.what == "ingest":
        ledger.record(events.read_events(ledger.spark, args.path), config)
    elif args.what == "release":
        try:
            print(json.dumps(release.release_stored(ledger, args.metric, dt.date.fromisoformat(args.day), config, args.window), default=str))
        except release.BudgetExceeded as e:
            print(json.dumps({"error": str(e), "next_reset": str(e.next_reset)}))
            return 3
    elif args.what == "flush-deletes":
        days = ledger.replay()
        ledger.refresh(days)
        print(json.dumps({"days": [str(d) for d in days]}))
    elif args.what == "reset-budget":
        ledger.reset(release.metric_name(args.metric), args.period)
    else:
        print(release.budget_report(ledger.budget(config), dt.datetime.now(dt.UTC)).first().report)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.what == "secret":
        print(pseudonym.mint_secret())
        return 0
    if args.what == "rotate-salt":
        now = _config(args).rotated(pseudonym.mint_secret())
        print(json.dumps({"HASH_SALT_SECRET": now.hash_salt_secret, "HASH_INDEX_SECRET": now.hash_index_secret}))
        return 0
    spark = spark or SparkSession.builder.appName("tidecount").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.what == "generate":
        rows = workloads.synthetic(spark, args.users, args.days, args.p_active, args.delete_rate, args.seed)
        (sinks.write_csv if args.path.endswith(".csv") else sinks.write_jsonl)(rows, args.path)
        return 0
    if hasattr(args, "ledger"):
        return _on_ledger(args, Ledger(spark, args.ledger), _config(args))
    rows = events.read_events(spark, args.path)
    if args.what == "exact":
        out = activity.rolling(turnstile.active_pairs(rows), activity.spine(rows), args.window).orderBy("day")
    else:
        config = _config(args)
        if args.what == "budget":
            answers = [release.releases_of(release.release(rows, m, config)) for m in ("dau", "mau")]
            out = release.budget_summary(answers[0].union(answers[1]), config).orderBy("metric", "period")
        else:
            out = release.release(rows, args.what, config, window_days=args.window).orderBy("day")
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0
