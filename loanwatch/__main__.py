"""Command line: ``python -m loanwatch {explore,train,predict,monitor} ...``.

Tables are parquet folders. The loan table is best partitioned by SNAPSHOT_DATE.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import constants as C
from . import contract
from .operators.explore import profile
from .plans import monitor as monitor_plan
from .plans import ingest, score, train
from .session import configure, drop_pins
from .sources import artifact, store
from .sources.tables import build_times, label_ledger, nan_to_null


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="loanwatch", description=__doc__)
    sub = ap.add_subparsers(dest="verb", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--loans", required=True, help="loan table (parquet)")
    common.add_argument("--ledger", required=True, help="label ledger (parquet)")
    common.add_argument("--out", required=True, help="output folder")
    sub.add_parser("explore", parents=[common])
    feed = argparse.ArgumentParser(add_help=False)
    feed.add_argument("--store", help="snapshot store; without it the loan table is read as a whole")
    feed.add_argument("--strict", action="store_true", help="a broken feed rule ends the run")
    t = sub.add_parser("train", parents=[common, feed])
    t.add_argument("--final", action="store_true", help="deployment fit on all mature snapshots")
    t.add_argument("--walk-forward", action="store_true")
    t.add_argument("--deploy", default=C.DEPLOY_ARM, help="arm to ship, or auto")
    t.add_argument("--grain", default="loan", choices=("loan", "portfolio"))
    t.add_argument("--approx", action="store_true", help="estimated quantiles in the fits")
    p = sub.add_parser("predict", parents=[common, feed])
    p.add_argument("--job-control", help="load job's bookkeeping, which says when a snapshot was built; with --store")
    p.add_argument("--job", default="MONTHLY_LOAD", help="name of the load job")
    p.add_argument("--model", required=True)
    p.add_argument("--snapshot", type=int, nargs="*")
    p.add_argument("--called-log")
    p.add_argument("--as-of", required=True, help="day the queue is made, YYYY-MM-DD")
    m = sub.add_parser("monitor", parents=[common])
    m.add_argument("--asof", type=int, required=True, help="YYYYMMDD")
    for name in ("runs", "output", "tracking", "state-log"):
        m.add_argument(f"--{name}", required=True)
    args = ap.parse_args(argv)

    spark = configure(SparkSession.builder.appName("loanwatch")).getOrCreate()
    loans = nan_to_null(spark.read.parquet(args.loans))
    raw_ledger = spark.read.parquet(args.ledger)
    ledger = label_ledger(raw_ledger)
    out = args.out.rstrip("/")
    if args.verb == "explore":
        profile.profile(loans, ledger).write.mode("overwrite").parquet(f"{out}/profile")
    elif args.verb == "train":
        features = [c for c in contract.FEATURES if c in loans.columns]
        options = {"deploy": args.deploy, "grain": args.grain,
                   "method": "approx" if args.approx else "exact"}
        if args.store:
            loans = ingest.training_loans(loans, ledger, args.store, args.strict)
        else:
            loans = ingest.checked(loans, ledger, args.strict)
        if args.walk_forward:
            results, summary = train.walk_forward(loans, ledger, features, **options)
            summary.write.mode("overwrite").parquet(f"{out}/fold_summary")
            for i, r in enumerate(results, 1):
                _keep(spark, r, f"{out}/fold_{i:02d}")
        else:
            rows = train.static_split(loans, ledger, final=args.final)
            _keep(spark, train.train_fold(rows, features, ledger, **options), out)
    elif args.verb == "predict":
        params = score.ScoringParams(args.model, as_of=args.as_of, output_folder=out,
                                     called_log_path=args.called_log)
        built = None
        if args.store:
            if not args.job_control:
                ap.error("--store needs --job-control")
            built = build_times(spark.read.parquet(args.job_control), args.job)
        score.predict(spark, loans, ledger, params, args.snapshot, store_path=args.store, build_times=built, strict=args.strict)
    else:
        tables = monitor_plan.EngineTables(
            *[spark.read.parquet(x) for x in (args.runs, args.output, args.tracking)],
            raw_ledger, spark.read.parquet(args.state_log), loans)
        monitor_plan.run_monitor(tables, args.asof, out)
    drop_pins(spark)


def _keep(spark: SparkSession, result: train.FoldResult, path: str) -> None:
    artifact.save(result.model, spark, f"{path}/model")
    if result.metrics is not None:
        result.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
        result.intervals.write.mode("overwrite").parquet(f"{path}/intervals")
        store.write_scored_test(result.scored_test, f"{path}/scored_test")


if __name__ == "__main__":
    main()
