"""Command-line jobs: ``spark-submit -m sparkmend <command> ...`` or ``python -m sparkmend``.

ingest     collections (JSON-lines folders) -> one headered CSV per table
validate   raw CSV tables -> raw gate -> master -> merged gate -> sinks and status
run        ingest, then validate; exit status 1 when validation fails
train      master -> features -> time-split GBT -> saved model; prints metrics
states     daily machine states of a dated master (all days, or those from a day on)
score      master -> features -> predictions into the day-partitioned store (+ latest status)
retrain    weekly retraining as of a date, model saved under <model-root>/as_of=<date>
stream     hourly scoring of new event files (foreachBatch) into the store
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from sparkmend.session import ensure_checkpoint_dir
    spark = SparkSession.builder.appName("sparkmend").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkmend", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--collections", required=True)
    a.add_argument("--raw-dir", required=True)
    a = sub.add_parser("validate")
    a.add_argument("--raw-dir", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--strict", action="store_true")
    a.add_argument("--schema", help="schema file: <table>: {columns: {name: dtype}}")
    a = sub.add_parser("run")
    a.add_argument("--collections", required=True)
    a.add_argument("--work", required=True)
    a.add_argument("--strict", action="store_true")
    a.add_argument("--config", help="run settings: collections, raw_data_dir, validation root_dir")
    a.add_argument("--schema", help="schema file: <table>: {columns: {name: dtype}}")
    a = sub.add_parser("train")
    a.add_argument("--master", required=True)
    a.add_argument("--model", required=True)
    a.add_argument("--max-iter", type=int, default=20)
    a = sub.add_parser("states")
    a.add_argument("--master", required=True)
    a.add_argument("--states", required=True)
    a.add_argument("--from", dest="from_day", help="YYYY-MM-DD: replace the days from this one on")
    a = sub.add_parser("score")
    a.add_argument("--master", required=True)
    a.add_argument("--model", required=True)
    a.add_argument("--store", required=True)
    a.add_argument("--latest")
    a.add_argument("--from", dest="from_day", help="YYYY-MM-DD: re-score whole days from this one on")
    a.add_argument("--states", help="daily states of the master: with --from only the folders of these days are read")
    a = sub.add_parser("retrain")
    a.add_argument("--master", required=True)
    a.add_argument("--as-of", required=True, help="YYYY-MM-DD")
    a.add_argument("--model-root", required=True)
    a.add_argument("--train-days", type=int, default=90)
    a.add_argument("--states", help="daily states of the master: only the folders of the training window are read")
    a = sub.add_parser("stream")
    for flag in ("--events", "--history", "--model", "--store", "--checkpoint", "--machines"):
        a.add_argument(flag, required=True)
    a.add_argument("--glob")
    a.add_argument("--delay", default="1 hour", help="watermark delay: how late an event may arrive")
    a.add_argument("--max-files-per-trigger", type=int)
    a.add_argument("--once", action="store_true", help="process what is there, then stop")
    args = p.parse_args(argv)

    spark = _session()
    from sparkmend.operators.gates import GateError
    try:
        return _dispatch(spark, args)
    except (GateError, FileNotFoundError) as e:  # a failed gate ends the run, as a status
        print(json.dumps({"validation_status": False, "error": str(e)}))
        return 1


def _dispatch(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.cmd == "ingest":
        from sparkmend.sources.documents import ingest
        print(json.dumps(ingest(spark, args.collections, args.raw_dir).__dict__, default=list))
    elif args.cmd == "validate":
        from sparkmend.contracts import load_contracts
        from sparkmend.plans.validation import run_validation
        contracts = load_contracts(args.schema)[0] if args.schema else None
        art = run_validation(spark, args.raw_dir, args.out, args.strict, contracts=contracts)
        print(json.dumps(art.__dict__))
    elif args.cmd == "run":
        from sparkmend.contracts import load_contracts
        from sparkmend.plans.validation import load_run_config, run_stages
        contracts = load_contracts(args.schema)[0] if args.schema else None
        if args.config:
            cfg = load_run_config(args.config, args.work)
            res = run_stages(spark, args.collections, args.work, args.strict, cfg.collections,
                             cfg.raw_data_dir, cfg.validation_dir, contracts)
        else:
            res = run_stages(spark, args.collections, args.work, args.strict, contracts=contracts)
        print(json.dumps({"raw_data_dir": res.raw_data_dir, "halted": res.halted}))
        return 1 if res.halted else 0
    elif args.cmd == "train":
        from sparkmend.plans import model as M
        from sparkmend.plans.features import feature_table
        from sparkmend.plans.master import read_master
        result, _ = M.train(feature_table(read_master(spark, args.master)), max_iter=args.max_iter)
        M.save_model(result.model, args.model)
        print(json.dumps({"cutoff": result.cutoff.isoformat(), **result.metrics}))
    elif args.cmd == "states":
        from sparkmend.plans.states import write_states
        write_states(spark, args.master, args.states, args.from_day and dt.date.fromisoformat(args.from_day))
    elif args.cmd == "score":
        from sparkmend.plans import model as M
        from sparkmend.plans.features import feature_table, latest_per_machine
        from sparkmend.plans.master import read_master
        model, first = M.load_model(args.model), args.from_day and dt.date.fromisoformat(args.from_day)
        if first and args.states:
            preds = M.score_days(spark, model, args.master, args.states, first)
        else:
            feats = feature_table(read_master(spark, args.master))  # features see all history
            if first:
                from pyspark.sql import functions as F
                feats = feats.where(F.to_date("datetime") >= F.lit(first))
            preds = M.score(model, feats)
        M.store_predictions(preds, args.store)  # replaces only the days scored
        if args.latest:
            latest_per_machine(M.read_predictions(spark, args.store).drop("date")) \
                .write.mode("overwrite").parquet(args.latest)
    elif args.cmd == "retrain":
        from sparkmend.plans import model as M
        as_of = dt.datetime.fromisoformat(args.as_of)
        from sparkmend.plans.master import read_master
        master = args.master if args.states else read_master(spark, args.master)
        res = M.retrain(master, as_of, args.train_days, model_root=args.model_root, states_path=args.states, spark=spark)
        print(json.dumps({"as_of": args.as_of, **res.metrics}))
    elif args.cmd == "stream":
        from sparkmend.streaming.hourly import run_hourly_scoring
        q = run_hourly_scoring(spark, args.events, args.history, args.model, args.store,
                               args.checkpoint, spark.read.parquet(args.machines),
                               file_glob=args.glob, delay=args.delay, available_now=args.once,
                               max_files_per_trigger=args.max_files_per_trigger)
        q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
