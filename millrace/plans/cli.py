"""Command line: profile, clean, worker, run, generate."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import time

from millrace.operators import enrich, lineage, profile, report, shape
from millrace.plans import pipeline
from millrace.sources import readers, sinks, synthetic
from pyspark import cloudpickle
from pyspark.sql import SparkSession

log = logging.getLogger("millrace")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "clean", "worker", "run"):
        c = sub.add_parser(name)
        c.add_argument("--input", "-i", required=True)
        c.add_argument("--output-dir", "-o", default="pipeline_output")
        c.add_argument("--intensity", choices=sorted(pipeline.PRESETS), default="intense")
        c.add_argument("--enhance-numeric", action="store_true")
        c.add_argument("--fix-catnum", action="store_true")
        c.add_argument("--enrich", action="store_true")
        c.add_argument("--benchmark", action="store_true")
        c.add_argument("--debug", action="store_true", help="log every step")
        c.add_argument("--enable-llm", action="store_true", help="send the cleaned rows through a model of your own")
        c.add_argument("--provider", default=None, help="that model as package.module:function, from an iterator of pandas frames to another")
        c.add_argument("--llm-key", default=None, help="handed to the model in the environment variable MODEL_KEY")
    g = sub.add_parser("generate")
    g.add_argument("--rows", type=int, required=True)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    if args.command == "generate":
        sinks.write(synthetic.customers(spark, args.rows, args.seed, nested=readers.suffix(args.output) != "csv"), args.output)
        return {"rows": args.rows}
    if args.debug:
        logging.getLogger("millrace").setLevel(logging.DEBUG)
        logging.basicConfig(format="%(asctime)s - %(levelname)s - %(message)s")
    began, every = time.time(), pipeline.PRESETS[args.intensity]
    rows = shape.with_row_id(readers.read_any(spark, args.input))
    columns = [c for c in rows.columns if c != "row_id"]
    log.debug("%s of %s, %d columns", args.command, args.input, len(columns))
    out: dict = {}
    if args.command == "profile":
        out = {"stats": profile.as_dict(profile.profile(rows, "row_id", every["numeric_every"], every["mode_every"]))}
    elif args.command == "clean":
        result = pipeline.clean_table(rows, intensity=args.intensity)
        sinks.write(result.cleaned, f"{args.output_dir}/cleaned.csv")
        out = pipeline.report_of(result, every=every["sample_every"])
        if args.benchmark:
            words = shape.columns_of(rows, "string")
            out["normalization"] = report.normalization_accuracy(rows, result.cleaned, "row_id", words).first().asDict() if words else None
    else:
        result = pipeline.clean_worker(rows, every=every["numeric_every"] if args.intensity != "intense" else 1, lsh_every=every["lsh_every"])
        log.debug("first pass: %s", result.stats)
        base = args.input.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        sinks.write(result.cleaned, f"{args.output_dir}/cleaned_{base}.csv" if args.command == "run" else f"{args.output_dir}/cleaned.parquet")
        sinks.write(result.provenance, f"{args.output_dir}/provenance.parquet")
        figures = lineage.worker_stats(rows, result.cleaned, result.changes, result.scores).first().asDict()
        out = {"stats": result.stats, "worker": figures}
        if args.command == "run":
            sinks.write_report(spark, {"pass1": {"row_count": figures["rows_total"], "imputation_stats": result.stats}, "pass2": figures}, f"{args.output_dir}/stats_{base}.json")
    if args.enable_llm and args.command != "profile":
        if not args.provider:
            raise SystemExit("--enable-llm needs --provider package.module:function")
        module, _, name = args.provider.partition(":")
        module = importlib.import_module(module)
        cloudpickle.register_pickle_by_value(module)  # executors need not have the module
        if args.llm_key:
            spark.sparkContext.environment["MODEL_KEY"] = args.llm_key
        sinks.write(enrich.analyse(result.cleaned, getattr(module, name)), f"{args.output_dir}/analysed.parquet")
    if args.enhance_numeric:
        out["numeric_candidates"] = [r.asDict() for r in profile.numeric_candidates(rows, columns).collect()]
    if args.fix_catnum:
        out["column_classes"] = [r.asDict() for r in profile.column_classes(rows, columns).collect()]
    if args.enrich and args.command != "profile":
        words = shape.columns_of(result.cleaned, "string")
        sinks.write(enrich.enrich(result.cleaned, words), f"{args.output_dir}/enriched.csv")
    if args.command != "profile":
        result.release()
    out["seconds"] = round(time.time() - began, 3)
    sinks.write_report(spark, out, f"{args.output_dir}/{args.command}_report.json")
    print(json.dumps({k: v for k, v in out.items() if k in ("summary", "worker", "seconds")}, default=str))
    return out


if __name__ == "__main__":
    main()
