"""Command line: ``python -m lodestone.cli program.rls``."""

from __future__ import annotations

import argparse
import sys
from itertools import chain

from pyspark.sql import SparkSession

from .engine import Engine
from .lang.ast import RuleError
from .lang.values import canonical


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodestone", description="Evaluates a rule program on Spark.")
    p.add_argument("rules", nargs="+", help="the program's file")
    p.add_argument("-e", "--export", choices=("keep", "none", "idb", "edb", "all"), default="keep", help="which relations to write")
    p.add_argument("-D", "--export-dir", default="results")
    p.add_argument("-o", "--overwrite-results", action="store_true")
    p.add_argument("-g", "--gzip", action="store_true")
    p.add_argument("-I", "--import-dir")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--print-facts", choices=("none", "idb", "edb", "all"), default="none")
    p.add_argument("--trace", action="append", default=[], help="facts to explain")
    p.add_argument("--trace-predicate", action="append", default=[], help="predicates all of whose facts to explain")
    p.add_argument("--trace-output")
    p.add_argument("--report", choices=("none", "short", "time", "all"), default="short")
    p.add_argument("--no-warnings", action="store_true")
    p.add_argument("--master")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if len(args.rules) > 1:
        print("only one rule file can be run", file=sys.stderr)
        return 1
    builder = SparkSession.builder.appName("lodestone")
    spark = spark or (builder.master(args.master) if args.master else builder).getOrCreate()
    if args.quiet:
        spark.sparkContext.setLogLevel("OFF")
    engine = Engine(spark, tracing=bool(args.trace or args.trace_predicate))
    try:
        engine.load_file(args.rules[0], dict(x.split("=", 1) for x in args.param))
        if args.import_dir:
            engine.base_dir = args.import_dir
        from .analysis import checks
        from .sources.export import write_export, write_table

        program = engine.program
        idb, edb = checks.derived(program), engine.edb_predicates()
        chosen = {"keep": None, "none": [], "idb": idb, "edb": edb, "all": idb + edb}
        wanted = chosen[args.export] if args.export not in ("keep", "none") else checks.outputs(program)
        shown = chosen[args.print_facts] or []
        engine.run(outputs=list(dict.fromkeys([*wanted, *shown])))
        if not args.no_warnings:
            for w in program.warnings:
                print(f"warning: {w}", file=sys.stderr)
        if args.export == "keep":
            for spec in program.exports:
                write_export(engine, spec, args.export_dir, args.overwrite_results, args.gzip)
            wanted = [p for p in (program.outputs or ([] if program.exports else wanted))]
        if args.export != "none":
            for pred in wanted:
                write_table(engine, pred, f"{args.export_dir}/{checks.safe_name(pred)}.csv", ",", args.overwrite_results, args.gzip)
        for pred in shown:
            for row in engine.rows(pred):
                print(f"{pred}({', '.join(map(canonical, row))}) .")
        derivations = [(fact, engine.trace(fact)) for fact in args.trace]
        for fact, found in chain(derivations, (("", t) for t in engine.trace_predicates(args.trace_predicate))):
            text = f"{fact} was not derived" if found is None else found.ascii()
            if args.trace_output:
                with open(args.trace_output, "a", encoding="utf-8") as f:
                    f.write((found.json() if found else text) + "\n")
            else:
                print(text)
        if args.report in ("time", "all"):
            for name, seconds, step in engine.timings:
                print(f"{seconds:8.3f} s  step {step:4d}  {name}", file=sys.stderr)
    except (RuleError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
