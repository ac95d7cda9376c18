"""Command line: what is installed, which sketches there are, a demonstration, and the gate experiment."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .operators import all_sketches
from .operators.base import CARDINALITY, QUANTILE, Query, discover
from .operators.cardinality import HyperLogLog
from .operators.quantile import CentroidDigest
from .plans.experiment import gate, run_experiment, write_runs
from .runtime import env_probe
from .sources.files import dump_json
from .sources.generate import StreamSpec, generate_native
from .sources.stream import Stream


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("info")
    commands.add_parser("registry").add_argument("--query-type")
    demo = commands.add_parser("demo")
    demo.add_argument("--n", type=int, default=100_000)
    bench = commands.add_parser("bench")
    bench.add_argument("--datasets", default="uniform,zipf")
    bench.add_argument("--budgets", default="1024")
    bench.add_argument("--seeds", default="1337")
    bench.add_argument("--n", type=int, default=2_000)
    bench.add_argument("--domain", type=int, default=5_000)
    bench.add_argument("--out")
    bench.add_argument("--runs", help="folder for one row of each run")
    asked = parser.parse_args(args)
    all_sketches()
    if asked.command == "registry":
        print(json.dumps([asdict(m) for m in discover(asked.query_type)], indent=1))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "info":
        print(json.dumps(env_probe(spark), indent=1))
    elif asked.command == "demo":
        s = Stream(generate_native(spark, StreamSpec("zipf", asked.n, asked.n, 1)))
        for sketch, query in ((HyperLogLog(), Query(CARDINALITY)), (CentroidDigest(), Query(QUANTILE))):
            print(sketch, sketch.estimate(s, query).first().value)
    else:
        whole = lambda text: [int(x) for x in text.split(",")]
        runs = run_experiment(spark, asked.datasets.split(","), whole(asked.budgets), whole(asked.seeds), n=asked.n, domain=asked.domain).persist()
        report = gate(runs)
        print("PASS" if report["passed"] else "FAIL", *report["notes"], sep="\n")
        if asked.out:
            dump_json(report, asked.out)
        if asked.runs:
            write_runs(runs, asked.runs)
    return 0


if __name__ == "__main__":
    sys.exit(main())
