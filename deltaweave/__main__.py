"""python -m deltaweave --graph G --stream S --query Q [--directed] [--batch N] [--time-limit SEC] [--name NAME] [--verbose] [--default-label L] [--out DIR]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from deltaweave import report
from deltaweave.sources.text import load_dataset, write_deltas
from deltaweave.streaming.engine import MatchingStream


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deltaweave", description="Exact continuous subgraph matching on Spark.")
    p.add_argument("--graph", required=True)
    p.add_argument("--stream", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--directed", action="store_true")
    p.add_argument("--batch", type=int, help="updates in a micro-batch; without it the whole stream is one batch")
    p.add_argument("--time-limit", type=float)
    p.add_argument("--name")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--default-label", type=int)
    p.add_argument("--out", help="folder for the per-update counts (needed with --batch)")
    a = p.parse_args(argv)
    if a.batch and not a.out:
        p.error("--batch needs --out")
    spark = SparkSession.builder.getOrCreate()
    query_text = "\n".join(r.value for r in spark.read.text(a.query, lineSep="\n").collect())
    data = load_dataset(spark, a.graph, a.stream, query_text, directed=a.directed, label=a.default_label)
    if a.batch:
        engine = MatchingStream(spark, a.out, data.log, data.vertices, data.query)
        last = data.log.agg({"seq": "max"}).first()[0] or 0
        for i, at in enumerate(range(0, int(last), a.batch)):
            engine.apply(data.log.where(f"seq > {at} and seq <= {at + a.batch}"), i)
    deltas, summary = report.run(data, time_limit=a.time_limit)
    print(report.short(data, summary, a.graph, a.query, a.name))
    if a.verbose:
        print(report.dataset_report(data))
        print(report.plan_report(data))
        print(report.result_line(data, summary))
    if a.out and not a.batch:
        write_deltas(deltas, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
