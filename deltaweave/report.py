"""Reports of a run: the short one, the `RESULT key=value` line and the data set's statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.functions.scalars import base_name, dataset_name
from deltaweave.operators import matching, pruning, statistics, versions
from deltaweave.plans.match_plan import RARE_FIRST, build_plans, explain
from deltaweave.sources.text import GraphStream


def run(data: GraphStream, *, kind: int = 0, time_limit: float | None = None) -> tuple[DataFrame, dict]:
    """Per-update deltas and a summary. With a time limit the jobs are cancelled at its end and the counts are lower bounds (0)."""
    began = time.time()
    sc = data.vertices.sparkSession.sparkContext
    eff = versions.effective_updates(data.log)
    labelled = pruning.relevant(versions.labelled_updates(eff, data.vertices), data.query)
    adj = versions.adjacency(versions.versions(data.log), data.vertices, data.directed)
    updates = data.updates()
    stats = None
    if kind == RARE_FIRST:  # the order by rarity needs the initial graph's statistics
        initial = versions.adjacency(versions.versions(data.log.where("seq <= 0")), data.vertices, data.directed)
        stats = statistics.collect_statistics(initial, data.vertices, data.query.labels)
    deltas = matching.delta_matches(updates, labelled, adj, data.query, kind=kind, stats=stats).persist()
    relevant = pruning.relevant(versions.labelled_updates(updates, data.vertices), data.query).count()
    complete = True
    if time_limit is not None:
        import threading

        group = f"limited-{id(data)}"
        sc.setJobGroup(group, "time limit", interruptOnCancel=True)
        timer = threading.Timer(time_limit, lambda: sc.cancelJobGroup(group))
        timer.start()
    try:
        summary = matching.totals(deltas, eff, updates).first().asDict()
    except Exception:
        if time_limit is None or time.time() - began < time_limit:
            raise
        complete, summary = False, {"dm_pos": 0, "dm_neg": 0, "eff_ins": None, "eff_del": None, "noop": None}
    finally:
        if time_limit is not None:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
    summary |= {"relevant": relevant, "seconds": time.time() - began, "complete": complete}
    return deltas, summary


def short(data: GraphStream, summary: dict, graph_path: str, query_path: str, name: str | None = None) -> str:
    q, r = data.query.shape(), data.report
    n = r.get("insertions", 0) + r.get("deletions", 0)
    rows = [
        ("Dataset", dataset_name(graph_path, name)),
        ("Nodes", r["nodes"]),
        ("Edges", f"{r['edges']} ({'directed' if data.directed else 'undirected'})"),
        ("Query", base_name(query_path)),
        ("Query details", f"{q['vertices']} vertices | {q['edges']} edges | max degree {q['max_degree']} | diameter {q['diameter']} | {q['labels']} labels"),
        ("Stream updates", f"{n} ({r.get('insertions', 0)} insertions, {r.get('deletions', 0)} deletions)"),
        ("Relevant", f"{summary['relevant']} of {n} updates can touch the query"),
        ("Matches found", f"{summary['dm_pos']} added, {summary['dm_neg']} deleted" + ("" if summary["complete"] else " (lower bounds: time limit)")),
        ("Time", f"{summary['seconds'] * 1000:.2f} ms"),
        ("Speed", f"{n / max(summary['seconds'], 1e-9):.4e} updates/sec"),
    ]
    return "\n".join(f"{k:<15}: {v}" for k, v in rows)


def result_line(data: GraphStream, summary: dict) -> str:
    pairs = {**data.report, **data.query.shape(), **summary}
    return "RESULT " + " ".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in sorted(pairs.items()))


def result_frame(spark: SparkSession, data: GraphStream, summary: dict) -> DataFrame:
    """The result line as a table of one row."""
    pairs = {**data.report, **summary}
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in pairs.values())], ", ".join(f"`{k}` double" for k in pairs))


def dataset_report(data: GraphStream) -> str:
    """Degrees, label histogram and load statistics."""
    adj = versions.adjacency(versions.versions(data.log.where("seq <= 0")), data.vertices, data.directed)
    d = statistics.degree_summary(adj, data.vertices).first()
    lines = [f"max degree out {d.max_out}, in {d.max_in}; mean {d.mean_degree or 0:.2f}"]
    lines += [f"label {r.label}: {r.n_vertices} vertices" for r in statistics.top_labels(data.vertices).collect()]
    lines += [f"{k}: {v}" for k, v in sorted(data.report.items())]
    missing = [x for x in sorted(set(data.query.labels)) if not data.vertices.where(F.col("label") == x).limit(1).count()]
    lines += [f"WARNING: no data vertex has the query's label {x}, it can never match" for x in missing]
    return "\n".join(lines)


def plan_report(data: GraphStream) -> str:
    adj = versions.adjacency(versions.versions(data.log.where("seq <= 0")), data.vertices, data.directed)
    stats = statistics.collect_statistics(adj, data.vertices, data.query.labels)
    return explain(data.query, build_plans(data.query, stats))
