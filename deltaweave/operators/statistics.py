"""Statistics of graphs, for the planner and for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.scalars import STAIRS
from deltaweave.plans.match_plan import Statistics


def vertices_by_label(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n_vertices"))


def entries_by_type(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src_label", "side", "dst_label").agg(F.count(F.lit(1)).alias("n_entries"))


def fanout_closure(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """Entries for each vertex of the label, and their share of all pairs (at most 1)."""
    n = vertices_by_label(vertices)
    src = n.select(F.col("label").alias("src_label"), F.col("n_vertices").alias("ns"))
    dst = n.select(F.col("label").alias("dst_label"), F.col("n_vertices").alias("nd"))
    both = entries_by_type(adj).join(src, "src_label").join(dst, "dst_label")
    return both.select("src_label", "side", "dst_label", "n_entries", (F.col("n_entries") / F.col("ns")).alias("fanout"), F.least(F.lit(1.0), F.col("n_entries") / (F.col("ns") * F.col("nd"))).alias("closure"))


def collect_statistics(adj: DataFrame, vertices: DataFrame, labels: list[int]) -> Statistics:
    """For the planner: counts of the query's labels only, at most 32 labels and 2048 entries."""
    v = vertices_by_label(vertices.where(F.col("label").isin(labels))).collect()
    e = entries_by_type(adj.where(F.col("src_label").isin(labels) & F.col("dst_label").isin(labels))).collect()
    return Statistics({r.label: r.n_vertices for r in v}, {(r.src_label, r.side, r.dst_label): r.n_entries for r in e})


def degrees(adj: DataFrame) -> DataFrame:
    """id, deg_out, deg_in (for undirected graphs all entries count as out)."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("side") == 0).alias("deg_out"), F.count_if(F.col("side") == 1).alias("deg_in"))


def degree_summary(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """max_out, max_in, entries for each vertex."""
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    d = degrees(adj).agg(F.max("deg_out").alias("max_out"), F.max("deg_in").alias("max_in"), F.sum(F.col("deg_out") + F.col("deg_in")).alias("e"))
    return d.join(F.broadcast(n)).select("max_out", "max_in", (F.col("e") / F.col("n")).alias("mean_degree"))


def top_labels(vertices: DataFrame, n: int = 8) -> DataFrame:
    return vertices_by_label(vertices).orderBy(F.col("n_vertices").desc(), "label").limit(n)


def first_label(declared: DataFrame) -> DataFrame:
    """declared: id, label, at. The first declaration counts; `ignored` counts later ones with another label."""
    first = declared.groupBy("id").agg(F.min_by("label", "at").alias("label"))
    other = declared.join(first.withColumnRenamed("label", "_first"), "id").groupBy("id").agg(F.count_if(F.col("label") != F.col("_first")).alias("ignored"))
    return first.join(other, "id")


def slope(adj: DataFrame, by_edge_label: bool = False) -> DataFrame:
    """Incident edges of each vertex by neighbour's label and side."""
    keys = ["dst_label", "side", *(["el"] if by_edge_label else [])]
    return adj.groupBy(F.col("src").alias("id"), *keys).agg(F.count(F.lit(1)).alias("n"))


def staircase(adj: DataFrame) -> DataFrame:
    """For each vertex, neighbour's label and side: neighbours whose degree reaches each threshold (t2, t3, ...)."""
    deg = degrees(adj).select(F.col("id").alias("dst"), (F.col("deg_out") + F.col("deg_in")).alias("deg"))
    near = adj.select("src", "side", "dst", "dst_label").distinct().join(deg, "dst")
    return near.groupBy(F.col("src").alias("id"), "dst_label", "side").agg(*[F.count_if(F.col("deg") >= t).alias(f"t{t}") for t in STAIRS])


def curvature(adj: DataFrame) -> DataFrame:
    """Paths v - w - x with x other than v, by the labels of w and x and the sides; counted from the neighbours' own counts, no path is built."""
    own = adj.groupBy(F.col("src").alias("w"), F.col("side").alias("side2"), F.col("dst_label").alias("label2")).agg(F.count(F.lit(1)).alias("n"))
    through = adj.select(F.col("src").alias("id"), F.col("src_label"), F.col("dst").alias("w"), F.col("dst_label").alias("label1"), F.col("side").alias("side1")).join(own, "w")
    sums = through.groupBy("id", "src_label", "label1", "side1", "label2", "side2").agg(F.sum("n").alias("n"))
    # Steps straight back: the entry of w that leads to v.
    go, back = adj.select(F.col("src").alias("id"), F.col("dst").alias("w"), F.col("dst_label").alias("label1"), F.col("side").alias("side1")), adj.select(F.col("src").alias("w"), F.col("dst").alias("id"), F.col("dst_label").alias("label2"), F.col("side").alias("side2"))
    returns = go.join(back, ["id", "w"]).groupBy("id", "label1", "side1", "label2", "side2").agg(F.count(F.lit(1)).alias("r"))
    keys = ["id", "label1", "side1", "label2", "side2"]
    out = sums.drop("src_label").join(returns, keys, "left").select(*keys, (F.col("n") - F.coalesce("r", F.lit(0))).cast("long").alias("n"))
    return out.where("n > 0")
