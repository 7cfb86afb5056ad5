"""Filters that remove only work that can't give an embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.scalars import visible
from deltaweave.plans.match_plan import anchors, closure_requirements
from deltaweave.plans.query_graph import QueryGraph


def relevant(edges: DataFrame, q: QueryGraph, lu: str = "lu", lv: str = "lv") -> DataFrame:
    """Edges or updates whose label pair occurs in the query. At most 128 pairs, so a condition and no join."""
    pairs = sorted(q.label_pairs())
    return edges.where(reduce(lambda a, b: a | b, ((F.col(lu) == a) & (F.col(lv) == b) for a, b in pairs)))


def relevant_entries(adj: DataFrame, q: QueryGraph) -> DataFrame:
    """Adjacency entries whose labels and side occur in the query."""
    kinds = {x for a, b in q.edges for x in ((q.labels[a], 0, q.labels[b]), (q.labels[b], int(q.directed), q.labels[a]))}
    return adj.where(reduce(lambda x, y: x | y, ((F.col("src_label") == a) & (F.col("side") == s) & (F.col("dst_label") == b) for a, s, b in sorted(kinds))))


def anchor_tasks(eff: DataFrame, q: QueryGraph) -> DataFrame:
    """seq, qa, qb for each effective update and anchor with its label pair."""
    rows = []
    for a, b, el in anchors(q):
        hit = eff.where((F.col("lu") == q.labels[a]) & (F.col("lv") == q.labels[b]))
        if q.labelled:
            hit = hit.where(F.col("el").eqNullSafe(F.lit(el)))
        rows.append(hit.select("seq", F.lit(a).alias("qa"), F.lit(b).alias("qb")))
    return reduce(DataFrame.unionByName, rows)


def query_slope(q: QueryGraph, v: int) -> dict[tuple[int, int], int]:
    """Neighbours of a query vertex by label and side."""
    out: dict[tuple[int, int], int] = {}
    for (a, b) in q.edges:
        for here, there, side in ((a, b, 0), (b, a, int(q.directed))):
            if here == v:
                out[q.labels[there], side] = out.get((q.labels[there], side), 0) + 1
    return out


def dominance(adj: DataFrame, q: QueryGraph) -> DataFrame:
    """qv, id: data vertices whose incident edges are no fewer, by neighbour's label and side, than the query vertex's.

    On a table that holds every version alive at some time of a batch this is sound for each snapshot of the batch.
    """
    alive = adj.select("src", "src_label", "side", "dst", "dst_label").distinct()
    labels = {x: alive.where(F.col("src_label") == x) for x in set(q.labels)}
    out = []
    for v in range(q.k):
        need = query_slope(q, v)
        counts = [F.count_if((F.col("dst_label") == label) & (F.col("side") == side)) >= n for (label, side), n in sorted(need.items())]
        ok = reduce(lambda a, b: a & b, counts)
        out.append(labels[q.labels[v]].groupBy(F.col("src").alias("id")).agg(ok.alias("ok")).where("ok").select(F.lit(v).alias("qv"), "id"))
    return reduce(DataFrame.unionByName, out)


def pruned_updates(eff: DataFrame, adj: DataFrame, q: QueryGraph) -> DataFrame:
    """Effective updates with at least one anchor whose ends both dominate theirs."""
    hosts = dominance(adj, q)
    tasks = anchor_tasks(eff, q).join(eff.select("seq", "u", "v"), "seq")
    one = hosts.select(F.col("qv").alias("qa"), F.col("id").alias("_a"))
    two = hosts.select(F.col("qv").alias("qb"), F.col("id").alias("_b"))
    t = tasks.withColumnRenamed("u", "_a").withColumnRenamed("v", "_b").join(one, ["qa", "_a"], "left_semi").join(two, ["qb", "_b"], "left_semi")
    return eff.join(t.select("seq").distinct(), "seq", "left_semi")


def common_neighbours(eff: DataFrame, adj: DataFrame) -> DataFrame:
    """seq, label, n: common neighbours of an update's ends that are visible at its snapshot, both edges undirected or outgoing from the ends."""
    e = adj.where("side = 0")
    one = e.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("dst_label").alias("label"), F.col("ins").alias("i1"), F.col("del").alias("d1"))
    two = e.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.col("ins").alias("i2"), F.col("del").alias("d2"))
    rows = eff.select("seq", "th", "u", "v").join(one, "u").where(visible(F.col("th"), F.col("i1"), F.col("d1")))
    rows = rows.join(two, ["v", "w"]).where(visible(F.col("th"), F.col("i2"), F.col("d2")))
    return rows.groupBy("seq", "label").agg(F.count(F.lit(1)).alias("n"))


def closure_filter(eff: DataFrame, adj: DataFrame, q: QueryGraph) -> DataFrame:
    """Undirected queries: drops updates that have too few common neighbours for every anchor (edge labels ignored)."""
    if q.directed or q.k < 4:
        return eff
    found = common_neighbours(eff, adj)
    kept = []
    for a, b, _ in anchors(q):
        need = closure_requirements(q, a, b)
        rows = eff.where((F.col("lu") == q.labels[a]) & (F.col("lv") == q.labels[b])).select("seq")
        for label, _, n in need:
            rows = rows.join(found.where((F.col("label") == label) & (F.col("n") >= n)).select("seq"), "seq", "left_semi")
        kept.append(rows)
    return eff.join(reduce(DataFrame.unionByName, kept).distinct(), "seq", "left_semi")


