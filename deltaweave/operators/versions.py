"""An edge log as valid-time versions.

A log has columns seq, u, v, op ('I' or 'D') and el (edge label or null). Rows with seq <= 0 build the initial graph, the
others are the stream. Edges are identified by their canonical ends without the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.functions.scalars import OPEN, canonical, edge_hash, visible


def canonical_log(log: DataFrame, directed: bool) -> DataFrame:
    """Self-loops dropped, ends in canonical order."""
    a, b = canonical(F.col("u"), F.col("v"), directed)
    return log.where("u <> v").select("seq", a.alias("u"), b.alias("v"), "op", "el")


def dedup_edges(edges: DataFrame, directed: bool) -> DataFrame:
    """Initial edges (u, v, el, at: place in the file): one for each pair. Of several labels the one first seen in the file wins, unlabelled above all."""
    a, b = canonical(F.col("u"), F.col("v"), directed)
    own = edges.where("u <> v").select(a.alias("u"), b.alias("v"), "el", "at")
    first = edges.where("el is not null").groupBy(F.col("el").alias("_el")).agg(F.min("at").alias("_first"))
    ranked = own.join(first, F.col("el") == F.col("_el"), "left").withColumn("_rank", F.coalesce("_first", F.lit(-1)))
    return ranked.groupBy("u", "v").agg(F.min_by("el", "_rank").alias("el"))


def _changes(log: DataFrame, hot_chunk: int | None) -> DataFrame:
    """Adds the edge's operation before each row ('D' where there was none)."""
    if not hot_chunk:
        before = F.lag("op", 1, "D").over(W.partitionBy("u", "v").orderBy("seq"))
        return log.withColumn("_before", before)
    # An edge with very many updates is cut by time: within chunks by lag, across them by the chunks' last operations.
    parts = log.withColumn("_part", F.floor(F.col("seq") / hot_chunk))
    last = parts.groupBy("u", "v", "_part").agg(F.max_by("op", "seq").alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last", 1, "D").over(W.partitionBy("u", "v").orderBy("_part"))).drop("_last")
    inner = parts.withColumn("_inner", F.lag("op").over(W.partitionBy("u", "v", "_part").orderBy("seq")))
    joined = inner.join(carried, ["u", "v", "_part"])
    return joined.withColumn("_before", F.coalesce("_inner", "_carried")).drop("_inner", "_carried", "_part")


def effective(log: DataFrame, hot_chunk: int | None = None) -> DataFrame:
    """Rows that change an edge's state: after any row the state is its op, so those whose op differs from the one before."""
    return _changes(log, hot_chunk).where("op <> _before").drop("_before")


def effective_updates(log: DataFrame, hot_chunk: int | None = None) -> DataFrame:
    """Effective rows of the stream with th, the snapshot they are matched on, and the label of the version they open or close."""
    w = W.partitionBy("u", "v").orderBy("seq")
    rows = effective(log, hot_chunk).withColumn("el", F.when(F.col("op") == "I", F.col("el")).otherwise(F.lag("el").over(w)))
    return rows.where("seq > 0").withColumn("th", F.when(F.col("op") == "I", F.col("seq")).otherwise(F.col("seq") - 1))


def versions(log: DataFrame, hot_chunk: int | None = None) -> DataFrame:
    """u, v, el, ins, del: each lifetime of each edge; the initial graph lives from 0."""
    w = W.partitionBy("u", "v").orderBy("seq")
    rows = effective(log, hot_chunk).withColumn("_next", F.lead("seq").over(w)).where("op = 'I'")
    # greatest() passes over nulls, so an open end has to be told apart first.
    ends = F.when(F.col("_next").isNull(), OPEN).otherwise(F.greatest("_next", F.lit(0))).cast("long")
    out = rows.select("u", "v", "el", F.greatest("seq", F.lit(0)).cast("long").alias("ins"), ends.alias("del"))
    return out.where(F.col("ins") < F.col("del"))


def snapshot(vers: DataFrame, theta: Column | int) -> DataFrame:
    at = theta if isinstance(theta, Column) else F.lit(theta)
    return vers.where(visible(at, F.col("ins"), F.col("del")))


def compacted(vers: DataFrame) -> DataFrame:
    """Alive edges as a new base; closed lifetimes are gone."""
    return vers.where(F.col("del") == OPEN).select("u", "v", "el", F.lit(0).cast("long").alias("ins"), "del")


def needs_compaction(base: int, delta: int, dead: int) -> bool:
    return delta + dead > 0.25 * max(base, 1024)


def fingerprint(snap: DataFrame) -> DataFrame:
    """Number of edges and an additive hash, equal for equal snapshots whatever their rows' order."""
    return snap.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum(edge_hash(F.col("u"), F.col("v"))), F.lit(0)).cast("long").alias("hash"))


def adjacency(vers: DataFrame, vertices: DataFrame, directed: bool) -> DataFrame:
    """src, side, dst, src_label, dst_label, el, ins, del: each version at both ends. side 1 is the edge seen from its head; undirected edges have side 0 at both ends."""
    lu = vertices.select(F.col("id").alias("u"), F.col("label").alias("lu"))
    lv = vertices.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    return entries(vers.join(lu, "u").join(lv, "v"), directed)


def entries(e: DataFrame, directed: bool) -> DataFrame:
    """The adjacency of versions that have their ends' labels (lu, lv)."""
    out = e.select(F.col("u").alias("src"), F.lit(0).alias("side"), F.col("v").alias("dst"), F.col("lu").alias("src_label"), F.col("lv").alias("dst_label"), "el", "ins", "del")
    back = e.select(F.col("v").alias("src"), F.lit(int(directed)).alias("side"), F.col("u").alias("dst"), F.col("lv").alias("src_label"), F.col("lu").alias("dst_label"), "el", "ins", "del")
    return out.unionByName(back)


def labelled_updates(eff: DataFrame, vertices: DataFrame) -> DataFrame:
    lu = vertices.select(F.col("id").alias("u"), F.col("label").alias("lu"))
    lv = vertices.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    return eff.join(lu, "u").join(lv, "v")


def affected_vertices(eff: DataFrame, adj: DataFrame) -> DataFrame:
    """Ends of effective updates and their neighbours."""
    ends = eff.select(F.col("u").alias("id")).union(eff.select(F.col("v").alias("id"))).distinct()
    near = adj.join(ends, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    return ends.union(near).distinct()
