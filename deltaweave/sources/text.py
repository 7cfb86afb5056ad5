"""Text graphs and streams: one record on a line, parsed by column expressions.

Lines end at \\n only; blanks are space, tab and \\r; empty lines and those that begin with # or % are passed over. A line's place in
its file is counted from file splits, so order survives any division of the input: lines are numbered inside
each split, and a small table of the splits' sizes gives the offsets.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.functions.scalars import canonical
from deltaweave.operators.versions import canonical_log, dedup_edges
from deltaweave.plans.query_graph import QueryGraph, parse_query

MAX_WARNINGS = 5


class InputError(ValueError):
    """Too many malformed lines."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (1-based, as in the file) and tokens of each line that holds a record."""
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    raw = raw.withColumn("place", F.monotonically_increasing_id())
    sizes = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("file", "split", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inner = raw.withColumn("rn", F.row_number().over(W.partitionBy("file", "split").orderBy("place")))
    lines = inner.join(before, ["file", "split"]).select((F.col("before") + F.col("rn")).alias("line"), F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("text"))
    return lines.where("text <> '' and not startswith(text, '#') and not startswith(text, '%')").select("line", F.split("text", r"[ \t\r]+").alias("tokens"))


def _token(i: int) -> Column:
    return F.get("tokens", F.lit(i))


def _number(t: Column, digits: int, kind: str) -> Column:
    """The token as an unsigned number, null if it isn't one."""
    return F.when(t.rlike(rf"^[0-9]{{1,{digits}}}$"), t).try_cast(kind)


def parse_records(lines: DataFrame, stream: bool, id_type: str = "decimal(38,0)") -> DataFrame:
    """line, kind (edge, vertex, hint, ignored, malformed), op, u, v, label. Edge labels that aren't numbers are no labels."""
    tag, a, b, c = (_token(i) for i in range(4))
    edge_tags = ["e", "+e", "-e"] if stream else ["e"]
    minus = (a.startswith("-") & b.startswith("-")) if stream else F.lit(False)
    # "e -(u+1) -(v+1)" deletes (u, v); it excludes "-e", one sign alone, and -0.
    strip = lambda t: F.when(minus, F.substring(t, 2, 1000)).otherwise(t)
    shift = F.when(minus, F.lit(1)).otherwise(F.lit(0))
    u, v = (_number(strip(t), 38, id_type) for t in (a, b))
    zero = minus & ((u == 0) | (v == 0))
    label = F.when(tag.isin(edge_tags), _number(c, 19, "decimal(19,0)")).otherwise(_number(b, 19, "decimal(19,0)"))
    is_edge = tag.isin(edge_tags)
    good_edge = is_edge & u.isNotNull() & v.isNotNull() & ~F.coalesce(zero, F.lit(False)) & ~(minus & (tag == "-e"))
    vertex_tags = ["v", "+v"] if stream else ["v"]
    vid = _number(a, 38, id_type)
    good_vertex = tag.isin(vertex_tags) & vid.isNotNull() & _number(b, 19, "decimal(19,0)").isNotNull()
    kind = F.when(F.coalesce(good_edge, F.lit(False)), "edge").when(F.coalesce(good_vertex, F.lit(False)), "vertex")
    kind = kind.when((tag == "-v") & F.lit(stream), "ignored").when((tag == "t") & F.lit(not stream), "hint").otherwise("malformed")
    op = F.when((tag == "-e") | minus, "D").otherwise("I")
    rows = lines.select("line", "tokens", kind.alias("kind"), op.alias("op"), F.when(is_edge, u - shift).otherwise(vid).cast(id_type).alias("u"), F.when(is_edge, v - shift).cast(id_type).alias("v"), label.alias("label"), is_edge.alias("edge_line"))
    return rows


def check_malformed(records: DataFrame, what: str) -> dict[str, int]:
    """Counts by kind; warns of the first malformed lines and refuses files with more than 100 and more than a tenth of them."""
    counts = {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()}
    bad = counts.get("malformed", 0)
    if bad:
        for r in records.where("kind = 'malformed'").orderBy("line").limit(MAX_WARNINGS).collect():
            print(f"warning: {what} line {r.line} is malformed and skipped", file=sys.stderr)
    lines = sum(n for k, n in counts.items() if k in ("edge", "vertex") or (what == "stream" and k == "malformed"))
    if bad > 100 and bad * 10 > lines:
        raise InputError(f"{what}: {bad} of {lines} lines are malformed")
    return counts


@dataclass
class GraphStream:
    """Everything that a run reads. log: seq, u, v, op, el, the initial graph at seq 0; vertices: id, label."""

    log: DataFrame
    vertices: DataFrame
    query: QueryGraph
    directed: bool
    default_label: int
    report: dict[str, int] = field(default_factory=dict)

    def updates(self) -> DataFrame:
        return self.log.where("seq > 0")


def default_label(declared: list[int], query_labels: list[int], given: int | None) -> int:
    """For vertices without a label: the given one, else the data's only one, else (unlabelled data) the query's only one, else 0."""
    if given is not None:
        return given
    if len(declared) == 1:
        return declared[0]
    return query_labels[0] if not declared and len(set(query_labels)) == 1 else 0


def load_dataset(spark: SparkSession, graph: str, stream: str | None, query_text: str, *, directed: bool = False, label: int | None = None) -> GraphStream:
    """Reads the initial graph, the stream and the query. Vertices' labels don't depend on time: the first declaration in graph, then stream, counts."""
    # A frame that an earlier call kept for the same path may hold a file's former content, so it is dropped first.
    g = parse_records(read_lines(spark, graph), stream=False).unpersist().persist()
    counts = check_malformed(g, "graph")
    parts = [g.withColumn("file", F.lit(0))]
    report = {"graph_" + k: n for k, n in counts.items()}
    report["edges"] = g.where("edge_line").count()
    if stream:
        s = parse_records(read_lines(spark, stream), stream=True).unpersist().persist()
        report |= {"stream_" + k: n for k, n in check_malformed(s, "stream").items()}
        loops = F.col("u") == F.col("v")
        own = s.where("kind = 'edge'").agg(F.count_if(loops).alias("loops"), F.count_if((F.col("op") == "I") & ~loops).alias("ins"), F.count_if((F.col("op") == "D") & ~loops).alias("del")).first()
        report |= {"insertions": own["ins"], "deletions": own["del"], "stream_self_loops": own["loops"]}
        parts.append(s.withColumn("file", F.lit(1)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wide = both.where("kind in ('edge', 'vertex') and (length(cast(u as string)) > 18 or length(cast(v as string)) > 18)").limit(1).count()
    kind = "decimal(38,0)" if wide else "long"
    both = both.withColumn("u", F.col("u").cast(kind)).withColumn("v", F.col("v").cast(kind)).withColumn("label", F.col("label").cast("long" if not wide else "decimal(19,0)"))

    declared = both.where("kind = 'vertex'").select(F.col("u").alias("id"), "label", F.struct("file", "line").alias("at"))
    first = declared.groupBy("id").agg(F.min_by("label", "at").alias("label"))
    report["relabel_ignored"] = declared.join(first.withColumnRenamed("label", "l0"), "id").where("label <> l0").count()
    edges = both.where("kind = 'edge'")
    ids = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).union(declared.select("id")).distinct()
    in_graph = lambda d: d.where("file = 0 and kind in ('edge', 'vertex')")
    report["nodes"] = in_graph(both).select(F.explode(F.array("u", "v")).alias("id")).where("id is not null").distinct().count()

    query = parse_query(query_text, directed)
    some = [int(r.label) for r in first.select("label").distinct().limit(2).collect()]
    fallback = default_label(some, [x for x in query.labels if x is not None], label)
    vertices = ids.join(first, "id", "left").select("id", F.coalesce("label", F.lit(fallback)).cast("long").alias("label"))
    report["implicit_vertices"] = ids.join(first, "id", "left_anti").count()

    start = dedup_edges(edges.where("file = 0").select("u", "v", F.col("label").cast("long").alias("el"), F.col("line").alias("at")), directed)
    log = start.select(F.lit(0).cast("long").alias("seq"), "u", "v", F.lit("I").alias("op"), "el")
    report["initial_edges"] = log.count()
    a, b = canonical(F.col("u"), F.col("v"), directed)
    pairs = edges.where("file = 0 and u <> v").groupBy(a.alias("u"), b.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("label", F.lit(-1))).alias("labels"))
    load = pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("labels") > 1).alias("conflicts")).first()
    report |= {"duplicate_edges": load.duplicates, "edge_label_conflicts": load.conflicts}
    if stream:
        # An update's place in the file is its time; only the order matters.
        moves = edges.where("file = 1").select(F.col("line").cast("long").alias("seq"), "u", "v", "op", F.col("label").cast("long").alias("el"))
        log = log.unionByName(canonical_log(moves, directed))
    return GraphStream(log, vertices, query.with_default(fallback), directed, fallback, report)


def write_deltas(deltas: DataFrame, path: str) -> None:
    """The per-update counts as Parquet."""
    deltas.write.mode("overwrite").parquet(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices (id, label) and edges (u, v, el) as a text graph."""
    v = vertices.select(F.concat_ws(" ", F.lit("v"), F.col("id").cast("string"), F.col("label").cast("string")).alias("value"))
    e = edges.select(F.concat_ws(" ", F.lit("e"), F.col("u").cast("string"), F.col("v").cast("string"), F.col("el").cast("string")).alias("value"))
    v.unionByName(e).write.mode("overwrite").text(path)


def write_stream(updates: DataFrame, path: str, shifted: Column | None = None) -> None:
    """Updates (seq, u, v, op, el) as a text stream in the order of seq; deletions for which `shifted` holds as `e -(u+1) -(v+1)`."""
    shift = (F.col("op") == "D") & F.coalesce(shifted if shifted is not None else F.lit(False), F.lit(False))
    tag = F.when((F.col("op") == "D") & ~shift, "-e").otherwise("e")
    end = lambda c: F.when(shift, -F.col(c) - 1).otherwise(F.col(c)).cast("string")
    # Files are named by partition and read in the order of their names.
    rows = updates.repartitionByRange("seq").sortWithinPartitions("seq")
    rows.select(F.concat_ws(" ", tag, end("u"), end("v"), F.col("el").cast("string")).alias("value")).write.mode("overwrite").text(path)
