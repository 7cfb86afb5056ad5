"""Graphs derived from tables: three logs over the driver's Parquet files, each with its SQL twin."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class GraphLog:
    """log: seq, u, v, op, el (stream at seq > 0); vertices: id, label."""

    log: DataFrame
    vertices: DataFrame
    directed: bool

    def updates(self) -> DataFrame:
        return self.log.where("seq > 0")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; without that setting only a local session has one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "scratch")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def ordered_lag(rows: DataFrame, by: str, column: str, out: str, chunk: int = 65_536) -> DataFrame:
    """The column's value in the row before, in the order of the integer column `by`.

    A window over all rows would be one task; this one is cut into chunks of the order, and a small table of the
    chunks' last values carries over from one to the next.
    """
    parts = rows.withColumn("_part", F.floor(F.col(by) / chunk))
    last = parts.groupBy("_part").agg(F.max_by(column, by).alias("_last"))
    carried = last.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_carried"))
    w = W.partitionBy("_part").orderBy(by)
    inner = parts.withColumn("_inner", F.lag(column).over(w)).withColumn("_rn", F.row_number().over(w))
    joined = inner.join(carried, "_part", "left")
    return joined.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_inner"))).drop("_part", "_carried", "_inner", "_rn")


def ordered_number(rows: DataFrame, first: str, rest: list[str], out: str) -> DataFrame:
    """1-based positions in the order (first, *rest): numbered within each value of `first`, plus the rows of smaller ones."""
    sizes = rows.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy(F.col(first)).rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(F.col(first).alias("_first"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = rows.withColumn("_rn", F.row_number().over(W.partitionBy(first).orderBy(*rest)))
    return inner.join(before, F.col(first).eqNullSafe(F.col("_first"))).withColumn(out, F.col("_before") + F.col("_rn")).drop("_first", "_before", "_rn")


def _split(log: DataFrame, vertices: DataFrame, directed: bool) -> GraphLog:
    """The first half of the sequence builds the initial graph."""
    last = log.agg(F.max("seq")).first()[0]
    cut = (last or 0) // 2
    return GraphLog(log.select((F.col("seq") - cut).alias("seq"), "u", "v", "op", "el"), vertices, directed)


def _ids(log: DataFrame) -> DataFrame:
    return log.select(F.col("u").alias("id")).union(log.select(F.col("v").alias("id"))).distinct()


def handoff(spark: SparkSession, sf_dir: str) -> GraphLog:
    """F1, undirected: consecutive users of the event sequence; an error event deletes."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = ordered_lag(events, "event_id", "user_id", "before").where("before <> user_id")
    log = rows.select(F.col("event_id").alias("seq"), F.least("before", "user_id").alias("u"), F.greatest("before", "user_id").alias("v"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), F.lit(None).cast("long").alias("el"))
    return _split(log, _ids(log).select("id", (F.col("id") % 3).alias("label")), False)


def click(spark: SparkSession, sf_dir: str, edge_labels: bool = False) -> GraphLog:
    """F2, directed: user -> 1000000 + key; with `edge_labels` the length of the event type labels the edge."""
    events = _read(spark, sf_dir, "events")
    key = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    el = F.when(F.col("event_type") != "error", F.length("event_type").cast("long")) if edge_labels else F.lit(None).cast("long")
    log = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("u"), (key + 1000000).alias("v"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), el.alias("el"))
    return _split(log, _ids(log).select("id", F.when(F.col("id") >= 1000000, 1).otherwise(0).cast("long").alias("label")), True)


def trade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3's lines as records (operators/records.py)."""
    lines = _read(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_shipdate").alias("t"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"))


def trade_kinds_apart(s: dict) -> bool:
    """Whether ids tell F3's orders, parts and suppliers apart (s: the records' survey)."""
    return s["max_a"] < 10000000 and 0 <= s["min_b"] and s["max_b"] < 10000000 and 0 <= s["min_c"]


def trade(spark: SparkSession, sf_dir: str) -> GraphLog:
    """F3, undirected, insertions only: order - part, part - supplier and order - supplier of each line."""
    lines = _read(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = ordered_number(lines, "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "rn")
    part, supp = F.col("l_partkey") + 10000000, F.col("l_suppkey") + 20000000
    pairs = F.array(*[F.struct((F.col("rn") * 3 + i).cast("long").alias("seq"), a.alias("u"), b.alias("v")) for i, (a, b) in enumerate(((F.col("l_orderkey"), part), (part, supp), (F.col("l_orderkey"), supp)))])
    log = rows.select(F.inline(pairs)).select("seq", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit("I").alias("op"), F.lit(None).cast("long").alias("el"))
    label = F.when(F.col("id") >= 20000000, 2).when(F.col("id") >= 10000000, 1).otherwise(0).cast("long")
    return _split(log, _ids(log).select("id", label.alias("label")), False)


_SPLIT = """, cut AS (SELECT max(seq) // 2 AS cut FROM raw),
log AS (SELECT seq - cut AS seq, u, v, op, el FROM raw, cut),
ids AS (SELECT u AS id FROM raw UNION SELECT v FROM raw)"""

SQL = {
    "handoff": """raw AS (
  SELECT event_id AS seq, least(p, user_id) AS u, greatest(p, user_id) AS v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op, NULL::BIGINT AS el
  FROM (SELECT *, lag(user_id) OVER (ORDER BY event_id) AS p FROM events) WHERE p <> user_id)""" + _SPLIT + ", vertices AS (SELECT id, id % 3 AS label FROM ids)",
    "click": """raw AS (
  SELECT event_id AS seq, user_id AS u, 1000000 + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op, NULL::BIGINT AS el
  FROM events)""" + _SPLIT + ", vertices AS (SELECT id, CASE WHEN id >= 1000000 THEN 1 ELSE 0 END::BIGINT AS label FROM ids)",
    "click_labelled": """raw AS (
  SELECT event_id AS seq, user_id AS u, 1000000 + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op,
    CASE WHEN event_type <> 'error' THEN length(event_type) END::BIGINT AS el
  FROM events)""" + _SPLIT + ", vertices AS (SELECT id, CASE WHEN id >= 1000000 THEN 1 ELSE 0 END::BIGINT AS label FROM ids)",
    "trade": """lines AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
raw AS (
  SELECT 3 * rn AS seq, l_orderkey AS u, 10000000 + l_partkey AS v, 'I' AS op, NULL::BIGINT AS el FROM lines
  UNION ALL SELECT 3 * rn + 1, 10000000 + l_partkey, 20000000 + l_suppkey, 'I', NULL FROM lines
  UNION ALL SELECT 3 * rn + 2, l_orderkey, 20000000 + l_suppkey, 'I', NULL FROM lines)""" + _SPLIT + ", vertices AS (SELECT id, CASE WHEN id >= 20000000 THEN 2 WHEN id >= 10000000 THEN 1 ELSE 0 END::BIGINT AS label FROM ids)",
}
