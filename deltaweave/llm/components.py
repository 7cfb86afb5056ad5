"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a, b: long).

    A large star hangs each node's larger neighbours on its smallest one; a small star does so with the smaller ones and
    itself. The links end as stars around the smallest nodes after few rounds, even for long chains; rounds go on until
    one changes nothing. Each round's links are written to the shared folder; only two numbers reach the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before its join, so that a hub's rows there can be split.
        least = written(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m")))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        low = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(low, F.col("a") == F.col("u"))
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(hung.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
