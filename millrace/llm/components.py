"""Connected components of a graph held as a table of links.

Alternates two steps until nothing changes: every node points its larger neighbours at its least one
(large star), then every node points its smaller neighbours and itself at its least one (small star).
Both are an aggregation and a join, so a node with very many links is spread like any hot key. Each
round's links are written in the shared folder; the driver sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of longs: (node, component) for every node but the least of each component.
    Links of a node with itself, repeated links, and links with a null end say nothing."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.table(edges, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "w")
        least = both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.table(small.union(least.toDF("u", "v")).distinct(), "links")
        scratch.drop(edges)
        scratch.drop(large)
        edges, before, state = small, state, _state(small)
        if state == before:
            return edges.toDF("node", "component")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
