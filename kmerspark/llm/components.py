"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "components-low")  # a table, so that a hub's rows can be split in the join
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "components-low")
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of every node of the edges (u, v); comp is the least node of its component.

    Alternating large-star and small-star steps shrink every component to a star around its least node in about
    log(size) rounds. Each step is a minimum (combined before the shuffle) and a join, so a hub is no single task. Every round is a
    table in the shared folder; only one checksum row of it comes to the driver.
    """
    edges = materialize(edges.select("u", "v").filter("u != v").distinct(), name)
    mark = None
    while True:
        edges = materialize(_small_star(materialize(_large_star(edges), name)), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
