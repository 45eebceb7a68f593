"""Connected components of an edge list, as DataFrame rounds.

Alternating large-star and small-star steps: every node hands its larger
neighbours, then its smaller ones, the least node it sees, until each component
is a star around its least node.  The least neighbour of a hub is folded by the
partial aggregate, and the join that hands it out is a plain equality join, so
adaptive execution splits a hub's rows.  Each round is written to the shared
checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): the root is the least
    node of its component.  Self loops, nulls, repeated and two-way edges are
    allowed; nodes without an edge do not appear."""
    now = materialized(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "cc")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    seen = state(now)
    while seen[0]:
        now = materialized(_small_star(_large_star(now)), "cc")
        new = state(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
