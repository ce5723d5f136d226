"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.staging import SENT, stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the smallest node reachable.

    Alternates two star steps: the large star hangs each node's greater neighbours on its least neighbour, the
    small star does so with its lesser ones. Links only ever shrink in number after the first step, and a hub's
    links are split by the join, not gathered. Each step's table is written to the shared folder, so a lost
    executor costs one step. Self-links, repeated links and either direction are allowed; rows with a null end
    are no links. Without links the result is empty. A chain that has not settled after ``most_rounds`` raises.
    """
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "links")
    many = links.count() > SENT     # as rows: the files' size, by which the planner broadcasts, says little of them
    nodes = lambda least: least.hint("merge") if many else least
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(nodes(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(nodes(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        links = stage(small, "small-star")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
