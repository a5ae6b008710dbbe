"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import cut, spread_join


def _summary(edges: DataFrame) -> tuple:
    """Count and an order-free hash sum; equal summaries mean that a step changed nothing."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``.

    The component is the smallest node reachable. Self-loops, repeated edges,
    either direction and null ends (ignored) are all allowed; nodes without an
    edge have no row. No neighbour list is ever gathered: minima come from
    partially aggregated groups and return by joins. Edges and minima are
    written to the shared folder in each round, so both sides of a join are
    plain shuffles, which AQE splits when a hub is hot.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "edges")
    before = _summary(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "edges")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _summary(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def named_components(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """``own(fp, least_id, n)`` and ``nodes(node, component)`` -> ``(fp, n, component, component_id)``: the least id of each component."""
    nodes = own.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = cut(nodes, "nodes")
    smallest = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    return spread_join(nodes.select("fp", "n", "component"), smallest, ["component"], "members").select("fp", "n", "component", "component_id")
