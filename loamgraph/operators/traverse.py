"""Traversals as joins of edges(id, src, dst, label).

Seeds are joined with the edges by one endpoint.  Results are bags: a neighbour appears once
for each edge, a self loop twice in both directions.  Where only a set or a number of
walks is asked for, the frontier is reduced after each hop, so a vertex with very many
edges never multiplies what is carried on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import stored


def labelled(edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges with one of the labels; without labels all."""
    return edges.where(F.col("label").isin(*labels)) if labels else edges


def incident(edges: DataFrame, seeds: DataFrame, direction: str, labels: Sequence[str] = ()) -> DataFrame:
    """(v, edge_id, src, dst, label, dir) of the edges at each seed(id): 'in', 'out' or 'both' (in first, then out).

    Rows have no order of their own; (v, dir, edge_id) gives the order of the adjacency lists.
    """
    own = labelled(edges, labels).select(F.col("id").alias("edge_id"), "src", "dst", "label")
    start = seeds.select(F.col("id").alias("v"))

    def one(end: str, name: str) -> DataFrame:
        return start.join(own, start["v"] == own[end]).select("v", "edge_id", "src", "dst", "label", F.lit(name).alias("dir"))

    if direction == "both":
        return one("dst", "in").unionByName(one("src", "out"))
    return one({"in": "dst", "out": "src"}[direction], direction)


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str, labels: Sequence[str] = ()) -> DataFrame:
    """(v, edge_id, w, dir): the vertex at the other end of each edge."""
    return incident(edges, seeds, direction, labels).select("v", "edge_id", F.when(F.col("dir") == "out", F.col("dst")).otherwise(F.col("src")).alias("w"), "dir")


def other_end(edges: DataFrame, vertex: str) -> DataFrame:
    """Edges with ``other``: the endpoint that is not the vertex column (itself for a self loop)."""
    return edges.withColumn("other", F.when(F.col("src") != F.col(vertex), F.col("src")).otherwise(F.col("dst")))


def walk(edges: DataFrame, seeds: DataFrame, directions: Sequence[str], labels: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(v, w): the ends of all walks that take these directions, one row per walk.  For few seeds."""
    rows = seeds.select(F.col("id").alias("v"), F.col("id").alias("w"))
    for i, d in enumerate(directions):
        step = neighbours(edges, rows.select(F.col("w").alias("id")).distinct(), d, labels[i] if labels else ()).select(F.col("v").alias("w"), F.col("w").alias("next"))
        rows = rows.join(step, "w").select("v", F.col("next").alias("w"))
    return rows


def walk_counts(edges: DataFrame, directions: Sequence[str]) -> DataFrame:
    """(id, walks): how many walks with these directions begin at each vertex.

    The numbers are carried backwards along the edges, one aggregate per step, so no walk is
    ever written out.  Numbers are exact up to 38 digits; more stop the query.
    """
    counts = None
    for d in reversed(list(directions)):
        pairs = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("dst", "src"), ("src", "dst")]}[d]
        step = None
        for a, b in pairs:
            one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a", "b").agg(F.count("*").cast("decimal(38,0)").alias("m"))
            step = one if step is None else step.unionByName(one)
        if counts is not None:
            step = step.join(counts.withColumnRenamed("id", "b"), "b").select("a", (F.col("m") * F.col("walks")).alias("m"))
        counts = step.groupBy(F.col("a").alias("id")).agg(F.sum("m").cast("decimal(38,0)").alias("walks"))
    return counts


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", labels: Sequence[str] = ()) -> DataFrame:
    """(id, hops): vertices within so many hops of any seed, with the least number.

    Each hop's new vertices are stored before the next, which keeps the plan short.
    """
    frontier = stored(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "hop")
    seen = frontier
    for h in range(1, hops + 1):
        reached = neighbours(edges, frontier, direction, labels).select(F.col("w").alias("id")).distinct()
        frontier = stored(reached.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def neighbour_report(vertices: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, name, n) for each seed(id): the name of the vertex and its number of outgoing edges, 0 and null included."""
    n = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return seeds.select("id").join(vertices.select("id", "name"), "id", "left").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))
