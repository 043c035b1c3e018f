"""Per-key results where a few keys hold most rows.

Nothing is shuffled by the key alone before it is small.  Entries are first made distinct
by (list, vertex, edge): this spreads a hot vertex over all tasks, and map-side combining
drops repeats before the shuffle.  What follows are algebraic aggregates (counts, sums,
extremes), of which each task sends one small partial state per key.  The sorted edge list
is not algebraic; it is given in blocks of bounded size, keyed by vertex and range of edge
ids, so that no task ever holds the list of a hot vertex.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import pick, stored


def entries(adjacency: DataFrame) -> DataFrame:
    """(key, vertex_id, edge_id, label, writes, first_ts, last_ts): one row per list and edge.

    Entries written more than once count once; ``label`` is the one written last (highest seq,
    then the greatest label), ``writes`` how often.  Null vertices are kept, null lists (key) are not.
    """
    rows = pick(adjacency, "key", "vertex_id", "edge_id", "label", "seq", "ts").where("key IS NOT NULL")
    return rows.groupBy("key", "vertex_id", "edge_id").agg(
        F.max(F.struct("seq", "label"))["label"].alias("label"), F.count("*").alias("writes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def degrees(adjacency: DataFrame) -> DataFrame:
    """(key, vertex_id, degree): distinct edges per list, null vertices as one group."""
    rows = pick(adjacency, "key", "vertex_id", "edge_id").where("key IS NOT NULL")
    return rows.distinct().groupBy("key", "vertex_id").agg(F.count("*").alias("degree"))


def report(adjacency: DataFrame) -> DataFrame:
    """Per list and non-null vertex: degree, writes, labels, extremes of edge ids and times."""
    rows = entries(adjacency).where("vertex_id IS NOT NULL")
    # Two levels, so that the labels are counted without collecting them per vertex.
    by_label = rows.groupBy("key", "vertex_id", "label").agg(
        F.count("*").alias("n"), F.sum("writes").alias("writes"), F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return by_label.groupBy("key", "vertex_id").agg(
        F.sum("n").alias("degree"), F.sum("writes").alias("writes"), F.count("label").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("top_label"),
        F.min("lo").alias("first_edge"), F.max("hi").alias("last_edge"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def edge_lists(adjacency: DataFrame, *, span: int = 4096) -> DataFrame:
    """(key, vertex_id, block, n, edges): the sorted edge list in blocks of at most ``span`` ids.

    Block b holds the ids from b * span; the blocks in order are the whole list.  Null
    vertices and null edge ids have no place in a list.
    """
    rows = pick(adjacency, "key", "vertex_id", "edge_id").where("key IS NOT NULL AND vertex_id IS NOT NULL AND edge_id IS NOT NULL").distinct()
    blocks = rows.groupBy("key", "vertex_id", F.floor(F.col("edge_id") / span).alias("block")).agg(F.sort_array(F.collect_list("edge_id")).alias("edges"))
    return blocks.select("key", "vertex_id", "block", F.size("edges").alias("n"), "edges")


def hot(adjacency: DataFrame, *, share: float = 0.02) -> DataFrame:
    """(key, vertex_id, degree, total) of vertices that hold at least ``share`` of their list's distinct entries.

    Null vertices count in the total and are never named.
    """
    by_vertex = stored(degrees(adjacency), "degrees")  # one row per vertex, read twice
    totals = by_vertex.groupBy("key").agg(F.sum("degree").alias("total"))
    return by_vertex.where("vertex_id IS NOT NULL").join(totals, "key").where(F.col("degree") >= F.col("total") * F.lit(Decimal(str(share))))
