"""Connected components by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import write_once


def components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges`` (columns ``a``, ``b``) to a ``root`` of its component.

    In a round each node moves to the neighbour, itself included, with the
    smallest hash of that round, and edges follow their ends. An edge from a node to its choice
    joins their images, so parts never fall apart, and a fixed share of the
    nodes goes in each round: the number of rounds grows with the logarithm of
    the component size. Smallest choices are combined before the shuffle, so a
    hub is one row per task; the joins that move edges are left to the skew
    handling of the planner. Each round is written to the shared folder.
    """
    edges = write_once(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "edges")
    both = edges.select("a").union(edges.select("b")).distinct()
    roots = both.select(F.col("a").alias("node"), F.col("a").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        order = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("v"))
        moved = write_once(ends.groupBy("a").agg(F.min(order).alias("n")).select(
            F.col("a").alias("from"), F.least("n", own)["v"].alias("to")), "moves")
        roots = write_once(roots.join(moved, F.col("root") == F.col("from"), "left").select(
            "node", F.coalesce("to", "root").alias("root")), "roots")
        left, right = moved.withColumnsRenamed({"from": "fa", "to": "ta"}), moved.withColumnsRenamed({"from": "fb", "to": "tb"})
        edges = write_once(
            edges.join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb")).where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return roots
