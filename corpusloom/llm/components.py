"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; ``a < b`` in every row."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the smallest node of the component.

    Each round is written to the shared folder, so lost executors cost one round at most. The rounds
    end when the edges are stars that no longer change. A hub takes part through grouped minima and
    joins on its id, never as a collected neighbour list.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = None
    for _ in range(MOST_ROUNDS):
        now = checkpointed(_small_star(_large_star(now)), "edges")
        summary = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))
        ).first()
        if summary == state:
            break
        state = summary
    else:
        raise RuntimeError(f"no stars after {MOST_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
