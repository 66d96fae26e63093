"""Connected components by alternating stars; no node's links are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.durable import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest neighbour: of larger nodes, or of a node's smaller side."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written, so that the join can split a node with very many links.
    least = durable(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    joined = both.join(least, F.col("a") == F.col("n"))
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node it reaches.

    Each round links nodes to their smallest neighbours from both sides; the number
    of rounds grows with the logarithm of the longest chain. A round's links are a
    table in the shared folder, so a lost executor does not undo earlier rounds.
    """
    edges = durable(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    state = None
    for _ in range(max_rounds):
        edges = durable(_star(_star(edges, True), False), "stars")
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("b")
        ).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
