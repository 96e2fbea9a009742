"""Connected components of a graph given as pairs, by label passing in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import written


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of `edges`.

    Each round hangs every node under the smallest label next to it and then
    follows labels to their own labels, so long chains shorten by halves. Labels
    are written to the shared folder each round; only their change counts reach
    the driver. Columns a and b name the pairs, loops and repeats are harmless,
    and no pairs give an empty result.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("next"))
        offered = both.join(seen, "b").select(F.col("a").alias("node"), "next")
        # a root takes what is offered to any node below it
        roots = offered.join(labels, "node").select(F.col("component").alias("node"), "next")
        own = labels.select("node", F.col("component").alias("next"))
        lowest = own.union(offered).union(roots).groupBy("node").agg(F.min("next").alias("next"))
        jump = lowest.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = lowest.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"))
        new = written(after, "labels")
        moved = new.join(labels.withColumnRenamed("component", "was"), "node").where(F.col("component") != F.col("was")).limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")
