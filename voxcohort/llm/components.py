"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the least node that can be reached.

    Each round takes the least label among the neighbours and the node that is its own label so far, so chains shorten by half.
    """
    # every node is its own neighbour, too
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb"))))
    near = shelf.put(edges.select(ends.alias("end")).select("end.*").distinct())
    labels = shelf.put(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        asked = near.union(labels.where("label <> node").select("node", "label"))
        found = asked.join(labels.withColumnRenamed("node", "b"), "b")
        moved = shelf.put(found.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was")))
        changed = not moved.where("label <> was").isEmpty()
        shelf.drop(labels)
        labels = moved.select("node", "label")
        if not changed:
            shelf.drop(near)
            return labels
