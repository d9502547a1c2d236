"""Connected components of a link table, without any link or component on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import dropped, written


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Smallest node that each linked node reaches.

    ``links`` has ``a`` and ``b``, longs, in any order and with repeats; links to itself and nulls are left out.
    Returns ``node``, ``root`` for each node with a link to another, ``node > root``; roots have no row.
    Each round takes two joins on keys that are unique on one side, so a hub splits as a skewed join.
    No links: an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    state = written(edges.distinct(), name)
    while True:
        lowest = written(state.groupBy("a").agg(F.min("b").alias("m")), name + "-low")
        # Each node keeps its lowest neighbour, and its other neighbours are passed on to that one.
        small_star = state.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        small_star = written(small_star, name + "-small")
        lowest2 = written(small_star.groupBy("a").agg(F.min("b").alias("m")), name + "-low2")
        up = lowest2.select(F.col("a").alias("b"), F.col("m").alias("up"))
        # Every node then points to the lowest neighbour of its parent.
        large_star = small_star.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b")).where("a > b")
        linked = large_star.unionByName(lowest2.select("a", F.col("m").alias("b"))).distinct()
        # Star-shaped: one parent each, and no parent that is itself a child.
        after = written(linked, name)
        changed = not small_star.join(up, "b", "left_semi").isEmpty() or after.count() != lowest2.count()
        for table in (state, lowest, small_star, lowest2):
            dropped(table)
        state = after
        if not changed:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
