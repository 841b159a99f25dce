"""Connected components of a link table, with joins and aggregations alone: nothing of it reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Workspace


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """node, component (its smallest node) of every node that a link (a, b) touches.

    Each root hooks onto its smallest neighbouring root where that is smaller; chains are halved until flat; links are
    then redrawn between roots. The link table shrinks with every pass, and each pass is a written table, so a lost
    executor costs one pass at most.
    """
    rest = work.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = work.table(nodes.select("node", F.col("node").alias("component")))
    while not rest.isEmpty():
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = work.table(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")).filter("to < root"))
        while True:
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("on"))
            joined = hooks.join(further, "to", "left").select("root", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"))
            joined = work.table(joined)
            moved = not joined.filter("moved").isEmpty()
            work.drop(hooks)
            hooks = joined.select("root", "to")
            hooks._pairloom_path = joined._pairloom_path
            if not moved:
                break
        ends = hooks.select(F.col("root").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("root").alias("b"), F.col("to").alias("rb"))
        redrawn = rest.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        smaller = work.table(redrawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        relabelled = work.table(labels.join(hooks.withColumnRenamed("root", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        work.drop(rest, labels, hooks)
        rest, labels = smaller, relabelled
    work.drop(rest)
    return labels
