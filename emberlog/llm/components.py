"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it is linked with over any number of links (a, b), for all nodes in links.

    Every round gives each node the smallest label around it, hooks the root of its old label to
    that, and follows the root once, so a chain shrinks by a factor in each round. Labels are
    always nodes of the same component. Hot nodes only ever meet in joins and partial minima.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a <> b").distinct(), "component-edges")
    # the first round needs no join: every node still has itself as its label
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("around"))
    labels = written(labels.select("node", F.least("node", "around").alias("label")), "component-labels")
    while True:
        old = labels
        around = (
            edges.join(old, edges.b == old.node).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("around"))
        )
        seen = old.join(around, F.col("node") == F.col("at")).select(
            "node", "label", F.least("label", "around").alias("best")
        )
        hooks = seen.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("hook"))
        hooked = seen.join(hooks, F.col("label") == F.col("root")).select(
            "node", "label", F.least("best", "hook").alias("best")
        )
        hooked = written(hooked, "component-hooks")
        if not hooked.filter("best <> label").limit(1).count():
            return labels
        jump = hooked.select(F.col("node").alias("at"), F.col("best").alias("further"))
        labels = written(
            hooked.join(jump, F.col("best") == F.col("at")).select("node", F.least("best", "further").alias("label")),
            "component-labels",
        )
