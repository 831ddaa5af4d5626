"""Connected components of links held in a table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import materialize


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), in any order. Rows (node, component) for every node of a link; component is the least node reachable.

    Each round every node takes the least label among its neighbours and itself, the node that was its label takes the
    least that its members found (a hook), and then all take their label's label. Rounds grow with the logarithm of a
    chain's length in practice. Labels only fall and stay in their component, so rounds end by themselves: when neighbours
    have one label, it is the least node's.
    """
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        found = materialize(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("near")), f"near{k}")
        if not found.where("near <> was").limit(1).count():  # a component has one label, which no node is below
            return labels
        hook = found.groupBy(F.col("was").alias("node")).agg(F.min("near").alias("hook"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = found.join(hook, "node", "left").select("node", F.least("near", F.coalesce("hook", "near")).alias("component"))
        step = step.join(hop, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"))
        labels, k = materialize(step, f"labels{k}"), k + 1
