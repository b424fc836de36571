"""Connected components of a link table, without collecting links or members of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.common import staged


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b); nodes without links are their own.

    Each round gives a node the smallest label among itself and its neighbours, then the label of that
    label. Minima are taken before the shuffle, so a node with very many links is no hot group. Every
    round is stored, and the rounds end when no label falls."""
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = staged(nodes.select("node", F.col("node").alias("component")), "labels")
    changed = not both.isEmpty()
    while changed:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        least = labels.join(heard, "node", "left").select("node", "component", F.least("component", "heard").alias("next"))
        least = staged(least, "labels")
        ahead = least.select(F.col("node").alias("next"), F.col("next").alias("further"))
        after = least.join(ahead, "next", "left").select("node", F.least("next", "further").alias("component"), (F.col("next") < F.col("component")).alias("fell"))
        after = staged(after, "labels")
        changed = not after.where("fell").isEmpty()
        labels = after.drop("fell")
    return labels
