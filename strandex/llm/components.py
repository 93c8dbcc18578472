"""Connected components of a table of links, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Labels whose table (two numbers each) is broadcast at most; above, the join is a shuffled one, whose hot labels the
#: adaptive planner splits.
BROADCAST_LABELS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) for every node in links (a, b long).

    Each round gives a node the smallest label among itself and its neighbours, then the label of that label, until
    none changes; labels only fall, so repeated, reversed and self links change nothing. No links give no rows.
    Each round is written, and partial aggregates go before each shuffle. The label of a label is looked up among
    labels only, of which a large component has one.
    """
    links = links.select(F.col("a"), F.col("b"))
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        hooked = written(labels.join(around, labels.node == around.a).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was")), "hooked")
        roots = hooked.select("label").distinct().withColumnRenamed("label", "node")
        jump = written(labels.join(roots, "node").select(F.col("node").alias("label"), F.col("label").alias("next")), "jump")
        found = hooked.join(F.broadcast(jump) if jump.count() <= BROADCAST_LABELS else jump, "label")
        fresh = written(found.select("node", F.least("label", "next").alias("label"), "was"), "labels")
        dropped(labels, hooked, jump)
        labels = fresh
        if fresh.where("label <> was").isEmpty():
            dropped(both)
            return fresh.select("node", "label")
