"""Connected components of links between documents, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``links(a, b)``.

    Each round takes the smallest label among the neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest chain. Rounds are written tables: a lost executor costs
    a re-read. A hub's links are many rows on the big side of the join, and its minimum is partly taken
    before the shuffle. Self-links and repeated links change nothing; null nodes link nothing.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    both = kept(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = kept(both.groupBy("node").agg(F.min("other").alias("least"))
                  .select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        least = both.join(theirs, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        near = (labels.join(least, "node")
                .select("node", F.col("component").alias("old"), F.least("component", "theirs").alias("near")))
        further = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = kept(near.join(further, "near").select("node", "old", F.least("near", "far").alias("component")), "labels")
        if after.filter("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
