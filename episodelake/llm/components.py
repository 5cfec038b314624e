"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodelake.llm.common import near, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): the smallest node of its component.

    Each round takes the least label among a node and its neighbours and then
    follows that label's own label, so long chains halve; rounds end when no
    label changes. Hot nodes only repeat on the probe side of joins, which
    Spark splits, and in minima, which are combined before the shuffle.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        known = near(labels)
        least = both.join(known, both["b"] == known["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = known.join(least, known["node"] == least["a"]).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        jump = near(labels.select(F.col("node").alias("of"), F.col("label").alias("jump")))
        new = written(step.join(jump, step["next"] == jump["of"], "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
