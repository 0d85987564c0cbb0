"""Connected components of a link table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Rounds, cut, look_up


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node of links (a, b).

    Rounds of taking the smallest neighbouring label and then the label's own label. Labels only fall and each round
    halves the chains, so the rounds grow with the logarithm of a component's diameter. Each round is cut off. Nodes with
    more than HOT_SHARE of all links, and labels of more than HOT_SHARE of all nodes, are looked up where their rows lie.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    degrees = both.groupBy("b").agg(F.count("*").alias("_n"))
    hubs = cut(degrees.where(F.col("_n") > HOT_SHARE * both.count()).select("b"))
    rounds = Rounds(links.sparkSession)
    labels = rounds.next(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    total = labels.count()
    while True:
        near = look_up(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = cut(labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label")))
        wide = lower.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_SHARE * total)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = rounds.next(look_up(lower, up, "label", wide).select("node", "_old", F.least("label", F.coalesce("_up", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.where("label <> _old").limit(1).count():
            return labels
