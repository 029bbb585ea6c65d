"""Connected components of a link table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that links reach, for every node that has a link.

    Each round every node takes the smallest label among its own, its neighbours' and its label's, until none changes.
    Messages to a node are folded before the shuffle, so a node with very many links costs no more than they do.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
                 .select("node", F.least("node", "v").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("u"), "label"), "u").select(F.col("v").alias("node"), "label")
        # A label's own label shortens chains: the new label is told to the old one and its label asked for.
        jump = labels.select(F.col("label").alias("k"), "node").join(
            labels.select(F.col("node").alias("k"), F.col("label").alias("label")), "k").select("node", "label")
        old = labels.select("node", F.lit(None).cast(labels.schema["label"].dataType).alias("label"), F.col("label").alias("was"))
        told = heard.unionByName(jump).select("node", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        new = cut(told.unionByName(old).groupBy("node")
                  .agg(F.min(F.least("label", "was")).alias("label"), F.max("was").alias("was")))
        if new.filter("label < was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
