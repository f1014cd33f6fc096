"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivena.plans.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node in ``edges`` (a, b: long), root being the least node of its component.

    Each round takes the least label among a node's neighbours, then the label of that label,
    so labels travel exponentially fast along chains; it ends when no label changes.  Labels and
    edges stay distributed; a node with very many neighbours is met by a minimum that is taken
    before the shuffle, and as one row of the other side of a join.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stage(both.union(both.select("other", "node")).filter("node <> other").distinct(), "components-edges")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "components-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        told = stage(labels.join(heard, "node").select("node", F.col("root").alias("before"), F.least("root", "heard").alias("root")), "components-told")
        jump = told.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stage(told.join(jump, "root").select("node", "before", F.least("root", "next").alias("root")), "components-labels")
        labels = after.select("node", "root")
        if after.filter("root <> before").isEmpty():
            return labels
