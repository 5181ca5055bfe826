"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.session import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, label) per node of the edges: label is the smallest node of its component.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. Labels are long values; only counts reach the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a)))
    both = staged(both.where("node <> near").distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("offer"))
        taken = labels.join(offered, "node", "left").select("node", "label", F.least("label", "offer").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = staged(taken.join(jump, "next", "left").select("node", F.col("label").alias("was"), F.least("next", "beyond").alias("label")), "labels")
        labels, changed = new.select("node", "label"), new.where("was <> label").limit(1).count()
        if not changed:
            return labels
