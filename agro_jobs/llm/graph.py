"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of the component, for every id on an edge (a, b).

    Each round takes the smallest label among the neighbours and then the label's own label, so
    rounds grow with the logarithm of the diameter. Rounds are written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "graph-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        moved = materialize(step.join(jump, "new", "left").select("id", "old", F.least("new", "far").alias("label")), "graph-labels")
        labels = moved.select("id", "label")
        if not moved.where("old != label").limit(1).count():
            return labels
