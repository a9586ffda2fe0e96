"""Connected components of links between documents, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id reachable.

    Each round takes the smallest label among neighbours (partial minima before the
    shuffle, so a hub is one row for each task), then jumps to the label of that label.
    Rounds end when no label changes; each is written, so none recomputes the last.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        step = written(step.join(jump, "mid").select("id", "was", F.least("mid", "far").alias("label")), "labels")
        labels = step.select("id", "label")
        if step.filter("label <> was").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))
