"""Connected components by joins: no vertex, link or label is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every end of the edges (a, b): the smallest key of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so the rounds grow with the
    logarithm of a component's width. Each is a table in the shared folder.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(edges.select(F.inline(ways)).distinct(), "graph-edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        less = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = stage(less.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "graph-labels")
        release(labels)
        labels = new.select("key", "label")
        labels._weirflow_path = new._weirflow_path
        if not new.where("old <> label").limit(1).count():
            release(both)
            return labels
