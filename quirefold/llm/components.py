"""Connected components of an edge table: least labels with pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the least vertex that can be reached. A written table.

    A label that very many vertices share is a hot key of the joins only on their left side, which adaptive execution
    splits; the aggregates combine before they exchange."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("jump"))
        after = written(least.join(up, F.col("label") == F.col("u"), "left").select("v", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        changed = after.filter("old <> label").limit(1).count()
        dropped(labels)
        labels = after
        if not changed:
            dropped(both)
            out = labels.select("v", "label")
            out._written_path = labels._written_path
            return out
