"""Connected components of an edge table by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` longs -> ``(node, label)``: every node of an edge and the smallest node it reaches.

    Each round takes the minimum label over a node's neighbours (join, then partial aggregate, so a hub's
    edges are combined before the shuffle and AQE may split a hub's join partition) and then replaces every
    label by that label's own label, which doubles the distance covered.  Each round's table is written to
    the shared folder.  An empty edge table gives an empty result.
    """
    both = written(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select(
        "node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, F.col("v") == F.col("node"))
            .groupBy(F.col("u").alias("near")).agg(F.min("label").alias("near_label"))
        )
        hooked = labels.join(near, F.col("node") == F.col("near")).select(
            "node", F.col("label").alias("old"), F.least("label", "near_label").alias("label")
        )
        target = labels.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = hooked.join(target, F.col("label") == F.col("t_node"), "left").select(
            "node", "old", F.least("label", F.coalesce("t_label", "label")).alias("label")
        )
        after = written(jumped, "labels")
        moved = after.filter("old <> label").count()
        drop_written(labels)
        labels = after.select("node", "label")
        if not moved:
            return labels
