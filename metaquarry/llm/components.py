"""Connected components of a table of links, by repeated hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import stored


def connected(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): for every node of ``links`` (a, b), the smallest node it reaches.

    Every round lets a node, and the node it points at, take the smallest grandparent among
    its neighbours, so paths shrink by a factor and rounds grow with the logarithm of the
    longest path. All state is in tables; the driver sees one count per round.
    """
    ends = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{label}-ends",
    )
    points = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
    points = stored(points.select("node", F.least("node", "up").alias("up")), f"{label}-0")
    while True:
        parent = points.select(F.col("node").alias("up"), F.col("up").alias("top"))
        state = points.join(parent, "up").select("node", "up", "top")
        near = (
            ends.join(state.select(F.col("node").alias("b"), F.col("top").alias("near")), "b")
            .groupBy("a")
            .agg(F.min("near").alias("near"))
            .withColumnRenamed("a", "node")
        )
        both = state.join(near, "node").select("node", "up", F.least("top", "near").alias("best"))
        offers = both.select("node", "best").unionByName(both.select(F.col("up").alias("node"), "best"))
        new = offers.groupBy("node").agg(F.min("best").alias("best"))
        moved = stored(
            points.join(new, "node").select(
                "node", F.least("up", "best").alias("up"), (F.col("best") < F.col("up")).alias("moved")
            ),
            label,
        )
        points = moved.select("node", "up")
        if not moved.filter("moved").limit(1).count():
            return points.select("node", F.col("up").alias("component"))
