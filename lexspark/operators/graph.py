"""Connected components over link tables, in DataFrame operations with durable cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.plans.storage import cut


def components(links: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the least value in the component of every node that has links.

    links: columns a, b (either order, repeats allowed). values: columns node, value, one row a node, no
    two nodes of equal value. Each round takes the least value of a node's neighbours, then follows the
    node that owns this value to what that node has found (pointer jumping), so rounds grow with the
    logarithm of a chain's length. No links: an empty table."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = cut(both.select(F.col("a").alias("node")).distinct().join(values, "node").select("node", F.col("value").alias("own"), F.col("value").alias("value")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "value"), "b").groupBy(F.col("a").alias("node")).agg(F.min("value").alias("near"))
        lower = cut(state.join(near, "node").select("node", "own", F.col("value").alias("was"), F.least("value", "near").alias("value")))
        owners = lower.select(F.col("own").alias("value"), F.col("value").alias("further"))
        jumped = cut(lower.join(owners, "value").select("node", "own", "was", F.least("value", "further").alias("value")))
        state = jumped.select("node", "own", "value")
        if jumped.where("value <> was").isEmpty():
            return state.select("node", "value")
