"""Connected components by hooking and pointer doubling: the number of rounds grows with the
logarithm of the longest chain, not with the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) of every node of edges(u, v), component being the least node that can be
    reached, and the rounds it took. Nodes are of any type that has an order.

    Each node points at a node not greater than itself, first at itself. In a round a node, and
    the one that it points at, point at the least that their neighbours' pointers point at, and
    each pointer is followed one step further. Rounds start from a written table each, so an
    executor that is lost costs at most a round. No edges: no rows. Null ends: left out."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut(both.where("u is not null and v is not null").distinct())
    now = cut(both.select(F.col("u").alias("node")).distinct().withColumns({"to": F.col("node"), "moved": F.lit(True)}))
    rounds = 0
    while now.where("moved").limit(1).count():
        rounds += 1
        far = now.select("node", "to").join(now.select(F.col("node").alias("to"), F.col("to").alias("further")), "to")
        near = both.join(far.select(F.col("node").alias("v"), "further"), "v").groupBy("u").agg(F.min("further").alias("least"))
        seen = far.join(near, F.col("node") == F.col("u")).select("node", "to", "further", "least")
        hooked = seen.groupBy(F.col("to").alias("hook")).agg(F.min("least").alias("by"))
        new = seen.join(hooked, F.col("node") == F.col("hook"), "left").withColumn("new", F.least("to", "further", "least", "by"))
        now = cut(new.select("node", F.col("new").alias("to"), (F.col("new") != F.col("to")).alias("moved")))
    return now.select("node", F.col("to").alias("component")), rounds
