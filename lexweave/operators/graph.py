"""Groups of nodes that links join, by the smallest node of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.storage import dropped, stored


def groups(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of all nodes of links (a, b): root is the smallest node that can be reached.

    Each round a node takes the smallest root among its neighbours', and then that root's own, so that long chains halve; minima are combined before
    the shuffle, so a node of very many links is no bottleneck. Rounds are written to the shared folder. Null ends are ignored.
    """
    own = links.where("a is not null and b is not null").select("a", "b")
    both = stored(own.union(own.select("b", "a")).distinct(), "links")
    at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    for _ in range(rounds):
        near = both.join(at.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        taken = at.join(near, "node", "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        further = taken.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stored(taken.join(further, "root", "left").select("node", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("was")).alias("moved")), "roots")
        dropped(at)
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            dropped(both)
            return at
    raise RuntimeError(f"groups: still moving after {rounds} rounds")
