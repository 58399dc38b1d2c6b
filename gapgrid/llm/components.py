"""Connected components of a link table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import discard, materialize


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by one of its nodes.

    Each round every node joins its neighbour (or itself) of least hash, and links are rewritten to the nodes joined. The hash
    is new in each round, so a fixed share of the nodes of any graph goes away per round. Only minima are taken over a node's
    links, so hubs are combined before they are shuffled.
    """
    left = materialize(links.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    label = None
    seed = 0
    while not left.isEmpty():
        seed += 1
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = F.xxhash64(F.col("b"), F.lit(seed))
        best = ends.groupBy("a").agg(F.min(F.struct(h.alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(seed)).alias("h"), F.col("a").alias("b"))
        to = materialize(best.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("to")), f"{name}-to-{seed}")
        t = to.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(t, "b")
        done, left = left, materialize(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-{seed}")
        old = [done, to]
        if label is None:
            new = to.withColumnRenamed("to", "component")
        else:
            step = to.select(F.col("node").alias("component"), "to")
            new = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            old.append(label)
        label = materialize(new, f"{name}-label-{seed}")
        discard(*old)
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
