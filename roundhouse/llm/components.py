"""Connected components by stars: every step is a grouping and a join, so no component meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on edges ``u > v``. Large: larger neighbours move to the least neighbour. Small: smaller neighbours do, and the node itself."""
    if small:
        near = edges
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # an edge to a smaller neighbour is found from that neighbour's side
    return moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for every node with a link; the label is the least node of its component. ``links`` has integer ``u, v``."""
    edges = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        step = scratch.save(_star(_star(edges, small=False), small=True))
        scratch.drop(edges)
        edges = step
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
