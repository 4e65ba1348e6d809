"""Orientation trees as a table orientation(k, level, parent, active, q, sigma, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent").alias("k")).where("k is not null").distinct(), "k", "left_anti")


def per_level(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("active").cast("long")).alias("n_active"), F.max("score").alias("best"))


def set_sigma(tree: DataFrame, level: int, sigma: float) -> DataFrame:
    return tree.withColumn("sigma", F.when(F.col("level") == level, F.lit(sigma)).otherwise(F.col("sigma")))


def grow(tree: DataFrame, children: DataFrame, level: int) -> DataFrame:
    """Children become active nodes of ``level``; their parents are no longer active."""
    parents = children.select(F.col("parent").alias("k")).distinct().withColumn("_p", F.lit(True))
    kept = tree.join(parents, "k", "left").withColumn("active", F.col("active") & F.col("_p").isNull()).drop("_p")
    new = children.withColumns({"level": F.lit(level), "active": F.lit(True), "score": F.lit(0.0)})
    return kept.unionByName(new.select(kept.columns))


def node_sums(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum of values(k, p, v) over the members of each node(node, k), per pixel."""
    return values.join(nodes, "k").groupBy("node", "p").agg(F.sum("v").alias("v"))


def scatter(sums: DataFrame, nodes: DataFrame) -> DataFrame:
    """The transpose of ``node_sums``."""
    return sums.join(nodes, "node").groupBy("k", "p").agg(F.sum("v").alias("v"))


def nested_cells(orientations: DataFrame, ops: DataFrame, radii_deg: tuple[float, ...]) -> DataFrame:
    """node(level, node, k): per level a greedy cover within each cell of the level above, every orientation with its nearest representative.

    The first level covers all orientations; a finer cell never crosses a coarser one.
    """
    from ..functions import rotations as rot
    from ..plans.state import materialise

    out = None
    members = orientations.select("k", "qx", "qy", "qz", "qw", F.lit(0).cast("long").alias("cell"))
    for level, radius in enumerate(sorted(radii_deg, reverse=True)):
        kept = rot.thin_greedy(members, ops, radius, within="cell")
        near = materialise(rot.nearest_misorientation(members, members.join(kept, "k", "left_semi"), ops, first_deg=radius, within="cell", few=True))
        part = near.select(F.lit(level).alias("level"), F.col("t").alias("node"), "k")
        out = part if out is None else out.unionByName(part)
        members = members.drop("cell").join(near.select("k", F.col("t").cast("long").alias("cell")), "k")
    return out
